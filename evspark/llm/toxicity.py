"""Toxicity scores from two Kneser-Ney models of words' letters, one per class (operator 11).

A word ``[0-9a-z or beyond ASCII]+`` (A-Z lower-cased) is a sequence of bytes between blanks, each predicted from up to five before it. A class
has its own counts of these events: the number of its documents with a word in which the event occurs, summed over words. Both classes share their
backoff: what absolute discounting (``DISCOUNT`` documents) takes from an event goes to one interpolated Kneser-Ney distribution over the
counts of both classes, with continuation counts in lower orders. An expression that few documents of either class hold therefore has
the same probability in both and speaks for none.

A word's log-likelihood difference counts beyond ``MARGIN`` nats, the extent to which rare expressions differ by chance. A document's evidence is
the sum over its words, divided by their number (and ``PRIOR_WORDS`` more, so that a word or two decide little). A logistic
curve over the logarithm of the evidence, fitted on labelled rows that the counts have not seen, makes it a probability.

Definitions: null and empty texts have evidence 0 and get a score. Rows are kept as they are, repeated ids too, and each counts
as a document; a null id is not held out and has no label; an id with several labels takes the smallest. Without two
rows of each class to fit the curve on, the score is the share of class 1 among labels (0.5 without any). Texts and words of
any length are read whole. Other columns, label, language, source and id are never inputs of a score.

Scale: labelled rows are counted where they lie: their ids are broadcast up to ``BROADCAST_IDS`` of them, joined beyond. Words are summed per
task, then over tasks; events come from distinct words. An event or context enters the scoring table only if more documents of a class
hold it than the discount takes away; all others cancel, so this changes no score. The table is files of sorted keys (at most six
bytes are their own key) that workers map and search.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm import shared

ORDER = 6
DISCOUNT = 2.0
SHARED_DISCOUNT = 0.75
MARGIN = 3.0
PRIOR_WORDS = 10
FLOOR = 0.002
"""Evidence that is added before the logarithm."""
RIDGE = 1e-3
CURVE_IDS = 20_000
"""Most labelled ids that the curve is fitted on; the counts of the models take all others."""
BROADCAST_IDS = 2_000_000
MOST_WORDS = 200_000
KEPT_BYTES, ENTRY_BYTES = 32 << 20, 160
CHUNK_BITS = 4
CONTEXT = 1 << 56

# Bytes of words, all others are blanks.
_WORD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_WORD).split()


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def events(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Events of words as numbers, the event's bytes from the first context byte to the predicted one, and the word of each."""
    raw = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = raw.copy()
    for back in range(1, ORDER):
        at = np.flatnonzero(place >= back)
        key[at] |= raw[at - back] << np.uint64(8 * back)
    inside = place > 0
    return key[inside], word[inside]


@dataclass(frozen=True)
class Table:
    """Folder of sorted keys with their log ratios, a pair of files per chunk."""

    folder: str

    def opened(self) -> list[tuple[np.ndarray, np.ndarray]]:
        names = {f.base_name for f in shared.listed(self.folder)}
        empty = np.empty(0, np.uint64), np.empty(0, np.float64)
        return [(np.frombuffer(shared.mapped(f"{self.folder}/{c:02d}-keys"), np.uint64), np.frombuffer(shared.mapped(f"{self.folder}/{c:02d}-values"), np.float64)) if f"{c:02d}-values" in names else empty for c in range(1 << CHUNK_BITS)]


def _chunk(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHUNK_BITS)).astype(np.int64)


def looked_up(table: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of keys, and which were found."""
    value, found, chunk = np.zeros(len(keys)), np.zeros(len(keys), bool), _chunk(keys)
    for c, (have, values) in enumerate(table):
        at = np.flatnonzero(chunk == c)
        if len(have) and len(at):
            place = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
            hit = have[place] == keys[at]
            found[at[hit]], value[at[hit]] = True, values[place[hit]]
    return value, found


def ratios(table: list[tuple[np.ndarray, np.ndarray]], words: list[bytes]) -> np.ndarray:
    """Log-likelihood of each word in the toxic class less that in the other."""
    if not words:
        return np.empty(0)
    key, word = events(words)
    distinct, back = np.unique(key, return_inverse=True)
    value, found = looked_up(table, distinct)
    # an unseen event has the shared probability times what its context passes on
    context, _ = looked_up(table, (distinct >> np.uint64(8)) | np.uint64(CONTEXT))
    return np.bincount(word, np.where(found, value, context)[back], len(words))


class _Weights(dict):
    """Weights of words, kept up to a number of bytes."""

    def __init__(self, table: list[tuple[np.ndarray, np.ndarray]]):
        super().__init__()
        self.table, self.left = table, KEPT_BYTES

    def evidence(self, texts: list[str | None]) -> list[float]:
        split = [words_of(t) for t in texts]
        new = [w for w in set().union(*split) if w not in self]
        weight = np.maximum(ratios(self.table, new) - MARGIN, 0.0).tolist()
        size = sum(map(len, new)) + ENTRY_BYTES * len(new)
        if size > self.left:
            self.clear()
            self.left = KEPT_BYTES
            new = list(set().union(*split))
            weight = np.maximum(ratios(self.table, new) - MARGIN, 0.0).tolist()
            size = sum(map(len, new)) + ENTRY_BYTES * len(new)
        self.update(zip(new, weight, strict=True))
        self.left -= size
        return [sum(map(self.__getitem__, words)) / (len(words) + PRIOR_WORDS) for words in split]


def word_counts(rows: DataFrame) -> DataFrame:
    """word, ordinary and toxic documents that hold it, from (label, text)."""
    schema = pa.schema([("word", pa.binary()), ("ordinary", pa.int64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def spill() -> Iterator[pa.RecordBatch]:
            words = sorted(found[0].keys() | found[1].keys())
            for at in range(0, len(words), 8192):
                some = words[at : at + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array([c[w] for w in some], pa.int64()) for c in found)], schema=schema)
            for c in found:
                c.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found[label].update(set(words_of(text)))
                if sum(map(len, found)) > MOST_WORDS:
                    yield from spill()
        yield from spill()

    parts = rows.select(F.col("label").cast("int"), "text").mapInArrow(run, "word binary, ordinary long, toxic long")
    return parts.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def event_counts(words: DataFrame) -> DataFrame:
    """key, ordinary, toxic of every event of the distinct words."""
    schema = pa.schema([("key", pa.int64()), ("ordinary", pa.int64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                key, word = events(part.column(0).to_pylist())
                distinct, back = np.unique(key, return_inverse=True)
                sums = [np.bincount(back, part.column(c).to_numpy()[word], len(distinct)).astype(np.int64) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *map(pa.array, sums)], schema=schema)

    parts = words.mapInArrow(run, "key long, ordinary long, toxic long")
    return parts.groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _level(length: int) -> Column:
    """Keys of events of a length: their first byte is not 0."""
    return (F.col("key") >= F.lit(1 << 8 * (length - 1))) & (F.col("key") < F.lit(1 << 8 * length))


def shared_probabilities(top: DataFrame) -> DataFrame:
    """key, p of the events in ``top``: interpolated Kneser-Ney over the counts of both classes.

    An order below the highest counts the different bytes before an event; an event at a word's start has none and counts its documents.
    """
    at_length = lambda k: top.where(_level(k)).select("key", (F.col("ordinary") + F.col("toxic")).cast("double").alias("n"))
    kinds = {ORDER: shared.stored(at_length(ORDER), "events")}
    for k in range(ORDER - 1, 0, -1):
        shorter = kinds[k + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.count("*").cast("double").alias("n"))
        kinds[k] = shared.stored(shorter.unionByName(at_length(k)), "events")
    below, out = None, None
    for k in range(1, ORDER + 1):
        now = kinds[k].withColumn("context", F.shiftright("key", 8))
        sums = now.groupBy("context").agg(F.sum("n").alias("sum"), F.count("*").alias("kinds"))
        now = now.join(sums, "context")
        if below is None:
            lower = F.lit(1 / 256)
        else:
            now = now.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            now, lower = now.join(below.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix"), F.col("lower")
        p = (F.greatest(F.col("n") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("kinds") * lower) / F.col("sum")
        below = shared.stored(now.select("key", p.alias("p")), "shared")
        out = below if out is None else out.unionByName(below)
    return out


def table_of(rows: DataFrame) -> Table:
    """Scoring table from (label, text) of training rows."""
    top = shared.stored(event_counts(shared.stored(word_counts(rows), "words")), "top")
    classes = ("ordinary", "toxic")
    taken = lambda c: F.least(F.col(c), F.lit(DISCOUNT))
    contexts = top.groupBy(F.shiftright("key", 8).alias("context")).agg(
        *[F.sum(c).alias(f"{c}_sum") for c in classes], *[F.sum(taken(c)).alias(f"{c}_taken") for c in classes],
        F.max(F.greatest(*classes)).alias("most"),
    )
    contexts = shared.stored(contexts.where(F.col("most") > DISCOUNT), "contexts")
    passed = lambda c: F.when(F.col(f"{c}_sum") > 0, F.col(f"{c}_taken") / F.col(f"{c}_sum")).otherwise(1.0)
    own = lambda c: F.when(F.col(f"{c}_sum") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_sum")).otherwise(0.0)
    strong = top.where(F.greatest(*classes) > DISCOUNT).withColumn("context", F.shiftright("key", 8)).join(contexts, "context").join(shared_probabilities(top), "key")
    likely = lambda c: F.log(own(c) + passed(c) * F.col("p"))
    seen = strong.select("key", (likely("toxic") - likely("ordinary")).alias("value"))
    backs = contexts.select(F.col("context").bitwiseOR(F.lit(CONTEXT)).alias("key"), (F.log(passed("toxic")) - F.log(passed("ordinary"))).alias("value"))
    return _written(seen.union(backs))


def _written(rows: DataFrame) -> Table:
    folder = shared.new_folder(rows.sparkSession, "toxic-table")
    shared.make_folder(folder)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_chunk(keys).astype(np.int32)), *batch.columns], names=["chunk", "key", "value"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, files = None, []
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            for c in np.unique(chunk).tolist():
                if c != now:
                    for f in files:
                        f.close()
                    now, files = c, [shared.AtomicFile(f"{folder}/{c:02d}-{what}") for what in ("keys", "values")]
                at = chunk == c
                for f, column in zip(files, batch.columns[1:], strict=True):
                    f.write(np.ascontiguousarray(column.to_numpy()[at]).tobytes())
        for f in files:
            f.close()
        yield from ()

    chunks = rows.mapInArrow(dealt, "chunk int, key long, value double").repartition(1 << CHUNK_BITS, "chunk").sortWithinPartitions("chunk", "key")
    chunks.mapInArrow(write, "chunk int").write.format("noop").mode("overwrite").save()
    return Table(folder)


def _labels(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    return known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).cast("int").alias("label"))


def curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a little ridge on the slope."""
    x = np.stack([z, np.ones_like(z)], 1)
    w, ridge = np.zeros(2), np.diag([RIDGE * len(y), 1e-9])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = shared.stored(_labels(labels, label_col, id_col), "labels")
    # a quarter of the labels, by another hash, and at most a bounded number, is for the curve
    curve_ids = known.where(F.pmod(F.xxhash64("__id"), F.lit(4)) == 0).orderBy(F.xxhash64("__id", F.lit(1)), "__id").limit(CURVE_IDS)
    curve_ids = shared.stored(curve_ids, "curve-ids")
    train = shared.stored(known.join(curve_ids.select("__id"), "__id", "left_anti"), "train-ids")
    at_hand = F.broadcast(train) if train.count() <= BROADCAST_IDS else train
    table = table_of(docs.join(at_hand, F.col("doc_id") == F.col("__id")).select("label", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(table.opened())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(weights.evidence(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "evidence"])

    found = shared.stored(docs.mapInArrow(run, "doc_id long, evidence double"), "evidence")
    pairs = found.join(F.broadcast(curve_ids), F.col("doc_id") == F.col("__id")).groupBy("__id").agg(F.min("label").alias("label"), F.min("evidence").alias("evidence"))
    pairs = pairs.toPandas()  # at most CURVE_IDS rows of three numbers
    y, z = pairs["label"].to_numpy(float), np.log(pairs["evidence"].to_numpy(float) + FLOOR)
    if min(y.sum(), len(y) - y.sum()) >= 2:
        slope, start = curve(z, y)
        score = 1 / (1 + F.exp(-(F.log(F.col("evidence") + FLOOR) * slope + start)))
    else:
        share = known.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
        score = F.lit((share.t + 0.5) / (share.n + 1))
    out = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.cast("double").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
