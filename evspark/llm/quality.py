"""Quality scores by regularised quadratic discriminant analysis (operator 5).

Each class is a normal density over transformed statistics of the text. A class covariance is shrunk towards the
covariance of all rows within classes and a multiple of the identity; its Cholesky factor and log-determinant are kept in the
model, so a score costs two small triangular products: the logistic of the difference of log densities and log priors.

Definitions: null and empty texts have the statistics of an empty text and get a score. Rows are kept as they are,
repeated ids too; a null id is not held out and has no label. An id with several labels takes the smallest. A class without
training rows, or labels without rows, give the constant score of the prior (0.5 without any). Label, language,
source and id are never inputs of a score. Texts of any length are read whole. Other columns, whatever their names, stay as they are in
``keep_good`` and are not read. An empty table gives no rows.

Scale: statistics are one pass over texts without exchange; only (id, statistics) meet labels. The fit is one grouped sum
of 15 + 105 products per class over all training rows; the model is a few kilobytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm import shared

FEATURES = ("log_bytes", "upper", "digit", "bang", "symbol", "bar", "stop", "space", "non_ascii", "word_length", "distinct", "top_word", "twice", "lines")
SHRINK_TO_POOLED = 0.1
SHRINK_TO_IDENTITY = 0.02
FIT_IDS = 20_000
"""Most labelled ids that ``keep_good`` fits on."""

# Bytes of each kind.
_KINDS = {"upper": bytes(range(65, 91)), "digit": b"0123456789", "bang": b"!?", "symbol": b"#$%&*@^~+=<>_\\", "bar": b"|/", "stop": b".,;:", "space": b" \t\n\r"}


def statistics(text: str | None) -> list[float]:
    """Transformed statistics, in the order of FEATURES; shares enter as square roots."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    share = {k: math.sqrt(counts[list(v)].sum() / size) for k, v in _KINDS.items()}
    words = raw.lower().split()
    n = max(len(words), 1)
    often = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        math.log1p(len(raw)), share["upper"], share["digit"], share["bang"], share["symbol"], share["bar"], share["stop"], share["space"],
        math.sqrt(counts[128:].sum() / size), math.log1p((len(raw) - counts[[9, 10, 13, 32]].sum()) / n),
        math.log1p(len(often)) / math.log1p(n), math.sqrt(max(often.values(), default=0) / n),
        math.sqrt(sum(map(eq, words, words[1:])) / n), len(set(lines)) / max(len(lines), 1),
    ]


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse of the Cholesky factor, log-determinant of the factor, log prior."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        if not len(self.means):
            return np.full(len(x), 1 / (1 + np.exp(self.log_prior[0] - self.log_prior[1])))
        distance = np.stack([np.square((x - m) @ w.T).sum(1) for m, w in zip(self.means, self.whiten, strict=True)])
        log_density = -0.5 * distance - self.log_det[:, None] + self.log_prior[:, None]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t) for t in part.column(1).to_pylist()], schema.field(1).type)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


def fit(rows: DataFrame) -> Model:
    """Model from (stats, label 0 or 1)."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.element_at("stats", i + 1) for i in range(d)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i, j in pairs]
    by_class = {r.label: r for r in rows.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()}  # two rows
    n = np.array([by_class[c].n if c in by_class else 0 for c in (0, 1)], float)
    if n.min() < 2:
        share = (n + 0.5) / (n.sum() + 1)
        return Model(np.empty(0), np.empty(0), np.empty(0), np.log(share))
    s = np.array([by_class[c].s for c in (0, 1)])
    means = s[:, :d] / n[:, None]
    scatter = np.zeros((2, d, d))
    for k, (i, j) in enumerate(pairs):
        scatter[:, i, j] = scatter[:, j, i] = s[:, d + k] - n * means[:, i] * means[:, j]
    pooled = scatter.sum(0) / n.sum()
    mild = pooled + np.eye(d) * (np.trace(pooled) / d * 1e-3 + 1e-9)
    target = (1 - SHRINK_TO_IDENTITY) * mild + SHRINK_TO_IDENTITY * np.eye(d) * np.trace(mild) / d
    factors = np.linalg.cholesky((1 - SHRINK_TO_POOLED) * scatter / n[:, None, None] + SHRINK_TO_POOLED * target)
    whiten = np.stack([np.linalg.solve(f, np.eye(d)) for f in factors])
    return Model(means, whiten, np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1), np.log(n / n.sum()))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def model_of(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """Model from the statistics of labelled rows that are not held out."""
    label = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"))
    return fit(stats.join(label, "doc_id").select("stats", "label"))


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the model is fitted on labelled rows that are not held out."""
    stats = shared.stored(text_statistics(docs, id_col, text_col), "statistics")
    model = model_of(stats, labels, label_col, id_col)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=schema)

    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "stats").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def fit_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", most: int = FIT_IDS) -> DataFrame:
    """Rows of ``docs`` that a fit may use: of the labelled ids that are not held out, the ``most`` with the least hash.

    The ids are at most ``most`` numbers, so they are broadcast and no text is shuffled.
    """
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    i = shared.unused(docs, "fit_id")
    ids = known.select(F.col(id_col).cast("long").alias(i)).distinct().orderBy(F.xxhash64(i), i).limit(most)
    return docs.join(F.broadcast(ids), F.col(id_col).cast("long") == F.col(i), "left_semi")


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = FIT_IDS) -> DataFrame:
    """Rows of ``docs`` with a score of 0.5 or more: the model is fitted first, on the rows of up to ``most`` labelled ids,
    then texts are scored in place, without a join. Rows, repeated ones too, and columns stay as they are."""
    model = model_of(text_statistics(fit_rows(docs, labels, label_col, id_col, most), id_col, text_col), labels, label_col, id_col)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, 1024).to_pylist() for at in range(0, len(texts), 1024))
        kept = [model.scores(np.array([statistics(t) for t in part], float)) >= 0.5 for part in parts]
        return pa.array(np.concatenate(kept) if kept else np.empty(0, bool))

    return docs.where(good(F.col(text_col)))
