"""Near-duplicate documents by HyperMinHash sketches, banding and confirmation on full sets (operator 7).

A document is the set of its distinct five-word shingles (64-bit hashes). Equal sets are one node. A node's sketch has
128 registers; a shingle's top bits choose the register, which keeps the least hash as the number of its leading
zeros and ten mantissa bits (16 bits in all). Four registers are a band; nodes with an equal band meet in a bucket.

1. In each bucket every node is paired with the least node only, so a bucket of any size gives as many pairs as nodes.
2. Pairs whose Jaccard estimate, corrected for chance collisions of registers, lies ``SIGMAS`` standard deviations
   below the threshold are dropped; the others are confirmed on full shingle sets and linked.
3. Buckets that still hold several components are compared pair by pair on sketches, in blocks of bounded size and across
   components only. Nodes with a pair that passes meet once more with their full sets, in the first band that
   the pair shares; a block gives each node the least one that it reaches, never a list of pairs.

A pair at Jaccard 0.85 misses all 32 bands with probability 1e-10. Definitions: null or empty texts have no shingles
and link with nothing (component_id is their own id); with fewer than five words the sequence is the one shingle. Every row
is a document, also where rows share an id. Null ids are never the least: such a row has the least other id of its
component, or null, and is not kept. Texts of any length are read whole. Other columns, whatever their names, stay as they are in
``keep_first`` and are not read. An empty table gives no rows.

Scale: texts are shuffled once, for nodes in candidate pairs; all else moves narrow rows. Joins on nodes and
buckets are left to Spark, which splits hot keys; no list of documents, links or components reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm import components, shared

SHINGLE_WORDS = 5
REGISTERS = 128
REGISTER_BITS = 7
MANTISSA_BITS = 10
BAND = 4
EMPTY = 0xFFFF
SIGMAS = 5.0
BLOCK = 512
SET_BLOCK, SET_BLOCK_BYTES = 256, 4 << 20
COLUMNS = 8192
KEPT_BYTES = 32 << 20
"""Memory of the word hashes that a task keeps, with ``ENTRY_BYTES`` a word besides its letters; they go when it ends."""
ENTRY_BYTES = 160

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE_WORDS + 1)], np.uint64)


class _WordHashes(dict):
    """Hashes of words, kept up to a number of bytes."""

    def __init__(self):
        super().__init__()
        self.left = KEPT_BYTES

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        size = len(word) + ENTRY_BYTES
        if size <= self.left:
            self.left -= size
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, kept: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower and bytes.split touch ASCII letters and white space only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    kept = _WordHashes() if kept is None else kept
    h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE_WORDS:
        return _mixed((h * _POWERS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - SHINGLE_WORDS + 1
    total = h[:n] * _POWERS[0]
    for k in range(1, SHINGLE_WORDS):
        total += h[k : k + n] * _POWERS[k]
    return np.unique(_mixed(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of sorted hashes: as a float a hash has its leading zeros as exponent, so order is kept."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    register = hashes >> np.uint64(64 - REGISTER_BITS)
    starts = np.flatnonzero(np.r_[True, register[1:] != register[:-1]])
    value = np.maximum(_mixed(hashes + np.uint64(0xD1B54A32D192ED03)), np.uint64(1)).astype(np.float64).view(np.uint64)
    code = np.minimum((value >> np.uint64(52 - MANTISSA_BITS)) - np.uint64(1023 << MANTISSA_BITS), np.uint64(EMPTY - 1))
    out[register[starts].astype(np.int64)] = np.minimum.reduceat(code, starts)
    return out


def similarity(match: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from equal registers, registers used by either, and both set sizes.

    Two different minima with rates n and m agree in exponent and mantissa with probability
    0.7213 * 2^-bits * nm / (n + m)^2, where 0.7213 is the mean of 2^-x for x from 0 to 1.
    """
    chance = 0.7213 * 2.0**-MANTISSA_BITS * n * m / np.square(n + m, dtype=np.float64)
    return np.clip((match / np.maximum(used, 1) - chance) / (1 - chance), 0, 1)


def passes(match: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair may reach the threshold: sizes allow it and the estimate is not clearly below it."""
    t = percent / 100
    slack = SIGMAS * np.sqrt(t * (1 - t) / np.maximum(used, 1))
    n, m = n.astype(np.float64), m.astype(np.float64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (similarity(match, used, n, m) >= t - slack)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("regs", pa.binary()), ("text_hash", pa.int64())])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sizes, nodes, regs = [], [], []
            for text in part.column(1).to_pylist():
                s = shingles(text, kept)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(regs, pa.binary()), part.column(2)], schema=SIGNATURE)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hashes) of texts; a text with another set has the same hash by chance."""
    schema = pa.schema([("node", pa.binary()), ("hashes", pa.large_binary())])
    kept = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(t, kept) for t in part.column(1).to_pylist()]
            rows = [(k, s.tobytes()) for k, s in zip(part.column(0).to_pylist(), sets, strict=True) if xxhash.xxh3_128_digest(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.large_binary())], schema=schema)


EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _registers(batch.column(2)), _registers(batch.column(4))
            used = ((x != EMPTY) | (y != EMPTY)).sum(1)
            match = ((x == y) & (x != EMPTY)).sum(1)
            keep = passes(match, used, batch.column(3).to_numpy(), batch.column(5).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], schema=EDGE)

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = sorted((p, q), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], schema=EDGE)

    return run


class _Block:
    """Rows of one block: the pairs in question are across components, of different sides, and without the bucket's centre."""

    def __init__(self, rows: list[dict]):
        self.rows, self.band = rows, rows[0]["band"]
        self.regs = np.frombuffer(b"".join(r["regs"] for r in rows), np.uint16).reshape(-1, REGISTERS)
        self.bands = self.regs.reshape(len(rows), -1, BAND)
        self.filled = self.regs != EMPTY
        self.band_filled = self.filled.reshape(self.bands.shape).any(2)
        self.sizes = np.array([r["n_shingles"] for r in rows])
        self.roots = np.unique(np.array([r["root"] for r in rows], object), return_inverse=True)[1]
        self.side = np.array([r["side"] for r in rows])
        self.free = np.array([r["node"] != r["centre"] for r in rows])
        self.whole = rows[0]["bi"] == rows[0]["bj"]

    def candidates(self, i: int, percent: int) -> np.ndarray:
        """Partners of row i that may reach the threshold and share no earlier band with it."""
        behind = np.arange(len(self.rows)) > i if self.whole else self.side == 1
        j = np.flatnonzero(self.free & behind & (self.roots != self.roots[i]))
        match = ((self.regs[i] == self.regs[j]) & self.filled[j]).sum(1)
        used = (self.filled[i] | self.filled[j]).sum(1)
        j = j[passes(match, used, np.full(len(j), self.sizes[i]), self.sizes[j], percent)]
        shared_bands = (self.bands[i] == self.bands[j]).all(2) & self.band_filled[i]
        return j[shared_bands.argmax(1) == self.band]

    def pairs(self, percent: int) -> np.ndarray:
        """Matrix of the pairs in question."""
        out = np.zeros((len(self.rows), len(self.rows)), bool)
        for i in np.flatnonzero(self.free & (self.side == 0)):
            out[i, self.candidates(i, percent)] = True
        return out | out.T


def _by_bucket(rows: list[dict]) -> Iterator[list[dict]]:
    """Rows of a block by band; they differ only if digests of buckets collide."""
    for band in {r["band"] for r in rows}:
        some = [r for r in rows if r["band"] == band]
        if len(some) > 1:
            yield some


def _flagged(percent: int):
    """(bucket, node) of nodes with a pair in question."""
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (x for block in shared.runs(batches, 3) for x in _by_bucket(block)):
            some = np.flatnonzero(_Block(rows).pairs(percent).any(1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([rows[0]["bucket"]] * len(some)), pa.array([rows[i]["node"] for i in some], pa.binary())], schema=schema)

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over the hashes that occur twice."""
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    twice = count[place] > 1
    owner, column = owner[twice], column[place[twice]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def least_reached(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row that it reaches."""
    least = np.arange(len(linked))
    while True:
        step = np.minimum(least, np.where(linked, least[None, :], len(linked)).min(1, initial=len(linked)))
        if (step == least).all():
            return least
        least = step


def _linked_in_blocks(percent: int):
    """Edges from each node to the least one that it reaches by pairs confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (x for block in shared.runs(batches, 3) for x in _by_bucket(block)):
            pairs = _Block(rows).pairs(percent)
            if not pairs.any():
                continue
            sets = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
            both, size = _intersections(sets), np.array([len(s) for s in sets])
            linked = pairs & (100 * both >= percent * (size[:, None] + size[None, :] - both))
            least = least_reached(linked)
            some = np.flatnonzero(least != np.arange(len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array([rows[i]["node"] for i in some], pa.binary()), pa.array([rows[least[i]]["node"] for i in some], pa.binary())], schema=EDGE)

    return run


def _blocks(rows: DataFrame, count: Column, *columns: str) -> DataFrame:
    """Rows of a bucket dealt to ``count`` parts, each pair of parts a block, sorted by block."""
    rows = rows.withColumn("_n", F.greatest(F.ceil(count), F.lit(1)).cast("int")).withColumn("_at", F.pmod(F.xxhash64("node"), "_n").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = (F.col("_at") > F.col("_other")).cast("int").alias("side")
    rows = rows.select("bucket", F.least("_at", "_other").alias("bi"), F.greatest("_at", "_other").alias("bj"), side, *columns)
    return rows.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of wanted nodes, from the text of one of their documents each; rows with equal id and text count once."""
    owners = nodes.join(wanted, "node").select("node", F.col("id").alias("owner"), F.col("text_hash").alias("owned"))
    texts = docs.join(owners, F.col("id").eqNullSafe(F.col("owner")) & (F.col("text_hash") == F.col("owned"))).select("node", "text")
    sets = texts.distinct().mapInArrow(_full_sets, "node binary, hashes binary")
    return shared.stored(sets, "sets")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links have 100 * intersection >= percent * union."""
    signed, found = _grouped(docs, percent, id_col, text_col)
    id_ = F.col("doc_id")
    grouped = signed.where("node is not null").join(found, "node").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("node is null").select("doc_id", "n_shingles", id_.alias("component_id"))
    return grouped.union(alone).withColumn("kept", F.coalesce(id_ == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: one per group of near copies, with the smallest id, and all without shingles.

    Null ids come after all others; of rows with that id, the one with the least hash of its text stays, and equal rows
    of it count as one.
    """
    signed, found = _grouped(docs, percent, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = signed.where("node is not null").join(found, "node").groupBy("root").agg(F.min(order).alias("x"))
    at = shared.unused(docs, "dedup_key")
    first = first.select(F.struct(F.col("x.doc_id").alias("i"), F.col("x.text_hash").alias("h")).alias(at))
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    key = F.struct(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("h"))
    kept = docs.where(~wordless).withColumn(at, key).join(first, at).dropDuplicates([at]).drop(at)
    return kept.union(docs.where(wordless))


def _grouped(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Signatures (doc_id, n_shingles, node, regs, text_hash) of every row, and (node, root, component_id)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed = shared.stored(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, node binary, regs binary, text_hash long"), "signatures")
    filled = signed.where("node is not null")
    # the text of the chosen document too: ids may be null or shared by many rows
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text_hash")).alias("x")
    nodes = shared.stored(filled.groupBy("node", "regs", "n_shingles").agg(chosen).select("node", "regs", "n_shingles", "x.id", "x.text_hash"), "nodes")

    width = 2 * BAND
    band = lambda b: F.struct(b.alias("band"), F.substring("regs", b * width + 1, F.lit(width)).alias("bits"))
    bands = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), band)).alias("x"))
    used = F.col("x.bits") != F.lit(b"\xff" * width)
    members = bands.where(used).select(F.xxhash64("x.band", "x.bits").alias("bucket"), "x.band", "node")
    # grouped results are stored before they are joined, so that Spark can split a hot bucket on either side
    buckets = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1")
    members = shared.stored(members.join(shared.stored(buckets, "buckets"), "bucket"), "members")

    sketches = nodes.select("node", "regs", "n_shingles")
    pairs = members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    both = pairs.join(sketches.toDF("a", "x", "n"), "a").join(sketches.toDF("b", "y", "m"), "b").select("a", "b", "x", "n", "y", "m")
    pairs = shared.stored(both.mapInArrow(_estimated(percent), "a binary, b binary"), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(docs, nodes, ends)
    both = pairs.join(sets.toDF("a", "hashes_a"), "a").join(sets.toDF("b", "hashes_b"), "b").select("a", "b", "hashes_a", "hashes_b")
    links = shared.stored(both.mapInArrow(_confirmed(percent), "a binary, b binary"), "links")

    # enough to tell apart what is not yet linked: a bucket of one component costs nothing below
    roots = components.connected_components(links, rounds=1).groupBy("node").agg(F.min("root").alias("root"))
    rest = members.where("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rest.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
    rest = shared.stored(rest.join(shared.stored(mixed, "mixed"), "bucket").join(sketches, "node"), "rest")
    columns = ("band", "node", "root", "centre", "n_shingles", "regs")
    flagged = _blocks(rest, F.col("size") / BLOCK, *columns).mapInArrow(_flagged(percent), "bucket long, node binary").distinct()
    flagged = shared.stored(flagged, "flagged")
    if not flagged.isEmpty():
        more = flagged.select("node").distinct().join(sets.select("node"), "node", "left_anti")
        sets = sets.union(_sets_of(docs, nodes, more))
        rest = rest.drop("size").join(flagged, ["bucket", "node"])
        totals = rest.groupBy("bucket").agg(F.greatest(F.count("*") / SET_BLOCK, F.sum("n_shingles") * 8 / SET_BLOCK_BYTES).alias("parts"))
        rest = rest.join(shared.stored(totals, "totals"), "bucket").join(sets, "node")
        more = _blocks(rest, F.col("parts"), *columns, "hashes").mapInArrow(_linked_in_blocks(percent), "a binary, b binary")
        links = links.union(shared.stored(more, "links"))

    return signed, components.least_member(nodes.select("node", "id"), links)
