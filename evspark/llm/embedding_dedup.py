"""Near-duplicate vectors by randomised-rotation binary codes (operator 2).

A unit vector o is padded with zeros, rotated by a random orthonormal matrix P to D dimensions, and stored as its signs x
(D bits). Two vectors at an angle differ in a bit with probability angle / pi, so the bits in which ``WORD_BITS`` of them differ are binomial.
Pairs that differ in more bits than one at the threshold does but with probability ``FAR`` are dropped; the others are computed in double
precision. With the correction factor f = <x, P o> / sqrt(D), <x, P q> / (sqrt(D) f) is an unbiased estimate of <o, q> for another unit vector
q (:func:`estimate`).

Candidates come from the codes too: k bits are a band, and vectors of one label with an equal band meet in a bucket. k grows with
the logarithm of the number of vectors, so a chance bucket holds about ``BUCKET`` of them; the number of bands follows from
``MISS``, the probability that a pair exactly at the threshold meets nowhere. A pair is counted in the first band that it shares.

There are many bands, so vectors are not dealt to buckets. Codes and vectors lie once in the shared folder, in chunks, the codes band by band.
A task takes a band and a range of buckets, reads the band of all chunks, sorts what is in its range and opens vectors for pairs of near codes only.
Buckets above ``HOT_BLOCKS`` blocks are compared block by block, in a task each. A task gives one row per vector (links counted, least
vector reached), so large groups of near copies never turn into lists of pairs.

Definitions: null, empty, zero vectors and vectors with null or non-finite components, and rows without a label, link with nothing.
Vectors of different length are never compared. Equal vectors of a label are one node, each of its rows
linking with the others. Rows that share an id are separate vectors. Null ids are never the least. An empty table gives no rows. Vectors of any length are read whole; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm import components, shared
from evspark.llm.bits import mixed

SEED = 20240229
SIGMAS = 6.5
MISS, FAR = 1e-9, 1e-10
BUCKET = 64
LEAST_BITS, MOST_BITS = 8, 32
WORD_BITS = 128
BLOCK, HOT_BLOCKS = 1024, 8
CHUNK, ROTATED = 1 << 16, 1 << 10
"""Vectors in a chunk of files, and vectors rotated at once."""
UNIT = 2 << 20
"""Vectors that a task sorts at once."""
SORTED, PAIRS = 1 << 18, 1 << 16
"""Sorted vectors whose pairs are looked for at once, and pairs computed at once."""


def plan_bands(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a band, bands) for ``n`` vectors."""
    bits = min(max(math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 0, LEAST_BITS), MOST_BITS)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


@lru_cache(maxsize=4)
def rotation(dim: int, width: int) -> np.ndarray:
    """width x dim matrix with orthonormal columns: a random rotation, of which only the unpadded columns are needed."""
    gauss = np.random.Generator(np.random.PCG64(SEED)).standard_normal((width, dim))
    q, r = np.linalg.qr(gauss)
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (rows x width) and correction factors of unit vectors."""
    rotated = unit @ rotation(unit.shape[1], width).T
    return rotated > 0, np.abs(rotated).sum(1) / math.sqrt(width)


def estimate(bits: np.ndarray, factor: np.ndarray, other: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded vectors (rows) with unit vectors (columns), and the standard error of each row."""
    rotated = other @ rotation(other.shape[1], width).T
    signs = np.where(bits, 1.0, -1.0)
    value = signs @ rotated.T / (math.sqrt(width) * factor[:, None])
    return value, np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (width - 1))


def most_differing(bits: int, threshold: float) -> int:
    """The bits that differ at most in a pair at the threshold, but with probability ``FAR``."""
    p = math.acos(threshold) / math.pi
    tail, h = 0.0, bits
    while h > 0 and (tail := tail + math.comb(bits, h) * p**h * (1 - p) ** (bits - h)) <= FAR:
        h -= 1
    return h


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links have cosine >= threshold and equal labels."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = shared.stored(vectors.mapInArrow(_digests, "id long, node binary"), "rows")
    valid = rows.where("node is not null")
    bits, bands = plan_bands(valid.agg(F.count_distinct("node")).first()[0], threshold)
    distinct = vectors.mapInArrow(_packed, "id long, node binary, label string, dim int, vector binary")
    distinct = distinct.groupBy("node", "label", "dim", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    folder = shared.new_folder(spark, "codes")
    shared.make_folder(folder)
    written = distinct.select("node", "label", "dim", "vector", "id", "copies").mapInArrow(_chunks_of(folder, bits, bands), "node binary, row long, id long, copies long, file string, size long")
    nodes = shared.stored(written, "nodes")
    chunks = [(r["row"], r["file"], r["size"]) for r in nodes.where("file is not null").select("row", "file", "size").orderBy("row").collect()]
    codes = Codes(folder, chunks, bits, bands, threshold, BLOCK, HOT_BLOCKS * BLOCK, max(1, math.ceil(sum(c[2] for c in chunks) / UNIT)))
    units = bands * codes.ranges if chunks else 0
    found = shared.stored(spark.range(0, units, 1, max(units, 1)).mapInArrow(codes.compare, FOUND), "links")
    hot = found.where("row is null").select("band", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK))).alias("block"))
    blocks = hot.count()
    if blocks:
        found = found.union(shared.stored(hot.repartition(blocks).mapInArrow(codes.compare_block, FOUND), "links"))
    found = found.where("row is not null")
    per_row = found.groupBy("row").agg(F.sum("links").alias("links"))
    edges = found.where("reached <> row").select(F.col("row").alias("a"), F.col("reached").alias("b"))
    least = components.least_member(nodes.select(F.col("row").alias("node"), "id"), edges).select(F.col("node").alias("row"), "component_id")
    facts = nodes.select("node", "row", "copies").join(per_row, "row", "left").join(least, "row")
    facts = facts.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = valid.join(facts, "node").select("id", "n_links", "component_id")
    alone = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[bytes | None, np.ndarray | None]]:
    """Digest and vector of each row; nulls for rows that link with nothing."""
    lists = batch.column(2)
    offsets, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
    # numbers up to each place: those that are not finite, null being NaN here, and those that are not zero
    bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), flat != 0))
    begin, end = offsets[:-1], offsets[1:]
    good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[begin] == bad[end]) & (some[begin] < some[end])
    for label, b, e, ok in zip(batch.column(1).to_pylist(), begin.tolist(), end.tolist(), good.tolist(), strict=True):
        if label is None or not ok:
            yield None, None
        else:
            yield xxhash.xxh3_128_digest(label.encode("utf-8", "surrogatepass") + b"\0" + flat[b:e].tobytes()), flat[b:e]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([node for node, _ in _each(batch)], pa.binary())], names=["id", "node"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that may link, their vectors in single precision if that is all they have."""
    for batch in batches:
        kept, nodes, dims, data = [], [], [], []
        for k, (node, x) in enumerate(_each(batch)):
            if node is not None:
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                kept.append(k)
                nodes.append(node)
                dims.append(len(x))
                data.append((short if (short == x).all() else x).tobytes())
        some = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(nodes, pa.binary()), some.column(1), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["id", "node", "label", "dim", "vector"])


NODE = pa.schema([("node", pa.binary()), ("row", pa.int64()), ("id", pa.int64()), ("copies", pa.int64()), ("file", pa.string()), ("size", pa.int64())])
FOUND = "row long, links long, reached long, band int, key long, size long"
FOUND_SCHEMA = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("reached", pa.int64()), ("band", pa.int32()), ("key", pa.int64()), ("size", pa.int64())])


def _chunks_of(folder: str, bits: int, bands: int):
    """Writes the rows of a task as chunks of files; the first row of each chunk names its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                if held and sum(b.num_rows for b in held) + part.num_rows > CHUNK:
                    yield (out := _written(folder, held, bits, bands, row))
                    row += out.num_rows
                    held = []
                held.append(part)
        if sum(b.num_rows for b in held):
            yield _written(folder, held, bits, bands, row)

    return run


def _written(folder: str, batches: list[pa.RecordBatch], bits: int, bands: int, row: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    dims, data = rows["dim"].to_numpy(), rows["vector"].to_pylist()
    wide = np.array([len(v) // d == 8 for v, d in zip(data, dims.tolist(), strict=True)])
    kind = [xxhash.xxh3_128_digest(f"{label}\n{dim}".encode("utf-8", "surrogatepass")) for label, dim in zip(rows["label"].to_pylist(), dims.tolist(), strict=True)]
    words = np.zeros((len(data), WORD_BITS // 8), np.uint8)
    code = np.zeros((bands, len(data), (bits + 7) // 8), np.uint8)
    for dim in np.unique(dims).tolist():
        # by length, so that each matrix is rotated at once
        same = np.flatnonzero(dims == dim)
        for at in range(0, len(same), ROTATED):
            some = same[at : at + ROTATED]
            x = np.stack([_vector(data[k], wide[k]) for k in some])
            signs, _ = encode(x / np.linalg.norm(x, axis=1)[:, None], max(bits * bands, dim, 2))
            head = np.packbits(signs[:, : min(bits * bands, WORD_BITS)], axis=1)
            words[some, : head.shape[1]] = head
            code[:, some] = np.packbits(signs[:, : bits * bands].reshape(len(some), bands, bits), axis=2).transpose(1, 0, 2)
    name = uuid.uuid4().hex
    ends = np.cumsum([0, *map(len, data)])
    for ending, parts in (("c", (b"".join(kind), words, rows["copies"].to_numpy().astype(np.int64), wide.astype(np.uint8), ends, code)), ("v", data)):
        file = shared.AtomicFile(f"{folder}/{name}.{ending}")
        for part in parts:
            file.write(part if isinstance(part, bytes) else part.tobytes())
        file.close()
    n = len(data)
    first = np.arange(n) == 0
    return pa.RecordBatch.from_arrays(
        [rows["node"].chunk(0), pa.array(np.arange(row, row + n)), rows["id"].chunk(0), rows["copies"].chunk(0), pa.array(np.where(first, name, None), pa.string()), pa.array(np.where(first, n, None), pa.int64())], schema=NODE
    )


def _vector(data: bytes | np.ndarray, wide: bool) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.float32).astype(np.float64)


class _Chunk:
    """The mapped files of a chunk."""

    def __init__(self, folder: str, name: str, n: int, bits: int, bands: int):
        self.folder, self.name, self.n = folder, name, n
        data, at = np.frombuffer(shared.mapped(f"{folder}/{name}.c"), np.uint8), 0

        def take(size: int, kind: type) -> np.ndarray:
            nonlocal at
            at += size
            # copied if its place does not suit the numbers
            return np.frombuffer(data[at - size : at], kind)

        self.kind = take(16 * n, np.uint64).reshape(n, 2)
        self.words = take(WORD_BITS // 8 * n, np.uint64).reshape(n, -1)
        self.copies, self.wide, self.ends = take(8 * n, np.int64), take(n, np.uint8), take(8 * (n + 1), np.int64)
        self.code = data[at:].reshape(bands, n, (bits + 7) // 8)

    def band(self, band: int) -> np.ndarray:
        """The band's bits as numbers."""
        return sum((self.code[band, :, k].astype(np.uint64) << np.uint64(8 * k) for k in range(self.code.shape[2])), np.uint64(0))

    def keys(self, band: int) -> np.ndarray:
        """Numbers of the buckets."""
        return mixed(self.kind[:, 0] ^ mixed(self.band(band) + np.uint64(1)))

    def vectors(self, rows: np.ndarray) -> list[np.ndarray]:
        data = np.frombuffer(shared.mapped(f"{self.folder}/{self.name}.v"), np.uint8)
        return [_vector(data[b:e], w) for b, e, w in zip(self.ends[rows].tolist(), self.ends[rows + 1].tolist(), self.wide[rows].tolist(), strict=True)]


@dataclass(frozen=True)
class Codes:
    """The written codes and vectors, and how tasks compare them."""

    folder: str
    chunks: list[tuple[int, str, int]]
    bits: int
    bands: int
    threshold: float
    block: int
    hot: int
    ranges: int

    def compare(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a band in the buckets of a range; buckets too large for that are named."""
        opened = None
        for unit in (u for b in batches for u in b.column(0).to_pylist()):
            opened = opened or [_Chunk(self.folder, name, n, self.bits, self.bands) for _, name, n in self.chunks]
            band, r = divmod(unit, self.ranges)
            keys, places = [], []
            for c, chunk in enumerate(opened):
                k = chunk.keys(band)
                own = np.flatnonzero(k % np.uint64(self.ranges) == r) if self.ranges > 1 else np.arange(chunk.n)
                keys.append(k[own])
                places.append((c << 32) + own)
            keys, places = np.concatenate(keys), np.concatenate(places)
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            sizes = np.diff(begin)
            for k in np.flatnonzero(sizes > self.hot):
                yield pa.RecordBatch.from_pylist([{"band": band, "key": int(keys[begin[k]].view(np.int64)), "size": int(sizes[k])}], schema=FOUND_SCHEMA)
            met = np.repeat((sizes > 1) & (sizes <= self.hot), sizes)
            keys, places = keys[met], places[met]
            links = _Links(self, opened, places, band)
            at = 0
            while at < len(keys):
                # a bucket is not cut
                to = int(np.searchsorted(keys, keys[min(at + SORTED, len(keys)) - 1], "right"))
                part, alive, d = keys[at:to], np.arange(to - at), 0
                while len(alive):
                    d += 1
                    alive = alive[: np.searchsorted(alive, len(part) - d)]
                    alive = alive[part[alive] == part[alive + d]]
                    links.try_pairs(alive + at, alive + at + d)
                at = to
            yield from links.rows()

    def compare_block(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between a block of a bucket and what follows it there."""
        opened = None
        for unit in (u for b in batches for u in b.to_pylist()):
            opened = opened or [_Chunk(self.folder, name, n, self.bits, self.bands) for _, name, n in self.chunks]
            key = np.int64(unit["key"]).view(np.uint64)
            places = np.concatenate([(c << 32) + np.flatnonzero(chunk.keys(unit["band"]) == key) for c, chunk in enumerate(opened)])
            begin = unit["block"] * self.block
            links = _Links(self, opened, places[begin:], unit["band"])
            for p in range(min(self.block, len(places) - begin)):
                for at in range(p + 1, len(places) - begin, SORTED):
                    other = np.arange(at, min(at + SORTED, len(places) - begin))
                    links.try_pairs(np.full(len(other), p), other)
            yield from links.rows()


class _Links:
    """Links among the vectors at ``places`` (chunk and row), in order, counted in one band."""

    def __init__(self, codes: Codes, opened: list[_Chunk], places: np.ndarray, band: int):
        self.codes, self.opened, self.places, self.band = codes, opened, places, band
        self.most = most_differing(min(codes.bits * codes.bands, WORD_BITS), codes.threshold)
        self.words = self._gathered(lambda c, rows: c.words[rows], places, np.empty((0, WORD_BITS // 64), np.uint64))
        self.copies = self._gathered(lambda c, rows: c.copies[rows], places, np.empty(0, np.int64))
        self.links, self.root = np.zeros(len(places), np.int64), np.arange(len(places))
        self.waiting, self.held = [], 0

    def _gathered(self, of, places: np.ndarray, none: np.ndarray) -> np.ndarray:
        """What ``of`` finds in the chunks, for places in any order."""
        if not len(places):
            return none
        order = np.argsort(places, kind="stable")
        chunk, row = places[order] >> 32, places[order] & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(chunk)) + 1
        found = np.concatenate([of(self.opened[c[0]], r) for c, r in zip(np.split(chunk, cuts), np.split(row, cuts), strict=True)])
        out = np.empty_like(found)
        out[order] = found
        return out

    def try_pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(self.words[i] ^ self.words[j]).sum(1, dtype=np.int64) <= self.most
        if near.any():
            self.waiting.append((i[near], j[near]))
            self.held += int(near.sum())
            if self.held >= PAIRS:
                self._compute()

    def _compute(self) -> None:
        i, j = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        for at in range(0, len(i), PAIRS):
            self._link(i[at : at + PAIRS], j[at : at + PAIRS])

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        places = self.places[used]
        kind = self._gathered(lambda c, rows: c.kind[rows], places, None)
        left = np.flatnonzero((kind[a] == kind[b]).all(1) & self._same(self.band, places, a, b))
        # the pair counts where it shares its first band
        for band in range(self.band):
            if not len(left):
                return
            left = left[~self._same(band, places, a[left], b[left])]
        for part in np.array_split(left, max(1, math.ceil(len(left) / 8192))):
            if len(part):
                self._exact(i[part], j[part])

    def _same(self, band: int, places: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = self._gathered(lambda c, rows: c.code[band, rows], places, None)
        return (code[a] == code[b]).all(1)

    def _exact(self, i: np.ndarray, j: np.ndarray) -> None:
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        order = np.argsort(self.places[used], kind="stable")
        places = self.places[used][order]
        chunk, row = places >> 32, places & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(chunk)) + 1
        vectors = [v for c, r in zip(np.split(chunk, cuts), np.split(row, cuts), strict=True) for v in self.opened[c[0]].vectors(r)]
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        a, b = where[at[: len(i)]], where[at[len(i) :]]
        lengths = np.array([len(v) for v in vectors])
        for dim in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == dim)
            x, local = np.stack([vectors[k] for k in of]), np.zeros(len(vectors), np.int64)
            local[of] = np.arange(len(of))
            norm = np.linalg.norm(x, axis=1)
            some = np.flatnonzero(lengths[a] == dim)
            p, q = local[a[some]], local[b[some]]
            linked = some[np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= self.codes.threshold]
            self._count(i[linked], j[linked])

    def _count(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links, i, self.copies[j])
        np.add.at(self.links, j, self.copies[i])
        while True:
            a, b = self._roots(i), self._roots(j)
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])

    def _roots(self, i: np.ndarray) -> np.ndarray:
        r = self.root[i]
        while (self.root[r] != r).any():
            r = self.root[r]
        self.root[i] = r
        return r

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            self._compute()
        some = np.flatnonzero(self.links)
        first = np.array([c[0] for c in self.codes.chunks])
        number = lambda k: first[self.places[k] >> 32] + (self.places[k] & 0xFFFFFFFF)
        if len(some):
            empty = [pa.nulls(len(some), t) for t in (pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(number(some)), pa.array(self.links[some]), pa.array(number(self._roots(some))), *empty], schema=FOUND_SCHEMA)
