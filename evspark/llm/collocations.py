"""Phrases of two and three words that occur together more often than their parts (operator 13).

Words are counted first, then pairs of words that are frequent, then triples whose two pairs are frequent: no other phrase can reach
``least``. A worker numbers the words that it meets, and a phrase is these places packed into one number. Tasks count in a trie over them. Its first
level branches by the first word; below it are hash containers, arrays with open addressing, and one that grows beyond ``BURST``
phrases bursts into a node that branches by the second word. When a trie holds ``MOST_ENTRIES``, whole subtrees are spilled, the largest
first, as sorted runs, in which places become ids: 64-bit hashes of language and word.
Runs are dealt by all ids of a phrase and merged by Spark, so that a frequent first word is spread too, and a phrase comes once a run.

Frequent words and pairs reach the tasks as Bloom filters in mapped files. A filter lets some others pass, which are counted and then
fall below ``least`` like any phrase: counts are exact. Two words with one id would spoil that, so distinct ids are compared with
distinct words, and another seed is taken if they differ.

Definitions: A-Z are lower-cased, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, pieces into words ``[^\\x20\\x09]+``. A null text is
empty, a null language is ``und``. Rows are counted as they are, repeated ones too; ids are not read. n counts the words of a language.
A phrase cut in two has score floor(1,000,000 a a / (l r)) with a its count and l, r those of its parts; its lowest score counts, of equal
ones that of the first cut. A phrase goes if a longer candidate contains it and has at least half its count. Ties are ordered by
count and phrase (bytes). Texts of any length are counted whole; an empty table gives no rows.

Scale: rows per task and phrase are shuffled, never texts. Of each language a bounded number of best rows per slice of its phrases
reaches the final order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm import bits, shared

LEAST = 10
TOP = 2000
CONTAINED_PERCENT = 50
SLICES = 32
PLACE_BITS, NODE_BITS = 21, 4
"""Bits of a word's place, so that three words are one number, and those that a node of the trie branches by."""
BURST = 1 << 16
MOST_ENTRIES = 300_000
"""Phrases of a trie, of at most 64 bytes each with the free slots."""
MOST_WORDS = 200_000
"""Words of a word table, about 40 MB."""
KEPT_BYTES, ENTRY_BYTES = 24 << 20, 180
PORTION = 1 << 17
MOST_PLACES = 1 << 20
"""Words of texts at a time, and places after which a worker starts anew; both together stay below 2 to the ``PLACE_BITS``."""

# Characters that end a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_STOP = bytes(ord(".") if b in _ENDS else b for b in bytes(range(256)).lower())


def tokens(text: str | None) -> list[bytes]:
    """Words in order, and a full stop (which no word holds) where a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_STOP).replace(b".", b" . ").split()


class _Places(dict):
    """Places of one language's words in the arrays of ``_Known``."""

    def __init__(self, lang: str, known: _Known):
        super().__init__({b".": 0})
        self.lang, self.known = lang_prefix(lang), known

    def __missing__(self, word: bytes) -> int:
        known = self.known
        known.left -= len(word) + ENTRY_BYTES
        self[word] = place = len(known.ids) + len(known.new)
        known.new.append(word_id(self.lang, word, known.seed))
        return place


class _Known:
    """Ids of the words met, of all languages, and whether they may be frequent; place 0 marks the end of a piece."""

    def __init__(self, seed: int, frequent: bits.OpenBits):
        self.seed, self.frequent = seed, frequent
        self.drop()

    def drop(self) -> None:
        self.left, self.langs, self.new = KEPT_BYTES, {}, []
        self.ids, self.good = np.zeros(1, np.uint64), np.zeros(1, bool)

    def full(self) -> bool:
        """Whether the bytes are used up, or places might not fit their bits after another few texts."""
        return self.left <= 0 or len(self.ids) > MOST_PLACES

    def read(self, texts: list[tuple[str, list[bytes]]]) -> np.ndarray:
        """Places of words in order, 0 at the end of pieces and texts."""
        parts = []
        for lang, words in texts:
            if lang not in self.langs:
                self.langs[lang] = _Places(lang, self)
                self.left -= len(lang) + ENTRY_BYTES
            parts += [np.fromiter(map(self.langs[lang].__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        if self.new:
            fresh = np.array(self.new, np.uint64)
            self.ids, self.good, self.new = np.r_[self.ids, fresh], np.r_[self.good, self.frequent.have(fresh)], []
        return np.concatenate(parts)


def lang_prefix(lang: str) -> bytes:
    raw = lang.encode("utf-8", "surrogatepass")
    return b"%d:" % len(raw) + raw


def word_id(lang: bytes, word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang + word, seed) or 1


class Container:
    """Hash table of packed phrases and their counts, in arrays with open addressing."""

    def __init__(self, bits_: int = 12):
        self.keys, self.counts, self.size = np.zeros(1 << bits_, np.int64), np.zeros(1 << bits_, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Count distinct phrases."""
        while 2 * (self.size + len(keys)) > len(self.counts):
            held = self.rows()
            self.keys, self.counts, self.size = np.zeros(2 * len(self.keys), np.int64), np.zeros(2 * len(self.counts), np.int64), 0
            self._add(*held)
        self._add(keys, counts)

    def _add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = len(self.counts) - 1
        slot = (bits.mixed(keys.view(np.uint64)) & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.counts[slot] == 0)
            # of the phrases that meet in a free slot the last one gets it
            self.keys[slot[free]] = keys[free]
            got = free[self.keys[slot[free]] == keys[free]]
            self.size += len(got)
            same = self.keys[slot] == keys
            here = np.flatnonzero(same & (self.counts[slot] > 0))
            self.counts[slot[here]] += counts[here]
            self.counts[slot[got]] = counts[got]
            left = ~same
            keys, counts, slot = keys[left], counts[left], (slot[left] + 1) & mask

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.counts > 0
        return self.keys[used], self.counts[used]


class Trie:
    """Counts of phrases of one length: branches by the first word, below them containers, or once more branches, by the second word."""

    def __init__(self, length: int, most: int = MOST_ENTRIES, burst: int = BURST):
        self.length, self.most, self.burst = length, most, burst
        self.root: dict[int, Container | dict[int, Container]] = {}

    @property
    def entries(self) -> int:
        return sum(map(self._size, self.root.values()))

    @staticmethod
    def _size(below: Container | dict[int, Container]) -> int:
        return sum(c.size for c in below.values()) if isinstance(below, dict) else below.size

    def add(self, phrases: np.ndarray) -> None:
        """Count packed phrases."""
        for branch, some in self._branches(*np.unique(phrases, return_counts=True), 0):
            below = self.root.setdefault(branch, Container())
            if isinstance(below, Container):
                below.add(*some)
                if below.size > self.burst:
                    self.root[branch] = deeper = {}
                    for second, rest in self._branches(*below.rows(), 1):
                        deeper.setdefault(second, Container()).add(*rest)
            else:
                for second, rest in self._branches(*some, 1):
                    below.setdefault(second, Container()).add(*rest)

    def _branches(self, keys: np.ndarray, counts: np.ndarray, word: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        """Phrases by some bits of one of their words."""
        branch = ((keys >> (PLACE_BITS * (self.length - 1 - word))) & ((1 << NODE_BITS) - 1)).astype(np.uint8)
        order = np.argsort(branch, kind="stable")
        ends = np.searchsorted(branch[order], np.arange((1 << NODE_BITS) + 1))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            at = order[ends[b] : ends[b + 1]]
            yield b, (keys[at], counts[at])

    def _run(self, branch: int) -> tuple[np.ndarray, np.ndarray]:
        """A subtree's phrases in order, and their counts; it leaves the trie."""
        below = self.root.pop(branch)
        parts = [c.rows() for c in (below.values() if isinstance(below, dict) else [below])]
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        return keys[order], counts[order]

    def spilled(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of the largest subtrees, once the trie is full, until half of it is left."""
        left = self.entries
        if left > self.most:
            for branch, size in sorted(((b, self._size(x)) for b, x in self.root.items()), key=lambda x: -x[1]):
                if left <= self.most // 2:
                    break
                left -= size
                yield self._run(branch)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for branch in sorted(self.root):
            yield self._run(branch)


def packed(places: list[np.ndarray]) -> np.ndarray:
    """Places of a phrase's words in one number."""
    out = places[0]
    for p in places[1:]:
        out = (out << PLACE_BITS) | p
    return out


def unpacked(keys: np.ndarray, length: int) -> list[np.ndarray]:
    return [(keys >> (PLACE_BITS * (length - 1 - k))) & ((1 << PLACE_BITS) - 1) for k in range(length)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _portions(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Languages and words of texts, about ``PORTION`` words at a time.

    A longer text comes in parts, each with the ``length`` - 1 words behind it, so every phrase is whole in exactly one.
    """
    some, size = [], 0
    for lang, text in _docs(batches):
        words = tokens(text)
        for at in range(0, len(words), PORTION):
            some.append((lang, words[at : at + PORTION + length - 1]))
            size += len(some[-1][1])
            if size >= PORTION:
                yield some
                some, size = [], 0
    if some:
        yield some


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, n of every word of every language; ``docs`` has lang and text."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def spill() -> Iterator[pa.RecordBatch]:
            for lang, words in found.items():
                del words[b"."]
                prefix, rows = lang_prefix(lang), sorted(words.items())
                for at in range(0, len(rows), 8192):
                    some = rows[at : at + 8192]
                    ids = np.fromiter((word_id(prefix, w, seed) for w, _ in some), np.uint64, len(some))
                    columns = [pa.array([lang] * len(some)), pa.array([w.decode("utf-8", "replace") for w, _ in some]), pa.array(_signed(ids)), pa.array([n for _, n in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
            found.clear()

        for some in _portions(batches, 1):
            for lang, part in some:
                found.setdefault(lang, Counter()).update(part)
            if sum(map(len, found.values())) > MOST_WORDS:
                yield from spill()
        yield from spill()

    parts = docs.mapInArrow(count, "lang string, word string, id long, n long")
    return parts.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def _phrases(docs: DataFrame, seed: int, length: int, words: bits.Bits, pairs: bits.Bits | None) -> DataFrame:
    """w1.. and n of the phrases of a length that may be frequent."""
    names = [f"w{k + 1}" for k in range(length)]
    schema = pa.schema([(n, pa.int64()) for n in (*names, "n")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(length), _Known(seed, words.opened())
        known_pairs = pairs.opened() if pairs else None

        def rows(runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for keys, counts in runs:
                columns = [pa.array(_signed(known.ids[p])) for p in unpacked(keys, length)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], schema=schema)

        for some in _portions(batches, length):
            if known.full():
                # phrases are numbered by places, so they leave with them
                yield from rows(trie.rest())
                known.drop()
            place = known.read(some)
            good = known.good[place]
            at = np.flatnonzero(good[:-1] & good[1:])
            if known_pairs:
                pair = np.zeros(len(place), bool)
                pair[at] = known_pairs.have(pair_key(known.ids[place[at]], known.ids[place[at + 1]]))
                at = np.flatnonzero(pair[:-1] & pair[1:])
            if len(at):
                trie.add(packed([place[at + k] for k in range(length)]))
                yield from rows(trie.spilled())
        yield from rows(trie.rest())

    parts = docs.mapInArrow(count, ", ".join(f"{n} long" for n in (*names, "n")))
    # a run has a phrase once, so there is little to sum before the exchange, even for the most frequent one
    return parts.repartition(*names).groupBy(*names).agg(F.sum("n").alias("n"))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return bits.mixed(a) * np.uint64(3) + b


def _pair_keys(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(pair_key(a, b)))], names=["key"])

    return pairs.select("w1", "w2").mapInArrow(run, "key long")


def counted(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lang, n of all words), words (lang, word, id, n), pairs (w1, w2, n) and triples (w1, w2, w3, n) that occur ``least`` times."""
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    for seed in range(64):
        every = shared.stored(word_counts(docs, seed), "words")
        sizes = every.agg(F.count("*").alias("words"), F.count_if(F.col("n") >= least).alias("frequent")).first()
        if every.select("id").distinct().count() == sizes.words:
            break
    else:
        raise ValueError("two words have one id under every seed")
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    words = shared.stored(every.where(F.col("n") >= least), "frequent-words")
    known = bits.write(words.select("id"), sizes.frequent)
    pairs = shared.stored(_phrases(docs, seed, 2, known, None).where(F.col("n") >= least), "pairs")
    known_pairs = bits.write(_pair_keys(pairs), pairs.count())
    triples = shared.stored(_phrases(docs, seed, 3, known, known_pairs).where(F.col("n") >= least), "triples")
    return totals, words, pairs, triples


def score(a: str, left: str, right: str):
    """floor(1,000,000 a a / (l r)) in whole numbers: decimals of 38 digits, for counts up to 10^15."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast((cast(1000000 as decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)}) as long)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    totals, words, pairs, triples = counted(docs, least, lang_col, text_col)
    word = lambda k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("n").alias(f"n{k}"))
    lang = words.select(F.col("id").alias("w1"), "lang")

    held = pairs.join(word(1), "w1").join(word(2), "w2").join(lang, "w1")
    longer = triples.select("w1", "w2", "n").union(triples.select("w2", "w3", "n")).groupBy("w1", "w2").agg(F.max("n").alias("longer"))
    held = held.join(longer, ["w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < CONTAINED_PERCENT * F.col("n")))
    two = held.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"))
    two = two.withColumn("score", score("a", "l", "r"))

    pair = lambda i, j, name: pairs.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{j}"), F.col("n").alias(name))
    three = triples.join(pair(1, 2, "left2"), ["w1", "w2"]).join(pair(2, 3, "right2"), ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3").join(lang, "w1")
    three = three.withColumn("s1", score("n", "n1", "right2")).withColumn("s2", score("n", "left2", "n3"))
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("n").alias("a"),
        F.when(first, F.col("n1")).otherwise(F.col("left2")).alias("l"), F.when(first, F.col("right2")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"),
    )

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    # the best of each slice first, so that the last window sees a bounded number of rows per language
    every = two.unionByName(three).withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    some = every.withColumn("rank", rank("lang", "slice")).where(F.col("rank") <= top).drop("rank", "slice")
    ranked = some.withColumn("rank", rank("lang").cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
