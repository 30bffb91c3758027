"""Benchmark passages in documents, with DataFrame functions only (operator 4).

Both sides are normalised alike: A-Z lower-cased, words are runs of ASCII digits and letters and of all that is not
ASCII. A benchmark item gives every window of ``n`` consecutive words; a shorter item is one window of all its words.
Each document's windows are generated in place and looked up by their whole text, so a hash hit is verified by the
comparison of the strings. All words inside an occurrence are hit.

Definitions: null and empty texts have no words; items without words have no windows. Several items may own a window, and
an item with a repeated id counts once. Rows with equal id and text are counted together and returned as often as they occur.
Empty tables are allowed on either side. Items with a null id are left out. Texts of any length are scanned whole. Other columns,
whatever their names, stay as they are where rows are returned, and are not read.

Scale: the scan of texts is one pass without exchange if the windows fit a broadcast: they are counted first, and past
``MAX_BROADCAST_WINDOWS`` the lookup is a shuffled join. Only hits and one narrow row per document are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm import shared

# What separates words, and A-Z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same in texts that are not lower-cased.
RAW_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MAX_BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def _windows(w: Column, n: int) -> Column:
    """(position, length, text) of each run of ``n`` words."""
    make = lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.array_join(F.slice(w, i + 1, n), " ").alias("text"))
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), make)).otherwise(F.array())


def benchmark_windows(benchmark: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window, len, items: each distinct window with the ids of its items as sorted strings."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    short = items.where(F.size("w") < n).select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("len"))
    full = items.where(F.size("w") >= n).select("item", F.explode(_windows(F.col("w"), n)).alias("x")).select("item", F.col("x.text").alias("window"), F.col("x.len").alias("len"))
    return short.union(full).groupBy("window", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, spans (first word, words), n_hit, items of every row."""
    known = benchmark_windows(benchmark, n)
    stats = known.agg(F.count("*").alias("n"), F.collect_set("len").alias("lengths")).first()
    lengths = sorted(stats.lengths)  # at most n
    known = known.drop("len")
    if stats.n <= MAX_BROADCAST_WINDOWS:
        known = F.broadcast(known)
    w = F.col("w")
    own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("text")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    scanned = texts.select("doc_id", "text_hash", F.size(w).alias("n_words"), F.explode(F.concat(own, *[_windows(w, k) for k in lengths])).alias("x"))
    scanned = scanned.select("doc_id", "text_hash", "n_words", "x.at", "x.len", F.col("x.text").alias("window"))
    found = scanned.join(known, "window", "left").where("items is not null or at < 0")
    span = F.when(F.col("at") >= 0, F.struct("at", "len"))
    one = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count(F.when(F.col("at") < 0, 1)).alias("copies"),
    )
    inside = F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))
    one = one.withColumn("n_hit", F.size(F.array_distinct(F.flatten(inside))).cast("long"))
    one = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), "spans", "n_hit", "items")


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without any benchmark window."""
    i, h = shared.unused(docs, "hit_id"), shared.unused(docs, "hit_text")
    hit = contamination(docs, benchmark, n, id_col, text_col).where("n_hit > 0").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(h))
    return docs.join(hit, same, "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs``; in texts with hits, hit words are left out, each with the separator behind it."""
    i, h, spans = (shared.unused(docs, n) for n in ("hit_id", "hit_text", "hit_spans"))
    hit = contamination(docs, benchmark, n, id_col, text_col).where("n_hit > 0").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("spans").alias(spans)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(h))
    # a separator, perhaps empty, before the first word; then each word with what is behind it
    body = F.regexp_extract_all(text_col, F.lit(f"{RAW_WORD}(?:{RAW_SEPARATOR})?"), F.lit(0))
    head = F.regexp_extract(text_col, f"^(?:{RAW_SEPARATOR})?", 0)
    hit_words = F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))
    kept = F.filter(body, lambda _, i: ~F.array_contains(hit_words, i))
    columns = [(F.when(F.col(spans).isNull(), F.col(c)).otherwise(F.concat(head, F.array_join(kept, "")))).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return docs.join(hit, same, "left").select(*columns)
