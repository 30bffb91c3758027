"""Mix sources to target weights by systematic sampling (operator 3).

Every document of a source has the same expected number of copies, the source's target over its size in words. Documents
stand in order of (size, id, hash of text) within their source; expected copies are summed up along that order
from one random offset per source, and a document is emitted once per integer boundary that its stretch crosses.
Along an order by size the words taken differ from the target by about the size of one document.

Definitions: size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text, null and empty texts have 0. Sources
are ordered by code point, null is a source of its own and comes last. Ties of id and text are equal rows, each with a
stretch of its own. A source of size 0 has target 0. An empty table gives no rows. Texts of any length are one size each. Other columns
stay as they are in ``mixed``, whatever their names. Reruns agree: offsets come from the seed and the source's name, the order from
the rows.

Scale: one range exchange of narrow rows, which cuts a hot source into many parts; per part and source one count, whose
prefix sums turn positions in a part into ranks. Targets are a table, made by two prefix sums over sources; no list of sources reaches the
driver. A source of any size meets its target in a join that Spark can split.
``mixed`` joins texts to copies once, by id and hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.columns import canonical
from evspark.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0


def _summed_before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with the sum of each value over all rows before, in an order of all rows: per part of a range exchange, and over parts."""
    ranged = rows.withColumns({f"__{n}": v for n, v in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = shared.stored(ranged.withColumn("__at", at).withColumn("__part", F.shiftright("__at", 33)), "ordered")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy(F.col("__part").alias("__p")).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    # a row per part of the exchange
    across = Window.partitionBy(F.lit(0)).orderBy("__p")
    parts = parts.select("__p", *[before(f"__{n}", across).alias(f"__{n}_base") for n in sums])
    inside = Window.partitionBy("__part").orderBy("__at")
    found = ranged.join(parts, F.col("__part") == F.col("__p"))
    return found.select(*rows.columns, *[(F.col(f"__{n}_base") + before(f"__{n}", inside)).alias(n) for n in sums])


def targets(sizes: list[float], weights: list[float], total: float, most: float = MOST_COPIES) -> list[float]:
    """Share ``total`` by weight; a target stops at ``most`` times its size and what is over is shared again.

    The plain form, for a configured list; :func:`source_targets` gives the same for a table of any number of sources.
    """
    stopped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        rate = (total - most * sum(sizes[i] for i in stopped)) / sum(weights[i] for i in free) if free else 0.0
        over = {i for i in free if rate * weights[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in stopped else rate * weights[i] for i in range(len(sizes))]
        stopped |= over


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, size, target, one row per source of ``sizes`` (source, size).

    ``share`` of all sizes is dealt by weight; a target stops at ``most`` times its size and what is over is dealt again. In order of
    size over weight the sources that stop come first, so of each source the rate is known that holds if it is the first to go free: the
    first whose rate leaves it below its limit is the one. Two ordered prefix sums tell it, whatever the number of sources.
    """
    numbered = _summed_before(sizes, [F.col("source").isNull(), F.col("source")], k=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    ratio = F.col("size").cast("double") / F.col("weight")
    weighed = numbered.withColumn("weight", weight).withColumn("ratio", ratio)
    placed = _summed_before(weighed, [F.col("ratio"), F.col("k")], size_before=F.col("size").cast("double"), weight_before=F.col("weight"))
    placed = shared.stored(placed, "weighed")
    total = placed.agg(F.sum(F.col("size").cast("double")).alias("size"), F.sum("weight").alias("weight")).first()
    if not total.weight:
        return placed.select("source", "size", F.lit(0.0).alias("target"))
    rate = (share * total.size - most * F.col("size_before")) / (total.weight - F.col("weight_before"))
    free = placed.withColumn("rate", rate).where(F.col("rate") <= most * F.col("ratio"))
    first = free.agg(F.min(F.struct("ratio", "k", "rate")).alias("x")).first().x
    limit = most * F.col("size").cast("double")
    stops = F.lit(True) if first is None else (F.col("ratio") < first.ratio) | ((F.col("ratio") == first.ratio) & (F.col("k") < first.k))
    return placed.select("source", "size", F.when(stops, limit).otherwise(F.col("weight") * (first.rate if first else 0.0)).alias("target"))


def offset(seed: int, source: Column) -> Column:
    """Number from 0 to 1 that depends on the seed and the source's name: 52 bits of an md5."""
    name = F.concat(F.lit(str(seed)), F.coalesce(F.concat(F.lit(":"), source), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns; maps count by their entries in order, variants by their text."""
    fields = sorted(docs.schema.fields, key=lambda f: f.name)
    value = lambda f: F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() == "variant" else canonical(F.col(f"`{f.name}`"), f.dataType)
    return F.xxhash64(*map(value, fields))


def copies(docs: DataFrame, seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row_hash, source, size, source_size, target, copies (times that the document is emitted) of every row."""
    row_hash = _row_hash(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)).cast("long"), F.lit(0)).alias("size"), F.xxhash64(text_col).alias("tie"), row_hash.alias("row_hash"))
    rows = shared.stored(rows, "sizes")
    goal = source_targets(shared.stored(rows.groupBy("source").agg(F.sum("size").alias("size")), "sources"), weights, share, most)
    expected = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    goal = goal.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", expected.alias("expected"), offset(seed, F.col("source")).alias("offset"))
    goal = shared.stored(goal, "goals")

    order = ["source", "size", "doc_id", "tie", "row_hash"]
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    placed = shared.stored(placed.withColumn("part", F.shiftright("at", 33)).drop("tie"), "placed")
    counts = placed.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row per part and source: parts follow one another by source, so there are at most as many as parts and sources
    bases = counts.select(F.col("part").alias("p"), F.col("source").alias("s"), (before - F.col("first")).alias("base"))
    ranked = placed.join(bases, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).drop("s", "p")
    ranked = ranked.join(goal, F.col("source").eqNullSafe(F.col("s")))
    edge = lambda rank: F.floor(F.col("offset") + F.col("expected") * rank)
    rank = F.col("at") + F.col("base")
    return ranked.select("doc_id", "row_hash", "source", "size", "source_size", "target", (edge(rank + 1) - edge(rank)).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, each as often as it was drawn, with the columns of ``docs``.

    Equal rows are drawn together: one of them stands for all and is emitted as often as they were drawn.
    """
    drawn = copies(docs, **options).groupBy("doc_id", "row_hash").agg(F.sum("copies").alias("n")).where("n > 0")
    id_col = options.get("id_col", "doc_id")
    key = F.struct(F.col(id_col).cast("long").alias("i"), _row_hash(docs).alias("h"))
    at, times = shared.unused(docs, "mix_key"), shared.unused(docs, "mix_n")
    drawn = drawn.select(F.struct(F.col("doc_id").alias("i"), F.col("row_hash").alias("h")).alias(at), F.col("n").alias(times))
    once = docs.withColumn(at, key).join(drawn, at)
    distinct = once.dropDuplicates([at])
    return distinct.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
