"""Token counts of whole texts without encoding every word anew (operator 9).

Two tiers of lengths by pre-token: a compact table of the corpus' most frequent ones, broadcast, and a store of
bounded size in each worker for those that the worker meets besides. What neither has goes through the library
once per batch. Pre-tokens are never shuffled: the frequent ones come from sketches of fixed size (one per group
of input partitions). The table only saves time; every count is that of the library.

Definitions: a null text is empty and has no tokens. Rows are kept as they are, repeated ids too. An empty table
gives no rows. Texts of any length are counted whole. Other columns, whatever their names, are not read. Pre-tokens are the pieces of ``units``; tokenizers that cannot be cut so encode whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm import units

TABLE_SIZE = 16_384
"""Pre-tokens in the broadcast table, of at most ``units.MAX_UNIT_CHARS`` characters: 4 MB at the most."""
SKETCH_ITEMS = 49_152
SKETCH_GROUPS = 64


def frequent_pieces(texts: DataFrame, text: Column, size: int = TABLE_SIZE) -> list[str]:
    """The most frequent words with the space before them, over all texts; two levels of bounded sketches."""
    words = texts.select(F.explode(F.split(text, " ")).alias("w")).where((F.length("w") > 0) & (F.length("w") < units.MAX_UNIT_CHARS) & ~F.col("w").rlike("\\s"))
    part = words.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("g")).agg(F.expr(f"approx_top_k_accumulate(w, {SKETCH_ITEMS})").alias("s"))
    # grouped, as Spark 4.1 cannot combine sketches of an empty partition without a key
    top = part.groupBy((F.col("g") * 0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s), {size})").alias("top"))
    rows = top.select(F.explode("top.item").alias("w")).collect()  # at most ``size`` words
    return [" " + r.w for r in rows]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``) of every row."""
    frequent = frequent_pieces(docs, F.col(text_col))
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent, units.lengths_of(tokenizer, frequent, {}), strict=True)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n = units.lengths_of(tokenizer, texts.to_pylist(), table.value)
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
