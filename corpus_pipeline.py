"""Pipeline over ``documents``: each stage's rows are written as Parquet and reread as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``docs``, whatever other columns there are and however they are named; such columns are carried and not read. Texts of any length
are read whole. An empty input passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evspark.llm import decontaminate, minhash, mixing, quality, queries, shared, token_output

SIMILAR_PERCENT = 80
WINDOW_WORDS = 10


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; the score depends on the text alone, so equal texts share a fate.

    Null and empty texts are scored as empty; null ids have no label; repeated rows all stay or all go.
    """
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null ids come last, by the hash of their text; equal rows are one; documents without words, null ones too, all stay.
    """
    return minhash.keep_first(docs, SIMILAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts have no window and stay; rows with equal id and text share a fate; items without id or words are left out.
    """
    return decontaminate.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"), WINDOW_WORDS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them.

    A null source is a source; documents without words have size 0 and are drawn like others of their source; equal rows are drawn
    together; ties of size stand in order of id and text.
    """
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32.

    Null ids come first, a null text is empty; repeated rows are documents of their own, in order of the hash of their text.
    """
    return token_output.token_documents(docs, public_tokenizers.path(queries.BYTE_BPE), queries.END_ID)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]

# scores, sketches, hashes and token ids have no SQL form; tests/llm holds each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
