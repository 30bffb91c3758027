"""The pipeline's stages, each against a plain version over what the stage before it kept."""

import brute
import corpus_pipeline
import pytest

from evspark.llm import shared

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(shared.stored(stage(spark, out[-1], DATA), name))
    return out


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[1:-1])


def test_quality_keeps_clean_documents(steps):
    left = {r["doc_id"] for r in as_rows(steps[1])}
    labels = as_rows(steps[0].sparkSession.read.parquet(f"{DATA}/labels.parquet"))
    good, bad = ([r["doc_id"] for r in labels if r["quality"] == q] for q in (1, 0))
    assert sum(i in left for i in good) >= 0.97 * len(good)
    assert sum(i in left for i in bad) <= 0.1 * len(bad)


def test_near_duplicates(steps):
    want = [r["doc_id"] for r in brute.op7(as_rows(steps[1]), 80) if r["kept"]]
    assert sorted(r["doc_id"] for r in as_rows(steps[2])) == sorted(want)


def test_decontamination(steps, rows):
    want = [r["doc_id"] for r in brute.op4(as_rows(steps[2]), rows("benchmark")) if not r["contaminated"]]
    assert sorted(r["doc_id"] for r in as_rows(steps[3])) == sorted(want)


def test_mixing(steps):
    before, after = as_rows(steps[3]), as_rows(steps[4])
    aims, known = brute.op3_targets(before), {r["doc_id"]: r for r in before}
    assert all(known[r["doc_id"]] == r for r in after)
    largest = max(brute.size(r["text"]) for r in before)
    for source, (_, target) in aims.items():
        assert abs(sum(brute.size(r["text"]) for r in after if r["source"] == source) - target) <= 2 * largest


def test_tokens(steps, same):
    same(as_rows(steps[5]), brute.op1(as_rows(steps[4])))


def test_empty_input(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, DATA), "empty")
    assert docs.collect() == []
