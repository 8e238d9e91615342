"""The pipeline against brute force, stage by stage."""

import re

import pytest

import corpus_pipeline
from kernelweave.llm import op10_quality
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_simple_ops import brute_hits, brute_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(9000, None, "en", None, None), (9001, "", None, "x", 0), (None, "w " * 60, "en", "x", 120), (0, "another text under a known id " * 20, "en", "x", 1)], docs.schema)
    out = [docs.union(more).cache()]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], SF), "t"))
    return out


def test_quality_stage(stages):
    own = [tuple(r) for r in stages[1].collect()]
    judged = {(r["doc_id"], r["t"]): r["kept"] for r in op10_quality.judge(stages[0]).collect()}
    assert len(own) == sum(judged.values()) > 100
    for _, text, *_ in own:
        n = brute_quality(text)
        assert n[0] >= 50 and 100 * n[4] <= 50 * n[0]


def test_near_copies_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    left = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    # equal ids with other texts are rows of their own, so classes are those of the rows' places
    placed = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    classes = {c for _, _, c in brute_groups([(i, t) for i, (_, t) in enumerate(placed)])}
    assert sorted(left, key=str) == sorted((placed[c] for c in classes), key=str) and len(left) < len(rows)


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {(r["doc_id"], r["source"]): r["text"] for r in stages[2].collect()}
    after = {(r["doc_id"], r["source"]): r["text"] for r in stages[3].collect()}
    for k, t in before.items():
        n, hit, _ = brute_hits(t, items)
        assert (k in after) == (2 * hit <= n)
        if k in after:
            assert (after[k] == t) == (hit == 0)


def test_pii_and_encoding_stages(stages):
    text = {(r["doc_id"], r["source"]): r["text"] for r in stages[4].collect()}
    assert not any(re.search(r"[a-z0-9]@mail\d", t) for t in text.values())
    assert stages[3].columns == stages[4].columns == stages[0].columns
    last = stages[5].collect()
    assert len(last) == len(text) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in last)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "t")
    assert docs.count() == 0 and docs.columns == ["doc_id", "ids", "n_tokens"]
