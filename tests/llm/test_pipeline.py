"""The pipeline's stages, each against a plain version on its own input."""

import hashlib

import corpus_pipeline
import pytest

from docfiling.llm import quality


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("input", docs, None)]
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, sf_dir), "test")
        out.append((name, docs, [tuple(r) for r in docs.collect()]))
    return out


def test_columns_and_order(steps):
    assert [n for n, _, _ in steps[1:]] == [n for n, _ in corpus_pipeline.STAGES]
    for _, df, _ in steps[1:-1]:
        assert df.columns == steps[0][1].columns and df.dtypes == steps[0][1].dtypes


def test_quality_stage(spark, steps, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in quality.judged(steps[0][1], labels).filter("predicted = 1").collect()}
    assert {r[0] for r in steps[1][2]} == good


def test_exact_stage(steps):
    top = {}
    for r in steps[1][2]:
        top[r[1]] = max(top.get(r[1], -1), r[0])
    assert sorted(r[0] for r in steps[2][2]) == sorted(top.values())


def test_near_stage(steps):
    from test_operators import brute_groups

    groups = brute_groups([(r[0], r[1]) for r in steps[2][2]], 80)
    assert sorted(r[0] for r in steps[3][2]) == sorted({int(g[2]) for g in groups})


def test_leak_stage(spark, steps, sf_dir):
    from test_operators import brute_hits

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = ({r[0]: r[1] for r in steps[k][2]} for k in (3, 4))
    hits = {int(i): (n, hit) for i, n, hit, _ in brute_hits(list(before.items()), items)}
    assert any(hit for _, hit in hits.values())
    for i, (n, hit) in hits.items():
        assert (i in after) == (2 * hit <= n)
        if not hit:
            assert after[i] == before[i]
    assert all(hit == 0 for _, _, hit, _ in brute_hits(list(after.items()), items))


def test_token_stage(steps):
    text = {r[0]: r[1] for r in steps[4][2]}
    rows = steps[5][1].collect()
    assert {r["doc_id"] for r in rows} == set(text)
    assert all(r["n_tokens"] == len(r["ids"]) and r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_run(spark, steps, sf_dir):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r[0] for r in steps[5][2])


def test_edges(spark, sf_dir):
    """Each stage on nulls, empty and repeated rows, long texts, no rows at all, and columns named as those used inside."""
    from pyspark.sql import functions as F

    text = "plain words stand here in a row of some length and tell nothing new to those who read them at night"
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (None, None), (4, "x" * 200_000), (5, f"{text} " * 3000), (6, "b\u00e9 \U0001f600 \x00")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("k") for c in ("rid", "key", "row", "ids", "a", "kept", "sha", "quality", "starts")})
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0
        out = stage(spark, docs, sf_dir)
        found = out.collect()
        if name == "byte-level BPE":
            want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
            assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in found) == want
        else:
            assert out.columns == docs.columns and {(r["doc_id"], r["text"]) for r in found} <= set(rows) and {r["rid"] for r in found} <= {"k"}
        if name in ("exact dedup", "MinHash near-dedup"):
            assert sum(r["text"] == text for r in found) == 1
