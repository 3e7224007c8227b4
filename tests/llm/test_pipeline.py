"""Each stage of the pipeline, judged on its own input."""

import corpus_pipeline as c
import pytest

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in c.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in c.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas(), docs.schema)
        assert docs.columns == columns and 0.6 * n <= docs.count() <= n, name
        n = docs.count()
    assert {r["n_chars"] == len(r["text"]) for r in docs.collect()} == {True}
    packed = c.packed(spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_copies_and_toxic_documents_go(spark):
    import random

    rng = random.Random(4)
    text = lambda: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(999)}" for _ in range(80))
    clean = [text() for _ in range(20)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(clean)] + [(100, clean[3], "en", "s", 0), (101, f"You are a worthless idiot and scum. {text()}", "en", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = frame.selectExpr("doc_id", "1 quality", "cast(doc_id = 101 as int) toxic")
    from sextant.llm import simhash, toxicity

    kept = toxicity.keep(frame, labels)
    assert {r["doc_id"] for r in kept.collect()} == {*range(20), 100}
    assert {r["doc_id"] for r in simhash.keep_one(kept).collect()} == set(range(20))


@pytest.mark.parametrize("k", range(5))
def test_empty_input(spark, k):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert c.STAGES[k][1](spark, docs, DATA).collect() == []
