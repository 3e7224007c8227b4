"""Queries over whole documents, on tables made for the test."""

import hashlib
from collections import Counter

from sextant import queries as engine

TEXTS = {1: "the quick brown fox saw a fox", 2: " ".join(f"word{k % 700} and" for k in range(3000))}


def test_every_document_is_embedded(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc, text in TEXTS.items():
        w, features = text.split(), Counter()
        for t in w:
            features["w:" + t] += len(t) > 1
            for g in [t] if len(t) <= 3 else [t[i : i + 3] for i in range(len(t) - 2)]:
                features["c:" + g] += 0.35
        for a, b in zip(w, w[1:], strict=False):
            features[f"b:{a} {b}"] += 0.75
        v = Counter()
        for f, x in features.items():
            h = hashlib.sha256(f.encode()).digest()
            v[int.from_bytes(h[:4], "big") % 384] += x if h[4] % 2 == 0 else -x
        norm = sum(x * x for x in v.values()) ** 0.5
        want |= {(doc, k): x / norm for k, x in v.items() if abs(x) > 1e-9}
    found = {(r["doc_id"], r["idx"]): r["value"] for r in engine.queries()["hash_embedding_sparse"](spark, str(tmp_path)).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 2e-6 for k in want)


def test_a_passage_inside_a_long_document_reaches_context_and_answer(spark, tmp_path):
    filler = " ".join(f"Plain sentence number {k} talks about nothing." for k in range(200))
    long = f"{filler} The zyzzyva weevil eats marantaceae roots. {filler}"
    spark.createDataFrame([(1, long, "s"), (2, filler, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "zyzzyva weevil marantaceae")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    context = engine.queries()["context_budget"](spark, str(tmp_path)).collect()
    assert len(context) == 1 and "zyzzyva weevil eats" in context[0]["context"] and "Chunk ID: 1_page_1_chunk_" in context[0]["context"]
    answer = engine.queries()["answer_batch"](spark, str(tmp_path)).collect()
    assert len(answer) == 1 and answer[0]["support"] == "STRONG_SUPPORT"
