"""Keyword search and embeddings leave texts where they are."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F
from sextant import queries as engine
from sextant.functions import text as T
from sextant.operators import search


def moved(spark, run):
    """Rows that shuffles write while run() runs."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    found = run()
    return found, total() - before


def tables(spark, path, rng):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(120)]
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(rng.sample(words, 8))) for k in range(10)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_hits_move_no_words_and_no_texts(spark, tmp_path):
    tables(spark, tmp_path, random.Random(3))
    found, rows = moved(spark, lambda: engine.queries()["rerank_lexical"](spark, str(tmp_path)).collect())
    assert len(found) == 100 and rows < 20_000  # 48,000 words; pairs of a passage and a chunk that share a term: about 3,000


def test_embeddings_move_nothing(spark):
    docs = spark.createDataFrame([(k, f"some text number {k}") for k in range(50)], "id long, text string")
    found, rows = moved(spark, lambda: search.dense_embedding(docs, "id", "text").collect())
    assert len(found) == 50 and rows == 0 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-4 for r in found)


def test_scores_of_odd_texts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNKS", 3)
    monkeypatch.setattr(search, "BLOCK", 2)
    rng = random.Random(7)
    words = ["Boxes", "boxe", "classes", "Übung", "ΣΑΣ", "İstanbul", "series", "ties", "bus", "x_1", "4"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(20)] + [None, "", "  ,;  "]
    asked = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(5)] + [None, "absent"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    queries = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(asked)], "q string, text string")
    tokens = lambda rows, name: {r[name]: r["t"] for r in rows.select(name, T.tokenize(F.col("text")).alias("t")).collect()}
    held = tokens(chunks, "id")
    mean = sum(map(len, held.values())) / len(held)
    df = Counter(t for own in held.values() for t in set(own))
    want = {}
    for q, terms in tokens(queries, "q").items():
        raw = {d: sum(math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * 2.5 / (own.count(t) + 1.5 * (0.25 + 0.75 * len(own) / mean)) for t in terms if t in own) for d, own in held.items()}
        best = sorted((d for d in raw if raw[d] > 0), key=lambda d: (-round(raw[d], 9), d))[:4]
        want |= {(q, n): (d, round(raw[d] / raw[best[0]], 6)) for n, d in enumerate(best, 1)}
    found = {(r["q"], r["rank"]): (r["id"], r["score"]) for r in search.bm25(queries, chunks, "q", "text", "id", "text", 4).collect()}
    assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 2e-6 for k in want) and want
