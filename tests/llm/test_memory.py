"""What workers hold at once, and what travels beside a text."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sextant.llm import quality, substring
from sextant.llm.common import slices


def _batch(megabytes: int) -> pa.RecordBatch:
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(50_000)])
    texts = [" ".join(rng.choice(words, 2_000)) for _ in range(megabytes * 80)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])


def _peak(rows) -> float:
    """MB of Python and numpy at most while rows are made."""
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_anchors_of_a_large_batch_take_little_memory():
    assert _peak(substring._anchor_rows(iter([_batch(6)]), 50)) < 120


def test_counts_of_a_large_batch_take_little_memory():
    assert _peak(quality.counts_of(values) for _, values in slices(iter([_batch(6)]), limit=quality.CHUNK)) < 120


def test_remove_moves_each_text_once(spark, monkeypatch):
    seen = []
    written = substring.materialize
    monkeypatch.setattr(substring, "materialize", lambda df, label: seen.append(df.schema) or written(df, label))
    same = " ".join(f"p{k}" for k in range(60))
    data = [(1, f"a  b\n{same}"), (2, f"c\t{same}  d\n e"), (3, "x \n  y"), (4, ""), (5, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("note", F.lit("n"))
    found = {r["doc_id"]: (r["text"], r["note"]) for r in substring.remove(docs).collect()}
    assert found == {1: (data[0][1], "n"), 2: ("c d e", "n"), 3: ("x \n  y", "n"), 4: ("", "n"), 5: (None, "n")}
    assert [f.name for f in seen[0] if f.dataType.simpleString() == "string"] == ["text", "c0"]  # c0: note
