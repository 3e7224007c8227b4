import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sextant import queries as engine
from sextant.functions import chunking
from sextant.functions import text as T
from sextant.operators import answers, evaluation, fusion, understanding
from sextant.sources import files

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return round(float(v), 9) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    found = engine.queries()[name](spark, DATA)
    expected = db.sql(engine.oracle_sql()[name])
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    own = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    assert own == sorted(repr([plain(r[expected.columns.index(c)]) for c in columns]) for r in expected.fetchall())


@pytest.mark.parametrize("word, stem", [("boxes", "boxe"), ("classes", "class"), ("series", "sery"), ("ties", "ties"), ("analysis", "analysis"), ("tennis", "tenni"), ("paris", "pari"), ("davis", "davi"), ("bus", "bus"), ("focus", "focus"), ("glass", "glass"), ("prizes", "priz"), ("q2s", "q2s"), ("Öle", "öle")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.col("w")), w=word) == stem


def test_clean_and_headings():
    assert chunking.clean_text("été\nde 65 %") == "été de 65%"
    assert chunking.clean_text("3\nModel Design\nText goes on\nhere.") == "3 Model Design\n\nText goes on here."
    assert chunking.is_heading("Chapter 4") and chunking.is_heading("METHODS AND DATA") and not chunking.is_heading("3 We measured the effect of rain on crops.")
    assert chunking.clean_text(None) == ""


def test_overlap_and_numbers():
    assert chunking.split_text("aaa bbb ccc\n\nddd", 12, 8) == ["aaa bbb ccc", "ccc\n\nddd"]  # the tail starts with a space: its first word goes
    assert chunking.split_text("aaa bbbb cc\n\nddd", 12, 7) == ["aaa bbbb cc", "bbbb cc\n\nddd"]
    assert [t for t, _ in chunking.sections("2\nModel Design\nBody.")] == ["2 Model Design"]
    assert [t for t, _ in chunking.sections("2\n\nModel and its Design\nBody.")] == ["Document"]


def test_chunks_cover_the_text():
    text = "Intro words here.\n\nINTRODUCTION\n\n" + " ".join(f"Sentence number {i} ends." for i in range(200))
    found = chunking.chunk_list(text)
    assert {c["section_title"] for c in found} == {"Document", "INTRODUCTION"}
    assert all(len(c["text"]) <= chunking.SIZE + chunking.OVERLAP + 2 and len(c["parent_text"]) <= chunking.PARENT for c in found)
    assert all(any(f"number {i} " in c["text"] for c in found) for i in range(200))
    assert chunking.chunk_list(None) == [] and chunking.chunk_list("   ") == []


def test_claims_and_answers(spark):
    assert one(spark, understanding.rewrite_claim(F.col("q")), q="Does the paper say that rain helps crops?") == "rain helps crops"
    assert one(spark, understanding.rewrite_claim(F.col("q")), q="Does table 2 support the claim that prices fell?") == "table 2 prices fell"
    said = answers.normalize_answer(F.col("a"), F.col("q"), F.lit(True))
    assert one(spark, said, a="It rose (Source 2).", q="Did it?") == "It rose [2]."
    assert one(spark, said, a="It rose.", q="Did it?") == "It rose. [1]"
    assert one(spark, said, a="The document does not mention rain.", q="Did it?") == answers.REFUSAL_EN


def test_evaluation_parsers(spark):
    assert one(spark, evaluation.parse_pages(F.col("x")), x="17;42, 3;17") == [3, 17, 42]
    assert one(spark, evaluation.cited_ids(F.col("x")), x="A [2, 1]. B [2].") == [2, 1]


def test_rrf_does_not_turn_agreement_into_certainty(spark):
    rows = spark.createDataFrame([(1, 1, 1, "a", 0.2), (1, 2, 1, "a", 0.2)], "q int, list int, rank int, id string, score double")
    r = fusion.rrf(rows, 5).first()
    assert r["base_score"] == 0.2 and r["rank_score"] == 1.0 and r["score"] < 0.4


def test_mmr_keeps_the_best_first(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, ["x", "y"], ["x"]), (1, "b", 0.89, ["x", "y"], ["x"]), (1, "c", 0.5, ["z"], ["x"])], "q int, id string, score double, terms array<string>, query_terms array<string>")
    assert [r["id"] for r in fusion.mmr(rows, 2).orderBy("rank").collect()][0] == "a"


def test_documents_from_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhello \xff there")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.W[1:-1]}"><w:body>{p.format("one")}{p.format("")}{p.format("two")}</w:body></w:document>')
    rows = {(r["text"], r["page"], r["paragraph_index"]) for r in files.load_documents(spark, f"file://{tmp_path}").collect()}
    assert rows == {("hello � there", 1, None), ("one", None, 1), ("two", None, 3)}


def test_profiles_and_secrets():
    found = files.resolve_profile({"general": {"a": {"x": [1], "y": [2]}, "l": [1]}, "own": {"extends": "general", "a": {"x": [3]}, "l": [1, 2]}}, "own")
    assert found["a"] == {"x": [3], "y": [2]} and found["l"] == [1, 2]
    assert files.redact({"api_key": "s", "token": "", "n": [{"password": "p"}]}) == {"api_key": "***", "token": None, "n": [{"password": "***"}]}


def test_streamed_chunks(spark, tmp_path):
    from sextant.streaming import ingest

    spark.createDataFrame([("Some text.", "f", "f.txt", 1, None)], files.DOCUMENT).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(files.DOCUMENT).parquet(f"{tmp_path}/in")
    ingest.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r["chunk_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["f_page_1_chunk_0"]
