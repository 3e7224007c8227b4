"""Reading documents, questions and profiles; writing chunks and reports."""

from __future__ import annotations

import ctypes
import io
import json
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import PurePath
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evaluation import parse_bool, parse_keywords, parse_pages

SUFFIXES = (".pdf", ".txt", ".docx")
DOCUMENT = "text string, file_id string, file_name string, page int, paragraph_index int"
QUESTION = "question string, difficulty string, expected_answer string, source_file string, source_pages string, expected_keywords string, is_answerable string, question_type string, expected_behavior string"
#: Fixed value: the name space of word-processor XML.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsupportedFile(ValueError):
    """A file whose suffix isn't read."""


def _pages(name: str, content: bytes) -> list[tuple[str, int | None, int | None]]:
    suffix = PurePath(name).suffix.lower()
    if suffix == ".txt":
        text = content.decode("utf-8-sig", "replace").strip()
        return [(text, 1, None)] if text else []
    if suffix == ".docx":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            tree = ElementTree.fromstring(z.read("word/document.xml"))
        texts = ("".join(t.text or "" for t in p.iter(f"{W}t")).strip() for p in tree.findall(f"{W}body/{W}p"))  # not those of tables and text boxes
        return [(t, None, k) for k, t in enumerate(texts, 1) if t]
    if suffix == ".pdf":
        try:
            import fitz
        except ImportError as e:
            raise RuntimeError("reading .pdf needs PyMuPDF on the executors") from e
        with fitz.open(stream=content, filetype="pdf") as pdf:
            texts = [p.get_text("text").strip() for p in pdf]
        return [(t, k, None) for k, t in enumerate(texts, 1) if t]
    raise UnsupportedFile(f"{name}: only {', '.join(SUFFIXES)} files are read")


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows of text of all files below path; file_id is the start of the content's SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(t, i, PurePath(p).name, page, n) for p, i, c in zip(part["path"], part["file_id"], part["content"], strict=True) for t, page, n in _pages(p, c)]
            yield pd.DataFrame(rows, columns=["text", "file_id", "file_name", "page", "paragraph_index"]).astype({"page": "Int32", "paragraph_index": "Int32"})

    return files.select("path", F.substring(F.sha2("content", 256), 1, 12).alias("file_id"), "content").mapInPandas(read, DOCUMENT)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, over all cores if it comes in fewer partitions, as one small file does; a large table stays as it is."""
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def trim() -> None:
    """Give freed memory back: workers are kept after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows as a Parquet table in the folder that spark.checkpoint.dir names: computed once, and not again when executors go.

    Only a local session without the setting gets a folder here.
    """
    spark = rows.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.gettempdir()}/tables"
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def questions(raw: DataFrame) -> DataFrame:
    """Typed questions with defaults from text columns."""
    yes = parse_bool(F.col("is_answerable"))
    given = lambda c, other: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", other).otherwise(F.trim(F.col(c)))
    return raw.select(
        F.trim("question").alias("question"),
        given("difficulty", F.lit("medium")).alias("difficulty"),
        F.trim("expected_answer").alias("expected_answer"),
        F.trim("source_file").alias("source_file"),
        parse_pages(F.col("source_pages")).alias("source_pages"),
        parse_keywords(F.col("expected_keywords")).alias("expected_keywords"),
        yes.alias("is_answerable"),
        given("question_type", F.when(yes, "answerable").otherwise("true_out_of_scope")).alias("question_type"),
        given("expected_behavior", F.when(yes, "answer").otherwise("refuse")).alias("expected_behavior"),
    )


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    return questions(spark.read.schema(QUESTION).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False))


def resolve_profile(profiles: dict[str, dict], name: str) -> dict:
    """A profile over what it extends: maps by key two levels deep, lists appended once, scalars replaced."""
    own = profiles.get(name) or profiles.get("general") or {}
    base = resolve_profile({k: v for k, v in profiles.items() if k != name}, own["extends"]) if own.get("extends") else {}
    out = dict(base)
    for k, v in own.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = out[k] | {i: (out[k][i] | x if isinstance(x, dict) and isinstance(out[k].get(i), dict) else x) for i, x in v.items()}
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + [x for x in v if x not in out[k]]
        else:
            out[k] = v
    return out


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with new's rows in place of those with the same key; of several new ones the last by ingested_at."""
    w = Window.partitionBy(key).orderBy(F.col("ingested_at").desc())
    last = new.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def write_report(rows: DataFrame, path: str) -> None:
    """CSV with nested values as JSON."""
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns]).write.mode("overwrite").csv(path, header=True, escape='"')


SECRET = re.compile("key|token|secret|password", re.I)


def redact(config: object) -> object:
    """A configuration without the values of secrets; empty ones become null."""
    if isinstance(config, dict):
        return {k: ("***" if v else None) if SECRET.search(str(k)) else redact(v) for k, v in config.items()}
    return [redact(x) for x in config] if isinstance(config, list | tuple) else config


def freeze(config: dict) -> str:
    return json.dumps(redact(config), ensure_ascii=False, indent=2, sort_keys=True, default=str)


def text_stats(texts: Column) -> list[Column]:
    n = F.length(F.coalesce(texts, F.lit("")))
    return [F.count("*").alias("n"), F.coalesce(F.min(n), F.lit(0)).alias("shortest"), F.coalesce(F.max(n), F.lit(0)).alias("longest"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 2).alias("mean"), F.coalesce(F.sum(n), F.lit(0)).alias("total")]
