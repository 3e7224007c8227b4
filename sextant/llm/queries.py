"""The operators over the test tables: one query each, with production parameters and no subset of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, language, matroska, packing, quality, simhash, substring, toxicity, wrapper
from .common import fold_of


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file; another may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.mark(_docs(spark, sf_dir), 50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_docs(spark, sf_dir), shingle=3, max_distance=3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of("id", 5)
    found = toxicity.score(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"), fold != 0)
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of("doc_id", 7)
    found = ctw.score(_docs(spark, sf_dir), F.coalesce(fold != 2, F.lit(True)))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.round_trip(_docs(spark, sf_dir))


def op7_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of("doc_id", 3)
    found = language.predict(_docs(spark, sf_dir), fold != 1)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_docs(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_bpe, op3_simhash, op4_toxicity, op5_ctw, op6_matroska, op7_wrapper, op8_language, op9_quality, op10_packing)
    return {f.__name__: f for f in own}
