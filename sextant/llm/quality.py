"""Quality rules with adaptive thresholds (operator 9).

Ratios of each text (symbols per word, repeated lines per line, repeated words per word, word length) go into
mergeable quantile sketches per language and source: counts of buckets whose bounds grow by the factor GAMMA, so a
quantile is right within GAMMA - 1 relative to its value and sketches merge by adding counts. A group of fewer than
MIN_ROWS texts takes the sketch of its language, a small language that of all texts. Upper limits are the upper quartile
plus REACH times the spread between the quartiles, the least spread being a parameter; word length has a lower limit
too. Limits are joined back to the texts' ratios and filter them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Rolling, materialize, slices, word_hashes, words_of

#: Sketch: relative error, values up to that count as zero, and the most buckets of a ratio.
GAMMA, TINY, BUCKETS = 1.02, 1e-3, 2000
MIN_ROWS, REACH = 200, 4.0
#: Ratio -> least spread between its quartiles.
SPREAD = {"symbols": 0.02, "lines": 0.085, "repeats": 0.06, "length": 0.1}
#: Bytes of text that a worker unpacks at once: arrays of a word and of a byte take many times as much.
CHUNK = 1 << 20
SYMBOLS = b"#*$%&|<>"
#: Base rules: fewest words; words in repeated windows of REPEAT words, in hundredths.
LEAST_WORDS, REPEAT, MOST_REPEATED = 20, 8, 30
SPACE = b" \t\n\r\x0b\x0c"

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts_of(values: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts of UTF-8 texts, and n_lines: lines with a word."""
    words = words_of(values)
    data = np.frombuffer(words.data, np.uint8)
    edge = np.append(words.starts, len(data))[words.first]
    total = lambda on: np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(on, dtype=np.int64)))[edge])
    n = words.counts
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(words.first[:-1], n)
    at = np.flatnonzero(place + REPEAT <= n[owner])
    covered = np.zeros(len(owner) + 1, np.int64)
    if len(at):
        hashed = Rolling(word_hashes(words)).of(at, at + REPEAT)
        order = np.lexsort((hashed, owner[at]))
        h, o = hashed[order], owner[at][order]
        same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        begin = at[order[twice]]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + REPEAT, -1)
    repeated = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.cumsum(covered[:-1]) > 0)))
    n_lines, n_dup = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for k, v in enumerate(values):
        lines = [x for x in v.split(b"\n") if x.strip(SPACE)]
        n_lines[k], n_dup[k] = len(lines), len(lines) - len(set(lines))
    return {
        "n_words": n,
        "word_chars": total(((data & 0xC0) != 0x80) & (data != 32)),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated[words.first[1:]] - repeated[words.first[:-1]],
        "n_lines": n_lines,
    }


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the base counts of every row. Null texts have no words."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, limit=CHUNK):
            found = counts_of(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *map(pa.array, found.values())], ["id", "lang", "source", *found])

    longs = ", ".join(f"{c} long" for c in (*BASE, "n_lines"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang string, source string, {longs}")


def ratios(count: Callable[[str], Column] = F.col) -> dict[str, Column]:
    part = lambda a, b: F.when(count(b) > 0, count(a) / count(b)).otherwise(F.lit(0.0))
    return {"symbols": part("n_symbols", "n_words"), "lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "length": part("word_chars", "n_words")}


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys, ratio and bucket of rows with a word."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("x")) for k, v in ratios().items()])).alias("p")
    bucket = F.when(F.col("p.x") <= TINY, 0).otherwise(F.least(F.lit(BUCKETS), F.ceil(F.log(F.col("p.x") / TINY) / F.log(F.lit(GAMMA)))))
    return rows.where("n_words > 0").select(*keys, pairs).select(*keys, "p.ratio", bucket.cast("int").alias("bucket")).groupBy(*keys, "ratio", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, rows, q1 and q3 of sketches."""
    w = Window.partitionBy(*keys, "ratio")
    upto = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("rows", F.sum("n").over(w))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.lit(TINY) * F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("rows") * q, value))
    return upto.groupBy(*keys, "ratio").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def limits(rows: DataFrame) -> DataFrame:
    """lang, source and the limits of each ratio: a row for each pair of lang and source (null is a value)."""
    own = sketch(rows, ["lang", "source"])
    by_lang = merge(own, ["lang"])
    found = quartiles(own, ["lang", "source"])
    wide = quartiles(by_lang, ["lang"]).select(F.col("lang").alias("l"), F.col("ratio").alias("r"), F.col("rows").alias("lang_rows"), F.col("q1").alias("lang_q1"), F.col("q3").alias("lang_q3"))
    every = quartiles(merge(by_lang, []), []).select(F.col("ratio").alias("e"), F.col("q1").alias("all_q1"), F.col("q3").alias("all_q3"))
    joined = found.join(wide, found.lang.eqNullSafe(wide.l) & (found.ratio == wide.r)).join(F.broadcast(every), F.col("ratio") == F.col("e"))  # every: one row for each ratio
    pick = lambda q: F.when(F.col("rows") >= MIN_ROWS, F.col(q)).when(F.col("lang_rows") >= MIN_ROWS, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))
    spread = F.greatest(pick("q3") - pick("q1"), F.element_at(F.create_map(*[F.lit(x) for kv in SPREAD.items() for x in kv]), F.col("ratio")))
    bound = joined.select("lang", "source", "ratio", (pick("q3") + REACH * spread).alias("high"), (pick("q1") - REACH * spread).alias("low"))
    one = lambda k, c: F.max(F.when(F.col("ratio") == k, F.col(c))).alias(f"{c}_{k}")
    return bound.groupBy("lang", "source").agg(*[one(k, "high") for k in SPREAD], one("length", "low"))


#: Limits up to so many rows are broadcast.
BROADCAST_ROWS = 100_000


def judged(rows: DataFrame, bounds: DataFrame, lang: Column, source: Column) -> tuple[DataFrame, Column, Column]:
    """rows joined with the limits of their lang and source, whether they fail the base rules, and whether they are kept; counts are in column counted."""
    named = bounds.withColumnsRenamed({"lang": "own lang", "source": "own source"} | {c: f"own {c}" for c in bounds.columns if c not in ("lang", "source")})
    few = bounds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(named) if few else named, lang.eqNullSafe(F.col("`own lang`")) & source.eqNullSafe(F.col("`own source`")), "left")
    count = lambda c: F.col(f"`own counted`.{c}")
    failed = (count("n_words") < LEAST_WORDS) | (100 * count("n_repeat_words") > MOST_REPEATED * count("n_words"))
    found = ratios(count)
    inside = F.col("`own low_length`") <= found["length"]
    for k, v in found.items():
        inside = inside & (v <= F.col(f"`own high_{k}`"))
    return joined, failed, ~failed & F.coalesce(inside, F.lit(False))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row per row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts fail the base rules; null lang or source is a group of its own; repeated rows count as
    often as they stand; an empty table gives an empty one; other columns don't matter. Texts are read once, only
    counts move.
    """
    rows = materialize(counted(docs, id_col, text_col, lang_col, source_col), "counts")
    bounds = materialize(limits(rows), "limits")
    whole = rows.select("id", "lang", "source", F.struct(*BASE, "n_lines").alias("own counted"))
    joined, failed, kept = judged(whole, bounds, F.col("lang"), F.col("source"))
    return joined.select(F.col("id").alias(id_col), *[F.col(f"`own counted`.{c}").alias(c) for c in BASE], failed.alias("base_failed"), kept.alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs whose text is kept; rows that share an id are judged each by its text.

    Texts are counted twice, for the limits and again beside them, so that none of them moves.
    """
    rows = counted(docs, id_col, text_col, lang_col, source_col).drop("id")
    bounds = materialize(limits(materialize(rows, "counts")), "limits")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, text_col, CHUNK):
            found = counts_of(values)
            struct = pa.StructArray.from_arrays([pa.array(found[c]) for c in (*BASE, "n_lines")], [*BASE, "n_lines"])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, "own counted"])

    schema = StructType([*docs.schema.fields, StructField("own counted", StructType([StructField(c, LongType()) for c in (*BASE, "n_lines")]))])
    joined, _, kept = judged(docs.mapInArrow(run, schema), bounds, F.col(f"`{lang_col}`").cast("string"), F.col(f"`{source_col}`").cast("string"))
    return joined.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
