"""Helpers that the training-data operators share: scratch tables, bounded chunks of text, words.

Null texts count as empty everywhere unless an operator says otherwise.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker unpacks at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Shuffle files go with the query that wrote them; a written table needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session for tables that cut lineage.

    A cluster names it in spark.checkpoint.dir. Only a local session without the setting gets a folder here.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file:///tmp/checkpoints"
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the scratch folder and read back: computed once, and not again when executors go."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df (case aside) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: str, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


#: Tables that a worker keeps for the next tasks of an operator; another operator's first chunk drops them.
HELD: dict = {}


def trim() -> None:
    """Give freed memory back: workers are kept after their tasks, and what they hold counts for all operators that follow."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, keep: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row ranges of about limit bytes of text, each with its texts as UTF-8 (null: empty); keep: of an operator that uses HELD."""
    if not keep:
        HELD.clear()
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(text))
            column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < batch.num_rows:
                base = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
                yield batch.slice(at, to - at), [v or b"" for v in column.slice(at, to - at).to_pylist()]
                at = to
    finally:
        trim()


@dataclass
class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, one space apart in data."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text its first word, then the number of all

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(values: list[bytes], lower: bool = False) -> Words:
    """bytes.split() splits at exactly the bytes 32 and 9 to 13; lower() changes A-Z only."""
    split = [v.lower().split() if lower else v.split() for v in values]
    first = np.zeros(len(split) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, split), np.int64, len(split)), out=first[1:])
    flat = list(chain.from_iterable(split))
    lens = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(lens + 1) - 1
    return Words(b" ".join(flat) + b" ", ends - lens, ends, first)


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least; kept for the worker's next calls."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (made[0], made[1])
        if size > 8 << 20:
            del _POWERS[base]  # a very long text: not kept
    return have[0][:n], have[1][:n]


class Rolling:
    """64-bit hashes of ranges of items, any range in constant time.

    A prefix polynomial modulo 2**64 with an odd base, divided by the power of its start and mixed.
    """

    def __init__(self, items: np.ndarray, base: int = _BASE) -> None:
        power, self.inverse = powers(len(items) + 1, base)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(items * power[: len(items)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash for each word."""
    return Rolling(_BYTE[np.frombuffer(words.data, np.uint8)]).of(words.starts, words.ends)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def run_bounds(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in sorted columns of at least one row."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
