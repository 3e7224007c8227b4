"""Best-fit packing of token sequences by linear grouping (operator 10).

1. Pieces are counted by length: at most `capacity` counts, whatever the input.
2. Large lengths (over capacity / SMALL) are sorted, cut into GROUPS groups of equal cardinality and rounded up to
   the longest of their group. Patterns of these few sizes are optimised by column generation: a linear program
   over patterns, new patterns from a knapsack. Whole parts of its solution are kept; what they leave open is
   filled by best-fit decreasing on the actual lengths.
3. Actual lengths replace the rounded ones in the patterns' places.
4. Small lengths, longest first, go where they fit best, and open new sequences only if they fit nowhere.

The plan is a table of ranges ("the n-th to m-th piece of this length go to sequences from s on"), whose size depends
on capacity and GROUPS, not on the input. Pieces find their place by their number within their length; numbers are
dealt by (length, bucket), so a length that a third of all pieces have is no single task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordBpe, loaded
from .common import materialize, slices

CAPACITY = 4096
#: Groups of rounded lengths, and the part of a sequence up to which a length is small.
GROUPS = 48
SMALL = 12
END_ID = 1


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32 of each piece of at most capacity tokens. Null text: empty, one token."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: WordBpe = loaded(WordBpe, vocabulary)
        for batch, values in slices(batches, keep=True):
            row, piece, start, length, crc = [], [], [], [], []
            for k, found in enumerate(bpe.encode([v.decode("utf-8", "replace") for v in values])):
                ids = found + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


@dataclass
class Run:
    """count sequences in a row, from first on, that are filled alike."""

    first: int
    count: int
    used: int


class Plan:
    """Where the pieces of each length go: rows of (length, from, to, sequence, offset, per)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> None:
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.taken: dict[int, int] = defaultdict(int)
        self.sequences = 0
        counts = {n: c for n, c in counts.items() if c}
        if any(n < 1 or n > capacity for n in counts):
            raise ValueError("lengths must be from 1 to the capacity")
        large = {n: c for n, c in counts.items() if n * small > capacity}
        self.open: dict[int, list[Run]] = defaultdict(list)  # by free tokens
        self._large(large, groups)
        for n in sorted((n for n in counts if n not in large), reverse=True):
            self._fit(n, counts[n])

    def _place(self, length: int, count: int, first: int, offset: int, per: int = 1) -> None:
        at = self.taken[length]
        self.rows.append((length, at, at + count, first, offset, per))
        self.taken[length] = at + count

    def _new(self, count: int) -> Run:
        run = Run(self.sequences, count, 0)
        self.sequences += count
        return run

    def _keep(self, run: Run) -> None:
        if run.count and run.used < self.capacity:
            self.open[self.capacity - run.used].append(run)

    def _fit(self, length: int, count: int) -> None:
        """Best fit: as many as fit into the fullest sequences that have room, then into new ones."""
        for free in sorted(f for f in self.open if f >= length):
            while count and self.open[free]:
                run = self.open[free].pop()
                per = min(free // length, count)
                whole = min(run.count, count // per)
                if whole < run.count:
                    self._keep(Run(run.first + whole, run.count - whole, run.used))
                self._place(length, whole * per, run.first, run.used, per)
                count -= whole * per
                self._keep(Run(run.first, whole, run.used + per * length))
            if not self.open[free]:
                del self.open[free]
            if not count:
                return
        per = self.capacity // length
        while count:
            many = min(per, count)
            run = self._new(count // many)
            self._place(length, run.count * many, run.first, 0, many)
            count -= run.count * many
            run.used = many * length
            self._keep(run)

    def _large(self, large: dict[int, int], groups: int) -> None:
        total = sum(large.values())
        if not total:
            return
        size = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # of each group: [length, count], longest first
        room = size
        for length in sorted(large, reverse=True):
            left = large[length]
            while left:
                take = min(left, room)
                members[-1].append([length, take])
                left, room = left - take, room - take
                if not room:
                    members.append([])
                    room = size
        members = [m for m in members if m]
        merged: dict[int, list[list[int]]] = {}  # groups of the same rounded length are one size
        for m in members:
            merged.setdefault(m[0][0], []).extend(m)
        sizes = sorted(merged, reverse=True)
        demand = np.array([sum(c for _, c in merged[s]) for s in sizes], np.int64)
        for pattern, times in patterns(np.array(sizes), demand, self.capacity):
            self._substitute([merged[s] for s, k in zip(sizes, pattern, strict=True) for _ in range(k)], times)
        rest: dict[int, int] = defaultdict(int)
        for m in merged.values():
            for length, left in m:
                rest[length] += left
        for length in sorted(rest, reverse=True):
            if rest[length]:
                self._fit(length, rest[length])

    def _substitute(self, slots: list[list[list[int]]], times: int) -> None:
        """times sequences with an actual piece in each slot; runs break where a slot's next length begins."""
        while times:
            step = times
            need: dict[int, int] = defaultdict(int)
            for slot in slots:
                need[id(slot)] += 1
            for slot in slots:
                while slot and not slot[0][1]:
                    slot.pop(0)
            for slot in slots:
                many = need[id(slot)]
                step = min(step, slot[0][1] // many)
            if step:
                run = self._new(step)
                for slot in slots:
                    self._place(slot[0][0], step, run.first, run.used)
                    run.used += slot[0][0]
                    slot[0][1] -= step
            else:  # one sequence over the border of two lengths
                step, run = 1, self._new(1)
                for slot in slots:
                    while not slot[0][1]:
                        slot.pop(0)
                    self._place(slot[0][0], 1, run.first, run.used)
                    run.used += slot[0][0]
                    slot[0][1] -= 1
            self._keep(run)
            times -= step


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth of sizes, each any number of times, that fit together."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int32)
    for k, (size, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if w <= 1e-12:
            continue
        for lo in range(size, capacity + 1, size):  # blocks of a size's width, each from the one before
            hi = min(capacity + 1, lo + size)
            got = best[lo - size : hi - size] + w
            on = got > best[lo:hi] + 1e-12
            best[lo:hi][on] = got[on]
            last[lo:hi][on] = k
    out, at = np.zeros(len(sizes), np.int64), int(best.argmax())
    while at > 0 and last[at] >= 0:
        out[last[at]] += 1
        at -= int(sizes[last[at]])
    return float(best.max()), out


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Patterns and how often to use them, never more of a size than demanded; what is left over is left out."""
    n = len(sizes)
    basis = np.zeros((n, n))
    basis[np.arange(n), np.arange(n)] = capacity // sizes
    x = demand / (capacity // sizes)
    for _ in range(rounds):  # revised simplex: one column in, one out
        dual = np.linalg.solve(basis.T, np.ones(n))
        value, column = _knapsack(sizes, dual, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        on = step > 1e-9
        if not on.any():
            break
        ratio = np.where(on, x / np.where(on, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        x = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    left = demand.copy()
    found: list[tuple[list[int], int]] = []
    for k in np.argsort(-x):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        times = int(x[k] + 1e-6)
        if pattern.any():
            times = min(times, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        if times > 0 and pattern.any():
            left -= times * pattern
            found.append((pattern.tolist(), times))
    return found


#: Ranges of a plan that are broadcast at most; more are joined.
BROADCAST_ROWS = 200_000


def numbered(rows: DataFrame, length: str = "length", by: tuple[str, ...] = (), per_bucket: int = 200_000) -> DataFrame:
    """rows with rank: their number, from 0, among the rows of their length, in buckets of bounded size."""
    spark = rows.sparkSession
    total = rows.count()
    buckets = max(1, min(1 << 20, -(-total // per_bucket)), spark.sparkContext.defaultParallelism)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    own = dealt.groupBy(length, "bucket").count()
    before = own.withColumn("before", F.sum("count").over(Window.partitionBy(length).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(length, "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(length, "bucket").orderBy(*by)) - 1
    return dealt.withColumn("inside", rank).join(before, [length, "bucket"]).withColumn("rank", (F.col("inside") + F.col("before")).cast("long")).drop("bucket", "inside", "before")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A document is its ids, then END_ID; only longer ones are cut. Null and empty texts are one token; repeated rows
    are packed like others; an empty table gives an empty one; other columns don't matter. Texts are read once
    and never move; pieces, of a few numbers each, are written and dealt.
    """
    own = materialize(pieces(docs, vocabulary, capacity, id_col, text_col).withColumnRenamed(id_col, "id"), "pieces")
    spark = own.sparkSession
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length: capacity rows at most
    plan = Plan(counts, capacity)
    rows = spark.createDataFrame(plan.rows, "length long, low long, high long, sequence long, at long, per long")
    ranked = numbered(own, "length", ("id", "piece", "ids_crc32"))
    here = (ranked.length == rows.length) & (ranked["rank"] >= rows.low) & (ranked["rank"] < rows.high)
    if len(plan.rows) <= BROADCAST_ROWS:
        placed = ranked.join(F.broadcast(rows), here)
    else:  # ranges by the stretches of ranks that they touch
        cut = lambda x: F.shiftright(x, 16)
        rows = rows.where("high > low").withColumn("stretch", F.explode(F.sequence(cut(F.col("low")), cut(F.col("high") - 1))))
        here = (ranked.length == rows.length) & (cut(ranked["rank"]) == rows.stretch) & (ranked["rank"] >= rows.low) & (ranked["rank"] < rows.high)
        placed = ranked.join(rows, here)
    inside = F.col("rank") - F.col("low")
    return placed.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        ranked.length,
        "ids_crc32",
        (F.col("sequence") + (inside - F.pmod(inside, F.col("per"))) / F.col("per")).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(inside, F.col("per")) * ranked.length).cast("long").alias("offset"),
    )
