"""Language-model scoring by context-tree weighting (operator 5).

A byte is eight binary decisions, each at a node of a binary tree; a node keeps counts of zeros and ones after each
context of up to DEPTH bytes. At every context Krichevsky-Trofimov estimates of the counts are mixed with what the
contexts one byte longer say, half and half: Pw = Pe / 2 + product of the children's Pw / 2. The weight that training
leaves to a context is Pe / (2 Pw), and a byte's probability mixes the estimates along its context's path by these
weights; a context that training has not seen predicts 1/2.

Counts come from all training texts, and none is left out: the model grows with the corpus. Grams (a byte and the
DEPTH before it) of all texts are counted once each. Contexts that share their last SHARED bytes are mixed together, from the deepest up;
their few nodes at that depth are mixed by their last two bytes, and those of one byte and none, 65,535 at most, on the driver.
On the way back down each gram gets its probability. Words are counted by 64-bit hashes.

Texts are scored with the values of the most frequent grams and words, COMMON of each at most, in tables of every
worker; all others are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, run_bounds, slices, word_hashes, words_of

DEPTH, SHARED = 5, 3
COMMON = 1 << 19
#: Bytes that UTF-8 texts never hold (end) or hardly ever (before the start).
START, END = 0x00, 0xFF
#: Bytes of text that are worked on at once, entries that a counting task holds before it passes them on, and rows of whole contexts that are mixed at once.
CHUNK, HELD, MIXED = 1 << 20, 1_000_000, 200_000
TOKEN, GRAM = 0, 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps up, for positive x."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for k in range(7):
        shift += np.log(x + k)
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 1.1447298858494002


def grams_of(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The DEPTH + 1 bytes up to each byte of the texts, END included, as numbers; where each text's begin."""
    lead = bytes([START]) * DEPTH
    data = np.frombuffer(b"".join(lead + v.lower() + bytes([END]) for v in values), np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, values), np.int64, len(values)) + 1
    ends = np.cumsum(lens + DEPTH)
    code = np.zeros(len(data), np.uint64)
    for k in range(DEPTH + 1):
        code[DEPTH:] |= data[k : len(data) - DEPTH + k] << np.uint64(8 * (DEPTH - k))
    real = np.ones(len(data), bool)
    begin = ends - lens - DEPTH
    for k in range(DEPTH):
        real[begin + k] = False
    return code[real], np.cumsum(lens) - lens


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    if not len(key):
        return key, n
    at = run_bounds(key)
    return key[at], np.add.reduceat(n, at)


def count(docs: DataFrame) -> DataFrame:
    """kind, key and n from (text, train): of training texts hashed tokens and grams; of others their grams, n 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {TOKEN: ([], []), GRAM: ([], [])}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, (keys, counts) in held.items():
                if keys:
                    key, n = summed(keys, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n)], ["kind", "key", "n"])
                    keys.clear()
                    counts.clear()

        for batch, values in slices(batches, limit=CHUNK):
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            parts = [(TOKEN, word_hashes(words_of([v for v, t in zip(values, train, strict=True) if t], lower=True)), 1)]
            for weight in (0, 1):
                parts.append((GRAM, grams_of([v for v, t in zip(values, train, strict=True) if t == weight])[0], weight))
            for kind, found, weight in parts:
                if len(found):
                    key, n = np.unique(found, return_counts=True)
                    held[kind][0].append(key)
                    held[kind][1].append(n.astype(np.int64) * weight)
                    size += len(key)
            if size > 4 * HELD:
                for keys, counts in held.values():
                    if keys:
                        key, n = summed(keys, counts)
                        keys[:], counts[:] = [key], [n]
                size = sum(len(keys[0]) for keys, _ in held.values() if keys)
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    return docs.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _level(context: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node keys (context << 8 | node) in order, with counts of zeros and ones."""
    keys, zeros, ones = [], [], []
    for k in range(8):
        node = (np.uint64(1) << np.uint64(k)) | (last >> np.uint64(8 - k))
        bit = (last >> np.uint64(7 - k)) & np.uint64(1)
        key, where = np.unique(context << np.uint64(8) | node, return_inverse=True)
        keys.append(key)
        ones.append(np.bincount(where, np.where(bit == 1, n, 0), len(key)))
        zeros.append(np.bincount(where, np.where(bit == 0, n, 0), len(key)))
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def _mix(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log Pw and own weight of nodes from their log Pe and the sum of their children's log Pw."""
    both = np.logaddexp(own, children) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def _up(depth: int, key: np.ndarray) -> np.ndarray:
    """The node one byte less deep: the context without its first byte."""
    return key & np.uint64((1 << 8 * depth) - 1)


def _deep(gram: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each depth from DEPTH to SHARED: keys, zeros, ones, log Pw, own weight."""
    last, out = gram & np.uint64(255), {}
    for depth in range(DEPTH, SHARED - 1, -1):
        key, zeros, ones = _level((gram >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1), last, n)
        pw, own = log_kt(zeros, ones), np.ones(len(key))
        if depth < DEPTH:
            below = out[depth + 1]
            pw, own = _mix(pw, np.bincount(np.searchsorted(key, _up(depth + 1, below[0])), below[3], len(key)))
        out[depth] = (key, zeros, ones, pw, own)
    return out


def _middle(depth: int, below: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Keys, zeros, ones, log Pw and own weight of a depth from all (key, zeros, ones, pw) one deeper, and where each of these belongs."""
    key, where = np.unique(_up(depth + 1, below[0]), return_inverse=True)
    zeros, ones, children = (np.bincount(where, x, len(key)) for x in below[1:4])
    return (key, zeros, ones, *_mix(log_kt(zeros, ones), children)), where


def _down(before: np.ndarray, rest: np.ndarray, node: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """What a path predicts up to a node, and the weight that is left for deeper ones, from the same of its parent."""
    _, zeros, ones, _, own = node
    return before + rest * own * (ones + 0.5) / (zeros + ones + 1.0), rest * (1 - own)


def _groups(batches: Iterable[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Rows in order of column key, about MIXED at a time, all of a key together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n > MIXED:
            table = pa.Table.from_batches(held)
            own = table.column(key).to_numpy()
            cut = int(np.searchsorted(own, own[-1]))  # the last key may go on
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n -= cut
    if held:
        yield pa.Table.from_batches(held)


NODES = "key long, zeros double, ones double, pw double"


def weigh(grams: DataFrame) -> DataFrame:
    """key, n and value, log10 of the probability of its last byte after the bytes before, of each gram (key, n)."""

    def columns(table: pa.Table, names: str) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in names.split()]

    def deep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 0):
            gram, n = columns(table, "key n")
            key, zeros, ones, pw, _ = _deep(gram.view(np.uint64), n)[SHARED]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(zeros), pa.array(ones), pa.array(pw)], ["key", "zeros", "ones", "pw"])

    shared = F.shiftright("key", 8).bitwiseAND((1 << 8 * SHARED) - 1).alias("shared")
    pair = F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("pair")
    by_context = grams.select(shared, "key", "n").repartition("shared").sortWithinPartitions("shared")
    nodes = materialize(by_context.mapInArrow(deep, NODES), "nodes")

    def middle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 0):
            key, *rest = columns(table, "key zeros ones pw")
            (key, zeros, ones, pw, _), _ = _middle(2, (key.view(np.uint64), *rest))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(zeros), pa.array(ones), pa.array(pw)], ["key", "zeros", "ones", "pw"])

    by_pair = nodes.select(pair, "key", "zeros", "ones", "pw").repartition("pair").sortWithinPartitions("pair")
    one = F.col("key").bitwiseAND(0xFFFF).alias("key")  # a context of one byte, and the node
    top = by_pair.mapInArrow(middle, NODES).groupBy(one).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "pw")]).toArrow()  # at most 2**16 rows
    key, zeros, ones, children = columns(top.sort_by("key"), "key zeros ones pw")
    key = key.view(np.uint64)
    first = (key, zeros, ones, *_mix(log_kt(zeros, ones), children))
    none, where = _middle(0, first)
    before, rest = _down(np.zeros(len(none[0])), np.ones(len(none[0])), none)
    upper = grams.sparkSession.sparkContext.broadcast((key, *_down(before[where], rest[where], first)))

    def back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, before, rest = upper.value
        for table in _groups(batches, 0):
            key, *sums = columns(table, "key zeros ones pw")
            node, where = _middle(2, (key.view(np.uint64), *sums))
            at = np.searchsorted(keys, _up(2, node[0]))
            b, r = _down(before[at], rest[at], node)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(b[where]), pa.array(r[where])], ["key", "before", "rest"])

    begun = by_pair.mapInArrow(back, "key long, before double, rest double")
    nothing = F.lit(None)
    both = begun.select(shared, "key", nothing.cast("long").alias("n"), "before", "rest").unionByName(grams.select(shared, "key", "n", nothing.cast("double").alias("before"), nothing.cast("double").alias("rest")))

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 0):
            of_nodes = table.column("n").is_null()
            above, own = table.filter(of_nodes).sort_by("key"), table.filter(table.column("n").is_valid())
            (begun_key, before, rest), (gram, n) = columns(above, "key before rest"), columns(own, "key n")
            gram = gram.view(np.uint64)
            levels, values = _deep(gram, n), {}
            for depth in range(SHARED, DEPTH + 1):
                node = levels[depth]
                at = np.searchsorted(begun_key.view(np.uint64), node[0]) if depth == SHARED else np.searchsorted(levels[depth - 1][0], _up(depth, node[0]))
                b, r = (before[at], rest[at]) if depth == SHARED else (values[depth - 1][0][at], values[depth - 1][1][at])
                values[depth] = _down(b, r, node)
            chance, out = values[DEPTH][0], np.zeros(len(gram))  # the deepest own weight is one
            byte = gram & np.uint64(255)
            for k in range(8):
                node = (gram >> np.uint64(8)) << np.uint64(8) | (np.uint64(1) << np.uint64(k)) | (byte >> np.uint64(8 - k))
                p = chance[np.searchsorted(levels[DEPTH][0], node)]
                out += np.log10(np.where((byte >> np.uint64(7 - k)) & np.uint64(1), p, 1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n), pa.array(out)], ["key", "n", "value"])

    return materialize(both.repartition("shared").sortWithinPartitions("shared").mapInArrow(last, "key long, n long, value double"), "grams")


class Table:
    """Values by 64-bit keys, open addressing in two arrays."""

    MULTIPLIER, EMPTY = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(1.4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.EMPTY), np.zeros(1 << self.bits)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == self.EMPTY]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * self.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of keys, 0 for those that aren't there, and which are."""
        at = self.slot(keys)
        seen = self.keys[at]
        hit = seen == keys
        out = np.where(hit, self.values[at], 0.0)
        on = np.flatnonzero(~hit & (seen != self.EMPTY))
        place = at[on]
        while len(on):
            place = (place + 1) & ((1 << self.bits) - 1)
            seen = self.keys[place]
            here = seen == keys[on]
            out[on[here]], hit[on[here]] = self.values[place[here]], True
            more = ~here & (seen != self.EMPTY)
            on, place = on[more], place[more]
        return out, hit


def common(rows: DataFrame) -> Table:
    """The values of the most frequent keys (key, n, value), COMMON at most; of equally frequent ones that don't all fit some, by hash."""
    level = F.floor(8 * F.log2("n"))
    sizes = sorted(((r["level"], r["m"]) for r in rows.where("n > 0").groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()), reverse=True)  # eight for each doubling
    room, some = COMMON, F.lit(False)
    for k, m in sizes:
        some = some | ((level == k) & (F.pmod(F.xxhash64("key"), F.lit(1000)) < min(1000, 950 * room // m) if m > room else level == k))
        room -= m
        if room <= 0:
            break
    found = rows.where((F.col("n") > 0) & some).select("key", "value").limit(COMMON).toArrow()
    return Table(found["key"].to_numpy().view(np.uint64), found["value"].to_numpy())


def _others(kind: int, owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, kind, key and how often, of distinct pairs of owner and key."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    at = run_bounds(owner, key) if len(key) else np.zeros(0, np.int64)
    return owner[at], np.full(len(at), kind, np.int8), key[at].view(np.int64), np.diff(np.append(at, len(key)))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    train: which rows of docs are learned from. Texts are lower-cased (A-Z); null counts as empty, which is one token, the end.
    Repeated rows count as often as they stand; without training texts every bit is even; an empty table gives an
    empty one; other columns don't matter. base_score is the unigram model with add-one smoothing.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    learned = F.coalesce(train, F.lit(False))
    counts = materialize(count(docs.select(text.alias("text"), learned.alias("train"))), "counts")
    texts = docs.select(learned.cast("long").alias("t")).agg(F.sum("t")).first()[0] or 0
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # a row for each kind
    n_all = texts + (sums[TOKEN]["n"] if TOKEN in sums else 0)
    v_all = (sums[TOKEN]["v"] if TOKEN in sums else 0) + (texts > 0)
    n_bytes = sums[GRAM]["n"] if GRAM in sums else 0
    below = float(n_all + v_all + 1)
    end_log = float(np.log10((texts + 1) / below))
    grams = weigh(counts.where(F.col("kind") == GRAM).select("key", "n"))
    words = counts.where(F.col("kind") == TOKEN).select("key", "n", F.log10((F.col("n") + 1) / F.lit(below)).alias("value"))

    tables = spark.sparkContext.broadcast((common(words), common(grams)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_grams = tables.value
        for batch, values in slices(batches, limit=CHUNK):
            n = len(values)
            split = words_of(values, lower=True)
            owner, key = np.repeat(np.arange(n), split.counts), word_hashes(split)
            value, hit = of_words.find(key)
            base = np.bincount(owner, value, n) + end_log
            known = np.bincount(owner[hit], minlength=n) + (texts > 0)
            gram, begin = grams_of(values)
            logs, got = of_grams.find(gram)
            lens = np.diff(np.append(begin, len(gram)))
            rest = zip(_others(TOKEN, owner[~hit], key[~hit]), _others(GRAM, np.repeat(np.arange(n), lens)[~got], gram[~got]), strict=True)
            whose, kind, other, m = (np.concatenate(x) for x in rest)
            order = np.argsort(whose, kind="stable")
            rare = pa.StructArray.from_arrays([pa.array(kind[order]), pa.array(other[order]), pa.array(m[order])], ["kind", "key", "m"])
            at = np.searchsorted(whose[order], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(split.counts + 1), pa.array(known), pa.array(base), pa.array(np.add.reduceat(logs, begin)), pa.array(lens - 1), pa.ListArray.from_arrays(pa.array(at), rare)],
                ["id", "n_tokens", "hit", "base", "score", "n_bytes", "rare"],
            )

    src = docs.select(docs[id_col].alias("id"), text.alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    rows = src.mapInArrow(run, f"id {kind}, n_tokens long, hit long, base double, score double, n_bytes long, rare array<struct<kind: byte, key: long, m: long>>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.kind", "r.key", "r.m")
    seen = words.select(F.lit(TOKEN).cast("byte").alias("kind"), "key", "value").unionByName(grams.select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value"))
    token, m = F.col("kind") == TOKEN, F.col("m")
    found = rare.join(seen, ["kind", "key"], "left").groupBy("row").agg(
        F.sum(F.when(token, m * F.coalesce("value", F.lit(-float(np.log10(below)))))).alias("words"),
        F.sum(F.when(token & F.col("value").isNotNull(), m)).alias("also"),
        F.sum(F.when(~token, m * F.col("value"))).alias("bytes"),
    )
    more = lambda c, to: F.col(c) + F.coalesce(F.col(to), F.lit(0))
    out = rows.drop("rare").join(found, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        more("hit", "also").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        more("base", "words").alias("base_score"),
        more("score", "bytes").alias("score"),
        "n_bytes",
        (-more("score", "bytes") * 3.321928094887362 / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
