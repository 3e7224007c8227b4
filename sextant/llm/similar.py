"""Near copies by long SimHash fingerprints (operator 3 at a similarity that 64 bits can't tell).

Two texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in 15 % of the bits of their
fingerprints: about 10 of 64, give or take 3, and no segment of a useful width is sure to be equal. So the
fingerprint is long. It is cut into windows, and equal windows make candidates; there are so many windows that a
pair at the wanted similarity shares one with probability RECALL. The first CHECK bits travel with every row of a
window. They hold the first windows whole, so a pair that shares one of these is not made again in a later window.
Windows widen with the logarithm of the number of rows, so buckets stay small. Sums of differences over a chain of 64-bit segments prune the candidates of a bucket, at NEAR standard deviations over what
a pair at the wanted similarity differs in. All bits then sort the candidates: those far over the wanted similarity are links, those far below are none, and the sets of shingles
themselves decide the pairs between, and all pairs of short texts, whose bits are less independent.

Every shingle is a sparse vector of SPARSE signs in SLOTS slots; a text's vector is their sum, and signs of its
Walsh-Hadamard transforms are the bits. This costs a few additions per shingle however long the fingerprint is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, free_name, materialize, mix64, run_bounds, slices, trim, word_hashes, words_of
from .simhash import connect, fingerprints_of, forest, links

SLOTS, SPARSE, CHECK = 1024, 5, 256
#: Windows of the first two passes: enough to connect most of a large group by stars, and to gather the rest of it in dense windows.
FIRST = 16
#: Classes of which the ids are broadcast at most; beyond, a join by id.
BROADCAST_ROWS = 200_000
#: Probability that a pair at the limit shares a window; standard deviations over its mean that the first CHECK bits may differ in.
RECALL, NEAR = 0.9999, 4
#: Words of a shingle of operator 3.
RING = 3
#: Shingles of a text from which bits alone may settle a pair, and standard deviations from the limit that it takes.
LONG, MARGIN = 128, 5
#: Bytes of fingerprints and shingle sets of a group that is compared as a whole, and of a chunk of it.
GROUP, TILE = 256 << 20, 24 << 20


def differing(similarity: float) -> float:
    """Share of bits in which fingerprints of sets with this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit(similarity: float, n_bits: int, deviations: float) -> int:
    """Differing bits of n_bits that sets with this similarity stay within, up to so many standard deviations over the mean."""
    p = differing(similarity)
    return round(n_bits * p + deviations * math.sqrt(n_bits * p * (1 - p)))


def windows(similarity: float, rows: int) -> tuple[int, int]:
    """Width of a window, at most 32 bits, and the number of windows."""
    width = min(32, max(16, math.ceil(math.log2(max(rows, 1))) - 8))
    hit = (1 - differing(similarity)) ** width
    return width, math.ceil(math.log(1 - RECALL) / math.log1p(-hit))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def shingle_sets(values: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs of text number and shingle hash: A-Z lower-cased; fewer words than a shingle: all; none: no pair."""
    words = words_of(values, lower=True)
    counts = words.counts
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    ends = np.cumsum(n)
    text = np.repeat(np.arange(len(values)), n)
    begin = words.first[:-1][text] + np.arange(int(n.sum())) - (ends - n)[text]
    last = np.minimum(begin + shingle, words.first[1:][text])
    h = Rolling(word_hashes(words)).of(begin, last) if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
        text, h = text[new], h[new]
    return text, h


def long_fingerprints(values: list[bytes], shingle: int, rounds: int) -> np.ndarray:
    """rounds * SLOTS bits, packed, of every UTF-8 text; no word: all ones."""
    return fingerprint_bits(*shingle_sets(values, shingle), len(values), rounds)


def fingerprint_bits(text: np.ndarray, h: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """rounds * SLOTS bits, packed, of n texts from their shingle_sets."""
    signs = 1 - 2 * (mix64(np.arange(1, rounds * SLOTS + 1, dtype=np.uint64)) >> np.uint64(63)).astype(np.float32).reshape(rounds, SLOTS)
    out = np.zeros((n, rounds * SLOTS // 8), np.uint8)
    for at in range(0, n, 256):
        to = min(n, at + 256)
        a, b = np.searchsorted(text, (at, to))
        vector = np.zeros((to - at) * SLOTS)
        for k in range(SPARSE):
            with np.errstate(over="ignore"):
                x = mix64(h[a:b] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1))
            slot = (text[a:b] - at) * SLOTS + (x & np.uint64(SLOTS - 1)).astype(np.int64)
            vector += np.bincount(slot, 1.0 - 2.0 * (x >> np.uint64(63)).astype(np.float64), len(vector))
        rows = vector.reshape(-1, SLOTS).astype(np.float32)
        for r in range(rounds):
            out[at:to, r * SLOTS // 8 : (r + 1) * SLOTS // 8] = np.packbits(hadamard(rows * signs[r]) >= 0, axis=1)
    return out


def distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which rows of a and b (CHECK bits as unsigned longs) differ in at most `most` bits."""
    on = np.arange(max(len(a), len(b)))
    a, b = np.broadcast_arrays(a, b)
    total = np.zeros(len(on), np.int64)
    for k in range(CHECK // 64):  # the sum over a chain of segments only grows
        total = total + np.bitwise_count(a[on, k] ^ b[on, k])
        keep = total <= most
        on, total = on[keep], total[keep]
    return on


def stars(key: np.ndarray, sig: np.ndarray, most: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within `most` bits inside runs of equal sorted keys: each row with the first of its run that is near it, unless both have one root."""
    a, b, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(key))
    while len(rest) > 1:
        new = run_bounds(key[rest])
        hub = np.repeat(rest[new], np.diff(np.append(new, len(rest))))
        other = rest != hub
        hub, rest = hub[other], rest[other]
        on = distances(sig[hub], sig[rest], most)
        new = on if root is None else on[root[hub[on]] != root[rest[on]]]
        a.append(hub[new])
        b.append(rest[new])
        rest = np.delete(rest, on)
    return np.concatenate(a), np.concatenate(b)


def by_root(root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which those of a root stand together, the most frequent root last, and for each place in it where its root ends."""
    _, own, size = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((own, size[own]))
    edge = np.append(run_bounds(own[order]), len(order))
    return order, np.repeat(edge[1:], np.diff(edge))


def near_pairs(sig: np.ndarray, after: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of different roots within `most` bits of rows in the order of by_root, some rows at a time."""
    end, step = int(np.searchsorted(after, len(after))), max(1, min(64, (1 << 20) // len(after)))
    for at in range(0, end, step):  # pairs inside the last root are none
        to, begin = min(end, at + step), int(after[at])
        far = np.zeros((to - at, len(sig) - begin), np.int64)
        for k in range(sig.shape[1]):
            far += np.bitwise_count(sig[at:to, k, None] ^ sig[None, begin:, k])
        i, j = np.nonzero((far <= most) & (np.arange(begin, len(sig)) >= after[at:to, None]))
        yield i + at, j + begin


def met_before(x: np.ndarray, y: np.ndarray, window: np.ndarray, width: int) -> np.ndarray:
    """Which rows of x and y (CHECK bits as unsigned longs) share a window of this width before the given one, of those that CHECK bits hold whole."""
    lanes, out = CHECK // width, np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 14):
        to = at + (1 << 14)
        differ = np.unpackbits((x[at:to] ^ y[at:to]).view(np.uint8), axis=1)[:, : lanes * width].reshape(-1, lanes, width).any(axis=2)
        out[at:to] = (~differ & (np.arange(lanes) < window[at:to, None])).any(axis=1)
    return out


def bucket_pairs(key: np.ndarray, root: np.ndarray, sig: np.ndarray, most: int, dense: list[tuple[int, int]] | None = None, width: int | None = None, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different roots within `most` bits inside runs of equal sorted keys.

    width: of windows, whose numbers are the keys' upper 32 bits; pairs that an earlier one of the first windows has are
    left to that. met: numbers of groups that have met as a whole, whose pairs are left out as well. dense: takes begin and end of the runs with more pairs than rows, whose pairs are left out, so that pairs are never more than rows.
    """
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def new(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if met is not None:
            apart = met[x] != met[y]
            x, y = x[apart], y[apart]
        if width is not None:
            first = ~met_before(sig[x], sig[y], key[x] >> 32, width)
            x, y = x[first], y[first]
        return x, y

    i, lag = np.flatnonzero(np.repeat(size <= 64, size)[:-1] & (key[1:] == key[:-1])), 1
    while len(i):
        apart = i[root[i] != root[i + lag]]
        on = apart[distances(sig[apart], sig[apart + lag], most)]
        x, y = new(on, on + lag)
        a.append(x)
        b.append(y)
        lag += 1
        i = i[i + lag < len(key)]
        i = i[key[i + lag] == key[i]]
    if dense is not None:
        x, y = np.concatenate(a), np.concatenate(b)
        run = np.searchsorted(edge, x, side="right") - 1
        over = np.bincount(run, minlength=len(size)) > size
        a, b = [x[~over[run]]], [y[~over[run]]]
        dense += [(int(edge[r]), int(edge[r + 1])) for r in np.flatnonzero(over)]
    for r in np.flatnonzero(size > 64):
        sides = [x[edge[r] : edge[r + 1]] for x in (root, met) if x is not None]
        # of the larger group no pairs are tried; those of the other kind are left out after
        order, after = by_root(max(sides, key=lambda x: np.unique(x, return_counts=True)[1].max()))
        order += edge[r]
        held, n = len(a), 0
        for i, j in near_pairs(sig[order], after, most):
            x, y = order[i], order[j]
            apart = root[x] != root[y]
            x, y = new(x[apart], y[apart])
            a.append(x)
            b.append(y)
            n += len(x)
            if dense is not None and n > size[r]:
                del a[held:], b[held:]
                dense.append((int(edge[r]), int(edge[r + 1])))
                break
    return np.concatenate(a), np.concatenate(b)


def alike_sets(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-6:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def joining_links(root: np.ndarray, side: np.ndarray, bits: np.ndarray, long: np.ndarray, sets: list[np.ndarray], check: int, sure: int, most: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Index pairs that are links and join what roots and the pairs before them leave apart: fewer than rows, of all pairs of rows.

    Whole fingerprints decide pairs of long texts, sets of shingles all others. Unless all sides are equal, only rows of different sides are paired.
    """
    order, after = by_root(root)
    bits, long, side = bits[order], long[order], side[order]
    _, own = np.unique(root[order], return_inverse=True)
    up = list(range(int(own.max()) + 1))
    mixed = bool((side != side[0]).any())

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for i, j in near_pairs(np.ascontiguousarray(bits[:, : CHECK // 64]), after, check):
        if mixed:
            cross = side[i] != side[j]
            i, j = i[cross], j[cross]
        for at in range(0, len(i), 1 << 14):
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            far = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            link = (far <= sure) & long[x] & long[y]
            for on in (np.flatnonzero(link), np.flatnonzero(~link & (far <= most))):
                for k in on.tolist():
                    p, q = top(own[x[k]]), top(own[y[k]])
                    if p != q and (link[k] or alike_sets(sets[order[x[k]]], sets[order[y[k]]], similarity)):
                        up[max(p, q)] = min(p, q)
                        yield int(order[x[k]]), int(order[y[k]])


def candidates(classes: DataFrame, most: int, width: int, begin: int, end: int, first: bool) -> DataFrame:
    """Columns a, b, key: pairs of classes (node long, root long, met long, bits binary) that share a window from begin to end and differ in at most `most` of the first CHECK bits.

    first: the stars of each window, around hubs that differ from window to window; otherwise, without pairs of one met and each pair
    once where the CHECK bits show it, all pairs of different roots, but of a dense window its rows: node,
    root and the window's key, which is null for pairs.
    """
    used = end - begin

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n = batch.num_rows
                bits = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, -1)
                flat = np.unpackbits(bits, axis=1)[:, width * begin : width * end].reshape(n, used, width)
                weight = 1 << np.arange(width, dtype=np.int64)
                key = flat @ weight + (np.arange(begin, end, dtype=np.int64) << 32)
                sig = np.repeat(np.ascontiguousarray(bits[:, : CHECK // 8]), used, axis=0).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.reshape(-1)),
                        *(pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), used)) for k in range(3)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(CHECK // 8), n * used, [None, pa.py_buffer(sig)]).cast(pa.binary()),
                    ],
                    ["key", "node", "root", "met", "sig"],
                )

    rows = classes.select("node", "root", "met", "bits").mapInArrow(cut, "key long, node long, root long, met long, sig binary").repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, root, met, sig = *(np.zeros(0, np.int64) for _ in range(4)), np.zeros((0, CHECK // 64), np.uint64)

        def found(to: int) -> Iterator[pa.RecordBatch]:
            if to > 1:
                dense: list[tuple[int, int]] = []
                if first:
                    order = np.lexsort((mix64((node[:to] ^ key[:to]).view(np.uint64)), key[:to]))
                    a, b = (order[x] for x in stars(key[order], sig[order], most, root[order]))
                else:
                    a, b = bucket_pairs(key[:to], root[:to], sig[:to], most, dense, width, met[:to])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])
                for x, y in dense:
                    yield pa.RecordBatch.from_arrays([pa.array(node[x:y]), pa.array(root[x:y]), pa.array(key[x:y])], ["a", "b", "key"])

        for batch in batches:
            if batch.num_rows:
                key, node, root, met = (np.concatenate((x, batch.column(k).to_numpy())) for k, x in enumerate((key, node, root, met)))
                sig = np.concatenate((sig, np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(batch.num_rows, -1)))
                at = int(np.searchsorted(key, key[-1]))  # the last run may go on
                yield from found(at)
                key, node, root, met, sig = key[at:], node[at:], root[at:], met[at:], sig[at:]
        yield from found(len(key))
        trim()

    return rows.mapInArrow(run, "a long, b long, key long").distinct()


def dense_links(dense: DataFrame, classes: DataFrame, src: DataFrame, check: int, sure: int, most: int, similarity: float, shingle: int, rounds: int, whole_groups: list[DataFrame] | None = None) -> DataFrame:
    """Columns a, b: links that join the rows of dense windows (a: node, b: root, key) as all links of their pairs would.

    Dense windows repeat the same rows, so rows that windows connect are one group, which meets once, with fingerprints
    and shingle sets. A group over GROUP bytes is left to its windows, each a group of its own. Groups are cut into chunks of TILE
    bytes, and every two chunks meet in a tile, so no task holds more than two. A tile gives fewer links than it has rows.
    whole_groups: takes node and met, the group, of the rows of which all pairs meet.
    """
    dense = materialize(dense, "dense")
    first = dense.groupBy("key").agg(F.min("a").alias("rep"))
    cluster = connect(dense.join(first, "key").select("a", F.col("rep").alias("b")).where("a <> b").distinct()).withColumnRenamed("root", "cluster")
    nodes = dense.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    own = only(classes, nodes)
    sets = materialize(sets_of(own, src, shingle, rounds), "sets")
    rows = nodes.join(cluster, "node").join(own.select("node", "bits", (F.col("n") >= LONG).alias("long")), "node").join(sets, "node")
    rows = materialize(rows.withColumn("size", F.length("bits") + F.length("hashes")), "dense-rows")
    small = rows.groupBy("cluster").agg(F.sum("size").alias("whole")).select("cluster", (F.col("whole") <= GROUP).alias("small"))
    whole = rows.join(small, "cluster")
    if whole_groups is not None:
        whole_groups.append(materialize(whole.where("small").select("node", F.col("cluster").alias("met")).distinct(), "met"))
    by_cluster = whole.where("small").select(F.lit(0).alias("kind"), F.col("cluster").alias("group"), "node", "root", "bits", "long", "hashes", "size")
    by_window = whole.where("not small").join(dense.select(F.col("a").alias("node"), "key"), "node").select(F.lit(1).alias("kind"), F.col("key").alias("group"), "node", "root", "bits", "long", "hashes", "size")
    every = by_cluster.unionByName(by_window)
    chunks = every.groupBy("kind", "group").agg(F.ceil(F.sum("size") / F.lit(TILE)).cast("int").alias("chunks"))
    cut = every.join(chunks, ["kind", "group"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["kind", "group", "one", "two"]
    tiles = met.select("kind", "group", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "node", "root", "bits", "long", "hashes")
    tiles = tiles.repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def found() -> Iterator[pa.RecordBatch]:
            chunk, node, root = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (4, 5, 6))
            bits = np.concatenate([np.frombuffer(b"".join(x.column(7).to_pylist()), np.uint64).reshape(x.num_rows, -1) for x in held])
            long = np.concatenate([x.column(8).to_numpy(zero_copy_only=False) for x in held])
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for x in held for v in x.column(9)]
            if name[2] == name[3] or (chunk != chunk[0]).any():
                pairs = list(joining_links(root, chunk, bits, long, sets, check, sure, most, similarity))
                if pairs:
                    a, b = np.array(pairs).T
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(k).to_numpy() for k in range(4)]
                edge = [*run_bounds(*columns).tolist(), batch.num_rows]
                for x, y in zip(edge, edge[1:], strict=False):
                    here = tuple(int(c[x]) for c in columns)
                    if held and here != name:
                        yield from found()
                        held.clear()
                    name = here
                    held.append(batch.slice(x, y - x))
        if held:
            yield from found()
        trim()

    return tiles.mapInArrow(run, "a long, b long")


def few(rows: DataFrame) -> bool:
    """Whether a written table is small enough to go to every executor."""
    return rows.count() <= BROADCAST_ROWS  # from the footers of its files


def only(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The classes in column node of nodes, as a table of their own; fingerprints stay where they are unless nodes are many."""
    ends = materialize(nodes.select("node").distinct(), "ends")
    return materialize(classes.join(F.broadcast(ends) if few(ends) else ends, "node", "left_semi"), "only")


def sorted_out(pairs: DataFrame, classes: DataFrame, sure: int, most: int) -> DataFrame:
    """Columns a, b, sure: the pairs whose whole fingerprints differ in at most `most` bits; sure: two long texts, `sure` bits."""
    own = only(classes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left = own.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("m"))
    right = own.select(F.col("node").alias("b"), F.col("bits").alias("y"), "n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1) for k in (2, 3))
                far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((far <= sure) & batch.column(4).to_numpy(zero_copy_only=False))], ["a", "b", "sure"])
                yield out.filter(pa.array(far <= most))

    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "x", "y", (F.least("m", "n") >= LONG).alias("long")).mapInArrow(run, "a long, b long, sure boolean")


def sets_of(own: DataFrame, src: DataFrame, shingle: int, rounds: int) -> DataFrame:
    """Columns node, hashes: sorted shingle hashes, 8 bytes each, of the classes in a written table."""
    # if it is small it goes to the texts, and they stay where they are
    first = own.select("low")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in slices(batches, limit=1 << 20):
            text, h = shingle_sets(values, shingle)
            edge = np.searchsorted(text, np.arange(len(values) + 1))
            bits = fingerprint_bits(text, h, len(values), rounds)
            hashes = [h[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(hashes, pa.binary())], ["bits", "hashes"])

    # Rows may share an id, so the class of a text is found from its bits again.
    first = F.broadcast(first) if few(own) else first
    texts = src.join(first, src["id"].eqNullSafe(first["low"]), "left_semi").select("text")
    return texts.mapInArrow(run, "bits binary, hashes binary").groupBy(F.xxhash64("bits").alias("node")).agg(F.min("hashes").alias("hashes"))


def alike(unsure: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets have at least this Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                near[k] = alike_sets(*(np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3)), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    possible = F.least(F.length("x"), F.length("y")) >= similarity * F.greatest(F.length("x"), F.length("y")) - 1e-6
    return unsure.join(left, "a").join(right, "b").where(possible).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def ring_links(fps: DataFrame, max_distance: int) -> DataFrame:
    """Columns a, b: operator 3's links (column fp, at most max_distance bits apart) between the classes (column node) that have its fingerprints."""
    own = materialize(fps.select("node", "fp").distinct(), "own")
    first = materialize(own.groupBy("fp").agg(F.min("node").alias("rep")), "rep")
    same = own.join(first, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    found = links(first.select("fp"), max_distance)
    left, right = first.select(F.col("fp").alias("a"), F.col("rep").alias("x")), first.select(F.col("fp").alias("b"), F.col("rep").alias("y"))
    across = found.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return materialize(same.unionByName(across).where("a <> b"), "ring")


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_distance: int | None = None) -> DataFrame:
    """A row per row of docs: id_col and component_id, the smallest id reachable over near copies, itself included.

    With max_distance texts that operator 3 links (three-word shingles, so many bits of 64) are near copies as well: its
    fingerprints, pigeonring filter and links come first, and long fingerprints pair what these leave apart. Equal fingerprints are one class throughout, so copies are never paired. Null, empty and wordless texts are
    copies of each other; repeated rows give repeated rows; a null id is never a component_id unless no member
    has an id; an empty table gives an empty one; other columns don't matter.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    width, count = windows(similarity, docs.count())
    rounds = -(-max(CHECK, width * count) // SLOTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, limit=1 << 20):
            text, h = shingle_sets(values, shingle)
            bits = fingerprint_bits(text, h, len(values), rounds)
            n = np.bincount(text, minlength=len(values)).astype(np.int64)
            fp = np.zeros(len(values), np.uint64) if max_distance is None else fingerprints_of(values, RING)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(n), pa.array(fp.view(np.int64))], ["id", "bits", "n", "fp"])

    made = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, bits binary, n long, fp long").select("id", F.xxhash64("bits").alias("node"), "bits", "n", "fp")
    fps = materialize(made, "fingerprints")
    classes = materialize(fps.groupBy("node").agg(F.min("id").alias("low"), F.min("bits").alias("bits"), F.min("n").alias("n")), "classes")
    check = limit(similarity, CHECK, NEAR)
    sure, most = (limit(similarity, rounds * SLOTS, k * MARGIN) for k in (-1, 1))

    def long_links(of: DataFrame, begin: int, end: int, first: bool, met: list[DataFrame] | None = None) -> DataFrame:
        found = materialize(candidates(of, check, width, begin, end, first), "pairs")
        near = materialize(sorted_out(found.where("key is null").select("a", "b"), classes, sure, most), "near")
        unsure = near.where(~F.col("sure")).select("a", "b")
        known = near.where("sure").select("a", "b")
        # every query takes threads and memory of the driver, also where it has no row
        if not unsure.isEmpty():
            own = only(classes, unsure.select(F.explode(F.array("a", "b")).alias("node")))
            known = known.unionByName(alike(unsure, materialize(sets_of(own, src, shingle, rounds), "sets"), similarity))
        dense = found.where("key is not null")
        if not first and not dense.isEmpty():
            known = known.unionByName(dense_links(dense, classes, src, check, sure, most, similarity, shingle, rounds, met))
        return materialize(known, "found")

    def rooted(known: DataFrame | None, met: DataFrame | None = None) -> DataFrame:
        out = classes.select("node", "bits")
        out = out.withColumn("root", F.col("node")) if known is None else out.join(connect(known), "node", "left").withColumn("root", F.coalesce("root", "node"))
        out = out.withColumn("met", F.col("node")) if met is None else out.join(met, "node", "left").withColumn("met", F.coalesce("met", "node"))
        return out.select("node", "root", "met", "bits")

    # The stars of a large group are few pairs and make one component of most of it; then only what they left apart is
    # paired. What is near but no link would be paired in every window: the first windows gather it in groups that meet
    # as a whole, and the other windows leave these out.
    ring = None if max_distance is None else ring_links(fps, max_distance)
    cut = min(count, FIRST)
    some = long_links(rooted(ring), 0, cut, True)
    some = some if ring is None else some.unionByName(ring)
    groups_met: list[DataFrame] = []
    rest = some.unionByName(long_links(rooted(some), 0, cut, False, groups_met))
    if cut < count:
        rest = rest.unionByName(long_links(rooted(rest, *groups_met), cut, count, False))
    roots = materialize(connect(rest), "roots")
    member = roots.join(classes.select("node", "low"), "node")
    moved = member.join(member.groupBy("root").agg(F.min("low").alias("best")), "root").select("node", "best")
    whole = classes.select("node", "low").join(moved, "node", "left").select("node", F.coalesce("best", "low").alias("component_id"))
    return fps.select("id", "node").join(whole, "node").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_distance: int | None = None) -> DataFrame:
    """docs without the rows that aren't the first of their group; of rows with the same id all stay or go."""
    mark = free_name(docs, "component_id")
    found = groups(docs, shingle, similarity, id_col, text_col, max_distance)
    gone = materialize(found.where(~F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias(mark)).distinct(), "gone")  # its size decides how they meet
    return docs.join(gone, docs[id_col] == gone[mark], "left_anti")
