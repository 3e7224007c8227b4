"""SimHash near-duplicates (operator 3).

A 64-bit fingerprint per document, then all pairs of fingerprints within max_distance bits, then components.

Candidates come from pigeonring filtering. With m = max_distance + 1 segments on a ring, two fingerprints within
max_distance have a start from which every chain of l consecutive segments differs in at most
floor(l * max_distance / m) = l - 1 bits. So the first segment is equal, and the next differs in one bit at most:
one of its halves is equal too. Segment plus half is the key of a table; the chain is tested further before the
full Hamming distance. Equal fingerprints are one class throughout, so copies are never paired. Fingerprints of a
key come as a sorted run; a run yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, slices, trim, words_of

#: Seed of XXH64.
SEED = 42
#: Links that meet in one task at most (16 bytes each); more are connected in steps over written tables.
LINKS = 1 << 20


def fingerprints_of(values: list[bytes], shingle: int) -> np.ndarray:
    """Fingerprints of UTF-8 texts: A-Z lower-cased, word shingles with repeats; no word: zero."""
    words = words_of(values, lower=True)
    counts = words.counts
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    ends = np.cumsum(n)
    begin = np.repeat(words.first[:-1], n) + (np.arange(int(n.sum())) - np.repeat(ends - n, n))
    last = np.minimum(begin + shingle, np.repeat(words.first[1:], n)) - 1
    out = np.zeros(len(values), np.uint64)
    if not len(begin):
        return out
    data, digest = words.data, xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(words.starts[begin].tolist(), words.ends[last].tolist(), strict=True)), np.uint64, len(begin))
    some = np.flatnonzero(n)
    for k in range(0, len(some), 2000):  # bounds the unpacked bits, but for a very long text
        part = some[k : k + 2000]
        a, b = int(ends[part[0]] - n[part[0]]), int(ends[part[-1]])
        ones = np.zeros((len(part), 64), np.int64)
        at = ends[part] - n[part] - a
        own = h[a:b]
        for lo in range(0, len(own), 1 << 19):
            hi = min(len(own), lo + (1 << 19))
            bits = np.unpackbits(own[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i = int(np.searchsorted(at, lo, side="right")) - 1
            j = int(np.searchsorted(at, hi, side="left"))
            ones[i:j] += np.add.reduceat(bits, np.maximum(at[i:j] - lo, 0), axis=0, dtype=np.int64)
        most = (ones * 2 > n[part][:, None]).astype(np.uint8)
        out[part] = np.packbits(most, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp, the fingerprint as a signed long, of every row. Null and wordless texts: zero."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(values, shingle).view(np.int64))], ["id", "fp"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def segments(max_distance: int) -> list[tuple[int, int]]:
    """Offset and width of max_distance + 1 segments of 64 bits."""
    m = max_distance + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links a-b connect it to."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != label[label]).any():
            label = label[label]


def run_links(key: np.ndarray, fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of sorted keys: index pairs that connect what links within max_distance connect."""
    parts = segments(max_distance)
    m = len(parts)
    table = (key >> 58).astype(np.int64)
    i = np.flatnonzero(key[1:] == key[:-1])
    if not len(i):
        return i, i
    # per table: the rotation that puts its first segment lowest, and the masks of its chains
    shift = np.array([parts[t // 2][0] for t in range(2 * m)], np.uint64)
    masks = np.zeros((m, 2 * m), np.uint64)
    for t in range(2 * m):
        width = 0
        for n in range(m):
            width += parts[(t // 2 + n) % m][1]
            masks[n, t] = (1 << width) - 1
    own, rot, back = table, shift[table], (np.uint64(64) - shift[table]) & np.uint64(63)
    turned = (fp >> rot) | np.where(rot > 0, fp << back, np.uint64(0))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    held, lag, n = 0, 1, len(key)
    while len(i):
        x = turned[i] ^ turned[i + lag]
        on = np.arange(len(i))
        for chain in range(1, m):  # chain of chain + 1 segments: at most chain bits
            on = on[np.bitwise_count(x[on] & masks[chain, own[i[on]]]) <= chain]
        if len(on):
            pairs.append((i[on], i[on] + lag))
            held += len(on)
            if held > 1_000_000:
                label = forest(n, *map(np.concatenate, zip(*pairs, strict=True)))
                at = np.flatnonzero(label != np.arange(n))
                pairs, held = [(label[at], at)], 0
        lag += 1
        i = i[i + lag < n]
        i = i[key[i + lag] == key[i]]
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = forest(n, *map(np.concatenate, zip(*pairs, strict=True)))
    at = np.flatnonzero(label != np.arange(n))
    return label[at], at


def links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """Columns a, b: links that connect distinct fingerprints (column fp) exactly as all pairs within max_distance do."""
    if not 1 <= max_distance <= 7:
        raise ValueError("max_distance must be from 1 to 7")
    parts = segments(max_distance)
    keys = []
    for s, (at, width) in enumerate(parts):
        to, wide = parts[(s + 1) % len(parts)]
        half = wide // 2
        first = F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1)
        for h, (lo, bits) in enumerate(((0, half), (half, wide - half))):
            rest = F.shiftrightunsigned("fp", to + lo).bitwiseAND((1 << bits) - 1)
            keys.append(F.lit((2 * s + h) << 58).bitwiseOR(F.shiftleft(first, 20)).bitwiseOR(rest))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(k) > 1:
                a, b = run_links(k, f, max_distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(f[a].view(np.int64)), pa.array(f[b].view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                key = np.concatenate((key, batch.column(1).to_numpy()))
                fp = np.concatenate((fp, batch.column(0).to_numpy().view(np.uint64)))
                cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
                yield from found(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield from found(key, fp)

    return rows.mapInArrow(run, "a long, b long").distinct()


def rooted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of all links v-u, with the smallest node of its component."""
    links = [[b.column(k).to_numpy() for k in range(2)] for b in batches if b.num_rows]
    if links:
        v, u = map(np.concatenate, zip(*links, strict=True))
        links.clear()
        node, at = np.unique(np.concatenate((v, u)), return_inverse=True)
        root = node[forest(len(node), at[: len(v)], at[len(v) :])]
        for k in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + (1 << 16)]), pa.array(root[k : k + (1 << 16)])], ["node", "root"])
    trim()


def connect(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for the nodes of edges a-b (numbers).

    Up to LINKS links meet in one task. More take alternating large-star and small-star steps: each keeps the components and
    shortens paths, until every edge points at its root. Every step is a written table, so a lost executor costs one
    step; but it is two queries of many exchanges, and the driver's memory grows with these whatever the number of links.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "links")
    if now.count() <= LINKS:
        kind = now.schema["v"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(rooted, f"node {kind}, root {kind}")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select("v", F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        now = materialize(
            small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small.select("v", F.col("m").alias("u"))).where("u <> v").distinct(), "links"
        )
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("u").cast("decimal(20,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def components(docs: DataFrame, shingle: int = 3, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null, empty and wordless texts have fingerprint zero and are linked like others; repeated rows give repeated
    rows; a null id takes part like any but is never a component_id unless no member has an id; an empty table
    gives an empty one; other columns don't matter. Fingerprints are computed once and written; only they move.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    roots = materialize(connect(links(classes.select("fp"), max_distance)), "roots")
    member = roots.join(classes, roots.node == classes.fp).select("fp", "root", "low")
    best = member.groupBy("root").agg(F.min("low").alias("best"))
    moved = member.join(best, "root").select("fp", "best")
    whole = classes.join(moved, "fp", "left").select("fp", F.coalesce("best", "low").alias("component_id"))
    out = fps.join(whole, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that aren't the first of their component; of rows with the same id all stay or go."""
    mark = free_name(docs, "component_id")
    found = components(docs, shingle, max_distance, id_col, text_col)
    gone = found.where(~F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias(mark)).distinct()
    return docs.join(gone, docs[id_col] == gone[mark], "left_anti")
