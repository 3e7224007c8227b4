"""Near copies by long fingerprints against all pairs of shingle sets."""

import random
from itertools import combinations

import numpy as np

from sextant.llm import similar
from sextant.llm.simhash import forest

rng = random.Random(5)


def words(n):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(999)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_share_of_differing_bits():
    for share in (0.5, 0.8, 0.95):
        a = words(4000)
        cut = int(4000 * 2 * share / (1 + share))
        x, y = " ".join(a).encode(), " ".join(a[:cut] + words(4000 - cut)).encode()
        p, q = np.unpackbits(similar.long_fingerprints([x, y], 5, 4), axis=1)
        assert abs((p != q).mean() - similar.differing(share)) < 0.03


def test_buckets_of_any_size():
    sig = np.random.default_rng(1).integers(0, 1 << 63, (8, 4), dtype=np.uint64)
    near = np.concatenate([sig[[k % 8]] ^ np.uint64(1 << (k % 50)) for k in range(200)])
    for size in (40, 200):
        a, b = similar.bucket_pairs(np.zeros(size, np.int64), np.arange(size), near[:size], 10)
        none = similar.bucket_pairs(np.zeros(size, np.int64), np.arange(size) % 8, near[:size], 10)
        hub, leaf = similar.stars(np.arange(size) // 100, near[:size], 10)
        assert len(none[0]) == 0 and len(hub) == size - 8 * -(-size // 100)
        assert all(x // 100 == y // 100 and x % 8 == y % 8 and x % 100 < 8 for x, y in zip(hub, leaf, strict=True))
        assert {(int(x) % 8, int(y) % 8) for x, y in zip(a, b, strict=True)} == {(k, k) for k in range(8)}
        assert len(set(forest(size, np.minimum(a, b), np.maximum(a, b)).tolist())) == 8


def test_keeps_one_of_each_group(spark):
    rows, n = [], 0
    for _ in range(30):
        base = words(rng.randrange(200, 400))
        for _ in range(rng.randrange(1, 5)):
            near = list(base)
            near[rng.randrange(len(near))] = "other"  # similarity 0.9 and more
            rows.append((n, " ".join(near).upper() if n % 2 else " ".join(near)))
            n += 1
        rows.append((n, " ".join(base[: len(base) // 2] + words(len(base) // 2))))  # half of it: no near copy
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "two words"), (n + 4, "two words"), (n + 5, "two more"), (n + 6, "long " * 30000)]
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sets, 2):
        both = len(sets[a] | sets[b])
        alike = len(sets[a] & sets[b]) / both if both else 1.0
        if alike >= 0.8:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' component_id")
    found = {r["doc_id"]: r["component_id"] for r in similar.groups(frame).collect()}
    wrong = [k for k in found if found[k] != top(k)]
    assert len(found) == len(rows) and not wrong
    kept = similar.keep_one(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {top(k) for k in root}


def test_links_no_text_under_the_similarity(spark):
    rows = []
    for size in (12, 40, 120, 400):
        for _ in range(12):
            base = words(size)
            for share in (1.0, 0.95, 0.9, 0.85, 0.8, 0.7):
                cut = round(size * share)
                rows.append((len(rows), " ".join(base[:cut] + words(size - cut))))
    sets = {k: shingles(t) for k, t in rows}
    link = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want = {k: k for k in sets}
    for _ in range(6):  # groups of at most six
        for a, b in sorted(link):
            want[a] = want[b] = min(want[a], want[b])
    found = {r["doc_id"]: r["component_id"] for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k in sets if found[k] != want[k] and want[found[k]] != want[k]} == set()  # nothing linked wrongly
    missed = [k for k in sets if found[k] != want[k]]
    assert len(missed) <= 0.05 * len(sets), missed


def test_finds_pairs_just_at_the_limit(spark):
    rows = []
    for k in range(600):  # 234 shingles each, 208 of them shared: exactly 0.8
        base = words(212)
        rows += [(2 * k, " ".join(base + words(26))), (2 * k + 1, " ".join(base + words(26)))]
    found = {r["doc_id"]: r["component_id"] for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * k] != found[2 * k + 1] for k in range(600)) <= 3


def test_large_windows_lose_no_pair_to_an_unverified_one():
    sig = np.zeros((100, 4), np.uint64)
    sig[1:, 0] = np.uint64((1 << 30) - 1)  # row 0 is within 50 bits of all others, which are equal but for their last bits
    sig[1:, 1] = np.arange(1, 100)
    pairs = set(zip(*(x.tolist() for x in similar.bucket_pairs(np.zeros(100, np.int64), np.arange(100), sig, 50)), strict=True))
    assert {tuple(sorted(p)) for p in pairs} == set(combinations(range(100), 2))
    dense = []
    assert len(similar.bucket_pairs(np.zeros(100, np.int64), np.arange(100), sig, 50, dense)[0]) == 0 and dense == [(0, 100)]


def test_joining_links_span_all_links():
    """Whatever decides a pair, the links of a group connect what all pairs with this similarity connect, and are a forest."""
    gen = np.random.default_rng(4)
    base = np.arange(60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: 60 - k % 9], gen.integers(1000, 1 << 40, k % 9 + 2, dtype=np.uint64)))) for k in range(120)]
    bits = np.zeros((120, 48), np.uint64)
    for sides in (np.zeros(120, int), np.arange(120) % 2):
        want = {(a, b) for a, b in combinations(range(120), 2) if (sides[0] == sides[1] or sides[a] != sides[b]) and similar.alike_sets(sets[a], sets[b], 0.8)}
        root = np.arange(120) // 2 * 2
        links = list(similar.joining_links(root, sides, bits, np.zeros(120, bool), sets, 50, 5, 20, 0.8))
        assert {tuple(sorted(p)) for p in links} <= want and len(links) < 60
        label = lambda pairs: forest(120, *np.array(sorted({(min(p), max(p)) for p in pairs} | {(k // 2 * 2, k) for k in range(120)})).T)
        assert (label(links) == label(want)).all()
    sure = list(similar.joining_links(np.arange(120), np.zeros(120, int), bits, np.ones(120, bool), [np.zeros(0, np.uint64)] * 120, 50, 5, 20, 0.8))
    assert len(sure) == 119  # equal bits of long texts need no sets


def test_dense_groups_meet_once_in_tiles_and_by_window(spark):
    family = [words(60) for _ in range(2)]
    rows = []
    for k in range(300):  # texts of a family share 32 of 56 shingles, twins nearly all
        own = list(family[k % 2])
        own[40:] = words(20)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:-1], "twin"]))]
    src = spark.createDataFrame(rows, "id long, text string")
    sets = {k: shingles(t) for k, t in rows}
    texts = [t.encode() for _, t in rows]
    bits, n = similar.long_fingerprints(texts, 5, 1), [len(sets[k]) for k, _ in rows]
    classes = src.sparkSession.createDataFrame([(k, b.tobytes(), m) for (k, _), b, m in zip(rows, bits, n, strict=True)], "low long, bits binary, n long").selectExpr("xxhash64(bits) node", "low", "bits", "n")
    node = {r["low"]: r["node"] for r in classes.collect()}
    back = {v: k for k, v in node.items()}
    dense = spark.createDataFrame([(node[k], node[k], key) for k, _ in rows for key in (k // 2 % 2, 10 + k // 2 % 2)], "a long, b long, key long")
    before = similar.GROUP, similar.TILE
    for size in (before, (1 << 30, 40_000), (1000, 60_000)):
        similar.GROUP, similar.TILE = size
        try:
            found = similar.dense_links(dense, classes, src, 256, 0, 1024, 0.8, 5, 1).collect()
        finally:
            similar.GROUP, similar.TILE = before
        assert {tuple(sorted((back[r["a"]], back[r["b"]]))) for r in found} == {(2 * k, 2 * k + 1) for k in range(300)}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar.groups(empty).collect() == [] and similar.keep_one(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in similar.groups(odd).collect()), key=str)
    assert found == sorted([(None, 3), (3, 3), (3, 3), (4, 4)], key=str)
