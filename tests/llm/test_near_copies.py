"""The near-copy stage: operator 3's links and long fingerprints, and pairs that don't outnumber rows."""

import random

import corpus_pipeline as c
import numpy as np
from sextant.llm import similar, simhash


def test_operator_3_links_near_copies_too(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(21))
    texts = [" ".join([passage] * 30 + [word() for _ in range(40)]) for _ in range(2)] + [" ".join(word() for _ in range(100)) for _ in range(5)]
    a, b = simhash.fingerprints_of([t.encode() for t in texts[:2]], 3)
    assert int(np.bitwise_count(a ^ b)) <= 3  # but their sets of shingles share less than half
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len({r["component_id"] for r in similar.groups(docs).collect()}) == 7
    assert sorted(r["doc_id"] for r in c.near_copies(spark, docs, "").collect()) == [0, 2, 3, 4, 5, 6]


def test_pairs_of_a_small_window_are_no_more_than_its_rows():
    rng = np.random.default_rng(1)
    sig = np.tile(rng.integers(0, 1 << 63, 4, np.uint64), (43, 1))
    key = np.array([1] * 40 + [2] * 3)
    dense: list[tuple[int, int]] = []
    a, _ = similar.bucket_pairs(key, np.arange(43), sig, 10, dense)
    assert dense == [(0, 40)] and len(a) == 3
    assert len(similar.bucket_pairs(key, np.arange(43), sig, 10)[0]) == 40 * 39 // 2 + 3


def test_candidates_of_a_large_group_are_not_made_again_in_every_window(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(400)]
    # all pairs share about 7 of 10 shingles: near by their first bits, and none a link
    docs = spark.createDataFrame([(k, " ".join(base[:330] + [word() for _ in range(70)])) for k in range(400)], "doc_id long, text string")
    made, write = [], similar.materialize

    def counted(rows, name):
        out = write(rows, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(similar, "materialize", counted)
    assert len({r["component_id"] for r in similar.groups(docs).collect()}) == 400
    assert sum(made) <= 2 * 16 * 400, made  # once a row in each of the first windows at most, in two passes


def test_pairs_of_an_earlier_window_or_a_group_that_met_are_left_out():
    rng = np.random.default_rng(2)
    sig = np.tile(rng.integers(0, 1 << 63, 4, np.uint64), (3, 1))
    sig.view(np.uint16)[1] ^= np.uint16(1)  # row 1 shares no window of 16 bits with the others
    for size in (1, 40):  # runs of both kinds
        rows = np.repeat(sig, size, axis=0)
        key, side = np.full(len(rows), 5 << 32), np.arange(len(rows)) // size
        roots = np.arange(len(rows))
        pairs = lambda **more: {(int(side[x]), int(side[y])) for x, y in zip(*similar.bucket_pairs(key, roots, rows, 20, **more), strict=True)}
        assert {(0, 1), (0, 2), (1, 2)} <= {tuple(sorted(p)) for p in pairs()}
        assert {tuple(sorted(p)) for p in pairs(width=16)} == {(0, 1), (1, 2)}
        assert {tuple(sorted(p)) for p in pairs(width=16, met=side // 2)} == {(1, 2)}
