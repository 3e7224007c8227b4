"""Substring dedup with difference-cover anchors (operator 1).

Positions are counted in words. COVER is a perfect difference set modulo PERIOD: for any two positions i and j some
shift d < PERIOD puts both i + d and j + d on the cover. Only windows of window - PERIOD + 1 words at cover positions
are hashed (anchors). Two equal windows of `window` words share an anchor at the same shift, whatever their
positions are, so a window whose anchors all stand in one document can't repeat elsewhere.

1. Anchors are sorted by (anchor hash, hash of the anchor extended to all windows that hold it, document). An
   anchor with the same extension in a smaller document settles all those windows at once. An anchor that other
   documents share without the extension leaves its windows open.
2. Open windows of `window` words are hashed (128 bits) and sorted by (hash, document): a window is a repeat if it
   isn't in the smallest document of its run. That document's own windows are never settled in step 1, so the
   smallest one always takes part.
3. Words under repeats go.

Rows of one hash come as a sorted run that is read as a stream, so a passage in a third of all documents takes no
memory, and a document with many repeats moves as one row. No pairs are made. Texts are unpacked CHUNK bytes at a time:
arrays of a word and of a byte take some 60 times a chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, materialize, run_bounds, slices, word_hashes, words_of

#: A perfect difference set modulo 31.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
_ON = np.isin(np.arange(PERIOD), COVER)
_SECOND = 0xC2B2AE3D27D4EB4F
#: Bytes of text that a worker unpacks at once.
CHUNK = 1 << 20


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its text's number, place in the text, hash, and hash of its extension."""
    size = window - PERIOD + 1
    counts = words.counts
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(words.first[:-1], counts)
    total = counts[owner]
    on = np.flatnonzero(_ON[place % PERIOD] & (place + size <= total) & (total >= window))
    owner, place, total = owner[on], place[on], total[on]
    rolling = Rolling(word_hashes(words))
    base = words.first[owner]
    left, right = np.maximum(place - PERIOD + 1, 0), np.minimum(place + window, total)
    with np.errstate(over="ignore"):
        wide = rolling.of(base + left, base + right) + (place - left).astype(np.uint64) * np.uint64(_SECOND)
    return owner, place, rolling.of(base + place, base + place + size), wide


def _anchor_rows(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(a, w, id) of the anchors of (id, text), those that a text repeats once."""
    for batch, values in slices(batches, limit=CHUNK):
        owner, _, a, w = _anchors(words_of(values), window)
        one = _first(owner, a, w)
        owner, a, w = owner[one], a[one], w[one]
        if len(owner):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(w.view(np.int64)), pa.array(batch.column(0).to_numpy()[owner])], ["a", "w", "id"])


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, w, id) to the anchors that several documents share: (id, a, whether the extension repeats)."""
    last_a = last_w = last_id = None
    waiting: list[int] = []  # of the run that goes on, while one document has it: that document, once
    shared = False
    for batch in batches:
        if not batch.num_rows:
            continue
        a, w, i = (batch.column(k).to_numpy() for k in range(3))
        start = run_bounds(a)
        size = np.diff(np.append(start, len(a)))
        run = np.repeat(np.arange(len(start)), size)
        first = i[start]
        many = np.maximum.reduceat(i != first[run], start)
        if last_a is not None and a[0] == last_a:
            many[0] = many[0] or shared or bool(first[0] != last_id_first)
        else:
            waiting, shared = [], False
        begin = run_bounds(a, w)
        lead = np.repeat(i[begin], np.diff(np.append(begin, len(a))))
        if last_a is not None and a[0] == last_a and w[0] == last_w:
            end = begin[1] if len(begin) > 1 else len(a)
            lead[:end] = last_id
        again = i > lead
        if waiting and many[0]:
            yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.int64()), pa.array([last_a], pa.int64()), pa.array([False])], ["id", "a", "again"])
            waiting = []
        on = many[run]
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array(i[on]), pa.array(a[on]), pa.array(again[on])], ["id", "a", "again"])
        same = last_a is not None and a[-1] == last_a and len(start) == 1
        if not same:
            last_id_first = int(first[-1])
        shared = bool(many[-1])
        waiting = [] if shared else [last_id_first]
        last_id = int(lead[-1])
        last_a, last_w = int(a[-1]), int(w[-1])


def _repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h, g, id) to id and h of the rows whose id isn't the first of their (h, g)."""
    last: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, i = (batch.column(k).to_numpy() for k in range(3))
        begin = run_bounds(h, g)
        lead = np.repeat(i[begin], np.diff(np.append(begin, len(h))))
        if last is not None and (h[0], g[0]) == last[:2]:
            lead[: begin[1] if len(begin) > 1 else len(h)] = last[2]
        on = i > lead
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array(i[on]), pa.array(h[on])], ["id", "h"])
        last = (h[-1], g[-1], lead[-1])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and how many each row has (null: none)."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.fromiter((0 if x is None else x for x in column.value_lengths().to_pylist()), np.int64, len(column))


def _state(words: Words, window: int, codes: np.ndarray, lens: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word of the texts: whether a window that begins there is settled, and whether it is open."""
    n = len(words.starts)
    owner, place, hashed, _ = _anchors(words, window)
    mine = np.repeat(np.arange(len(lens)), lens)
    # an anchor's hash may repeat inside a document, with and without a repeated extension: then it settles nothing
    code = hashed.view(np.int64)
    hit = _among(owner, code, mine, codes)
    open_too = _among(owner, code, mine[~again.astype(bool)], codes[~again.astype(bool)])
    done, open_ = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    base = words.first[owner]
    low, high = base + np.maximum(place - PERIOD + 1, 0), base + np.minimum(place, words.counts[owner] - window) + 1
    for marks, on in ((done, hit & ~open_too), (open_, hit)):
        np.add.at(marks, low[on], 1)
        np.add.at(marks, high[on], -1)
    settled = np.cumsum(done[:-1]) > 0
    return settled, (np.cumsum(open_[:-1]) > 0) & ~settled


def _first(*keys: np.ndarray) -> np.ndarray:
    """Places of one of each combination of keys."""
    order = np.lexsort(keys[::-1])
    return np.sort(order[run_bounds(*(k[order] for k in keys))]) if len(order) else order


def _windows(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and two hashes of the windows that begin at words."""
    hashes = word_hashes(words)
    owner = np.searchsorted(words.first, at, side="right") - 1
    return owner, Rolling(hashes).of(at, at + window), Rolling(hashes, _SECOND).of(at, at + window)


def _among(owner: np.ndarray, code: np.ndarray, found_owner: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which (owner, code) are found; both sides without an order."""
    both_o, both_c = np.concatenate((found_owner, owner)), np.concatenate((found, code))
    if not len(both_o):
        return np.zeros(0, bool)
    order = np.lexsort((both_c, both_o))
    start = run_bounds(both_o[order], both_c[order])
    size = np.diff(np.append(start, len(order)))
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(np.logical_or.reduceat((order < len(found)), start), size)
    return out[len(found) :]


def mark(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """docs with kept_text (kept words one space apart), n_words and n_removed; carry: other columns to keep.

    as_is: a text that loses no word is its own kept_text, null included, and n_words and n_removed are left out.

    id_col must be a whole number. Null and empty texts have no words; texts of fewer words than window lose none;
    rows with the same id are one document for the comparison (neither removes from the other); a null id is a
    document of its own that is larger than all. An empty table gives an empty one.
    """
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words or more")
    key, carry = "__id", list(carry or [])
    biggest = (1 << 63) - 1
    src = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(biggest)).alias("id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"c{k}") for k, c in enumerate(carry)], docs[id_col].alias(key))

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _anchor_rows(batches, window)

    rows = src.select("id", "text").mapInArrow(anchors, "a long, w long, id long").repartition("a").sortWithinPartitions("a", "w", "id")
    shared = rows.mapInArrow(_settled, "id long, a long, again boolean")
    lists = shared.groupBy("id").agg(F.collect_list(F.struct("a", "again")).alias("s")).select("id", F.col("s.a").alias("a"), F.col("s.again").alias("again"))
    joined = materialize(src.join(lists, "id", "left"), "anchored")
    hit = joined.where("a is not null")

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, limit=CHUNK):
            words = words_of(values)
            codes, lens = _flat(batch.column(2))
            again, _ = _flat(batch.column(3))
            at = np.flatnonzero(_state(words, window, codes, lens, again)[1])
            if len(at):
                owner, h, g = _windows(words, at, window)
                one = _first(owner, h, g)  # a window that a text repeats goes once
                columns = [h[one].view(np.int64), g[one].view(np.int64), batch.column(0).to_numpy()[owner[one]]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["h", "g", "id"])

    found = hit.select("id", "text", "a", "again").mapInArrow(windows, "h long, g long, id long").repartition("h").sortWithinPartitions("h", "g", "id")
    repeats = found.mapInArrow(_repeats, "id long, h long").groupBy("id").agg(F.collect_list("h").alias("repeats"))
    columns = [f"c{k}" for k in range(len(carry))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(key, *columns).schema.fields)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, limit=CHUNK):
            words = words_of(values)
            codes, lens = _flat(batch.column(2))
            again, _ = _flat(batch.column(3))
            begins, open_ = _state(words, window, codes, lens, again)
            found, many = _flat(batch.column(4))
            at = np.flatnonzero(open_)
            owner, h, _ = _windows(words, at, window)
            begins[at[_among(owner, h.view(np.int64), np.repeat(np.arange(len(many)), many), found)]] = True
            cover = np.zeros(len(begins) + window, np.int64)
            starts = np.flatnonzero(begins)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
            gone = np.cumsum(cover)[: len(begins)] > 0
            before = np.concatenate((np.zeros(1, np.int64), np.cumsum(gone)))
            flat = words.data.split()
            texts = []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                if before[a] == before[b]:
                    texts.append(values[len(texts)] if as_is else b" ".join(flat[a:b]))
                else:
                    texts.append(b" ".join([flat[k] for k in (a + np.flatnonzero(~gone[a:b])).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[5:], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words.counts), pa.array(before[words.first[1:]] - before[words.first[:-1]])],
                [key, *columns, "kept_text", "n_words", "n_removed"],
            )

    def untouched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, limit=CHUNK):
            split = [v.split() for v in values]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([b" ".join(s) for s in split], pa.binary()).cast(pa.string()), pa.array(list(map(len, split)), pa.int64()), pa.array(np.zeros(len(split), np.int64))],
                [key, *columns, "kept_text", "n_words", "n_removed"],
            )

    out = f"{schema}, kept_text string, n_words long, n_removed long"
    changed = hit.join(repeats, "id", "left").select("id", "text", "a", "again", "repeats", key, *columns).mapInArrow(finish, out)
    plain = joined.where("a is null").select("text", key, *columns)
    plain = plain.withColumnRenamed("text", "kept_text") if as_is else plain.mapInArrow(untouched, out)
    whole = changed.drop("n_words", "n_removed").unionByName(plain) if as_is else changed.unionByName(plain)
    counts = [] if as_is else ["n_words", "n_removed"]
    return whole.select(F.col(key).alias(id_col), *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], "kept_text", *counts)


def remove(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words out of text_col; a text that loses none stays as it is. Every row stays."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    renamed = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].alias(f"o{k}") for k, c in enumerate(others)])
    done = mark(renamed, window, "id", "text", [f"o{k}" for k in range(len(others))], as_is=True)
    back = {id_col: F.col("id"), text_col: F.col("kept_text")} | {c: F.col(f"o{k}") for k, c in enumerate(others)}
    return done.select(*[back[c].alias(c) for c in docs.columns])
