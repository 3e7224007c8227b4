"""Byte-pair encoding and decoding (operator 2).

Each piece of text is a doubly linked list of symbols with a priority queue of (merge rank, place). The lowest
entry is popped; a merge writes the left symbol, unlinks the right one and queues the pairs on both sides; an entry
whose pair has changed since is stale and skipped. Long pieces take a binary heap (`Merges.heap`). Short pieces are
merged many at a time (`Merges.batch`): a row of an array is the queue of one piece, two more are its links, and a
stale entry is overwritten in place. Decoding concatenates the vocabulary's strings.

Parts of text between white space repeat, so each worker keeps their ids in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import HELD, slices

#: Parts, and pieces of parts, that a worker keeps at most; a table starts anew beyond.
KEPT, KEPT_PIECES = 700_000, 350_000
#: The longest piece, in bytes, that is merged together with others.
SHORT = 40
NONE = np.int32(1 << 30)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + n)
    return [chars[b] for b in range(256)]


class Merges:
    """Merge rules as numbers: left << 20 | right -> rank, and what each rank makes."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "") -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {vocab[a] << 20 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.byte = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        self._made, self._byte, self._last = (np.array(x or [0], np.int64) for x in (self.made, self.byte, self.last))
        self.bits = max(4, (4 * len(pairs)).bit_length())
        keys, ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo = np.array(sorted(self.rank, key=self.rank.get), np.int64)
        worth = np.arange(len(todo), dtype=np.int32)
        at = self._slot(todo)
        while len(todo):  # open addressing: the first at each free slot takes it, the rest go one further
            free = np.flatnonzero(keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            take = free[one]
            keys[at[take]], ranks[at[take]] = todo[take], worth[take]
            rest = np.ones(len(todo), bool)
            rest[take] = False
            todo, worth, at = todo[rest], worth[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.keys, self.ranks = keys, ranks

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NONE)
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[on]]
            hit = found == key[on]
            out[on[hit]] = self.ranks[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out

    def heap(self, piece: bytes) -> list[int]:
        """The symbols of one piece after all merges."""
        symbol = [self.byte[b] for b in piece]
        if not symbol:
            return symbol
        symbol[-1] = self.last[piece[-1]]
        n, made, get = len(symbol), self.made, self.rank.get
        pair = [get(a << 20 | b, -1) for a, b in zip(symbol, symbol[1:], strict=False)]
        pair.append(-1)
        wide = n.bit_length()
        mask = (1 << wide) - 1
        queue = [r << wide | i for i, r in enumerate(pair) if r >= 0]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heappop(queue)
            i = top & mask
            if pair[i] != top >> wide:
                continue  # stale
            symbol[i] = made[pair[i]]
            gone = after[i]
            j = after[i] = after[gone]
            pair[gone] = symbol[gone] = -1
            pair[i] = -1
            if j < n:
                before[j] = i
                r = pair[i] = get(symbol[i] << 20 | symbol[j], -1)
                if r >= 0:
                    heappush(queue, r << wide | i)
            h = before[i]
            if h >= 0:
                r = pair[h] = get(symbol[h] << 20 | symbol[i], -1)
                if r >= 0:
                    heappush(queue, r << wide | h)
        return [s for s in symbol if s >= 0]

    def _rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[:, :width] = self._byte[flat]
        every = np.arange(n)
        symbol[every, size - 1] = self._last[flat[every, size - 1]]
        symbol[np.arange(width + 1) >= size[:, None]] = -1
        pair = np.full((n, width + 1), NONE, np.int32)
        a, b = np.nonzero(symbol[:, 1:] >= 0)
        pair[a, b] = self.ranks_of(symbol[a, b], symbol[a, b + 1])
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
        row = every
        while len(row):
            i = pair[row].argmin(1)
            r = pair[row, i]
            on = r < NONE
            row, i, r = row[on], i[on], r[on]
            if not len(row):
                break
            new = self._made[r]
            symbol[row, i] = new
            gone = after[row, i]
            j = after[row, gone]
            after[row, i] = j
            before[row, np.minimum(j, width)] = i
            symbol[row, gone] = -1
            pair[row, gone] = NONE
            pair[row, i] = NONE
            inside = np.flatnonzero(j < size[row])
            pair[row[inside], i[inside]] = self.ranks_of(new[inside], symbol[row[inside], j[inside]])
            h = before[row, i]
            inside = np.flatnonzero(h >= 0)
            pair[row[inside], h[inside]] = self.ranks_of(symbol[row[inside], h[inside]], new[inside])
        kept = symbol >= 0
        ids = symbol[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [ids[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def batch(self, pieces: list[bytes]) -> list[bytes]:
        """The symbols of each piece, as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        for width, group in groupby(order, key=lambda k: -(-len(pieces[k]) // 4) * 4):
            at = list(group)
            if width == 0:
                continue
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                found = self._rows([pieces[x] for x in part], width) if width <= SHORT else [np.array(self.heap(pieces[x]), "<u4").tobytes() for x in part]
                for x, ids in zip(part, found, strict=True):
                    out[x] = ids
        return out


class Parts:
    """Ids of text, as bytes of little-endian unsigned 32-bit numbers, by a table of parts that don't touch each other."""

    def __init__(self, path: str, suffix: str = "") -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        if self.spec["model"]["type"] != "BPE":
            raise ValueError("not a BPE file")
        self.vocab = self.spec["model"]["vocab"]
        self.merges = Merges(self.vocab, self.spec["model"]["merges"], suffix)
        self.lib = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        of_char = {c: b for b, c in enumerate(byte_symbols())}
        self.to_bytes = lambda text: bytes([of_char[c] for c in text])
        self.pieces: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes | None] = {}

    def of_pieces(self, pieces: list[list[bytes]]) -> list[bytes]:
        """Ids of lists of pieces."""
        new = list({p for many in pieces for p in many} - self.pieces.keys())
        if len(self.pieces) + len(new) > KEPT_PIECES:
            self.pieces = {}
            new = list({p for many in pieces for p in many})
        self.pieces.update(zip(new, self.merges.batch(new), strict=True))
        found = [b"".join(map(self.pieces.__getitem__, many)) for many in pieces]
        for p in new:
            if len(p) > 64:
                del self.pieces[p]
        return found

    def cut(self, text: str) -> list[str] | None:
        """The parts of a text; None if it can't be cut."""
        raise NotImplementedError

    def learn(self, parts: list[str]) -> None:
        """Add parts to the table; None stands for a part whose neighbours matter."""
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        """Ids of a text that isn't cut."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        new = set().union(*(c for c in cuts if c is not None)) - self.parts.keys()
        if len(self.parts) + len(new) > KEPT:
            self.parts = {}
            new = set().union(*(c for c in cuts if c is not None))
        self.learn(list(new))
        out = []
        for text, parts in zip(texts, cuts, strict=True):
            try:
                out.append(self.join(list(map(self.parts.__getitem__, parts))) if parts is not None else self.whole(text))
            except TypeError:  # a None among them
                out.append(self.whole(text))
        for p in new:
            if len(p) > 64:
                del self.parts[p]
        return out

    def join(self, found: list[bytes]) -> bytes:
        return b"".join(found)


class ByteBpe(Parts):
    """A byte-level BPE vocabulary file (version 1.0 JSON) with the usual byte-level pattern."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        pre = self.spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or self.spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: The published byte-level pattern; on ASCII it needs no Unicode tables.
        self.ascii = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", regex.ASCII)
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.strings: list[bytes] = [b""] * size
        for text, i in self.vocab.items():
            self.strings[i] = self.to_bytes(text)
        for text, i in self.special.items():
            self.strings[i] = text.encode()
        self.decimal = [str(i) for i in range(size)]

    def cut(self, text: str) -> list[str] | None:
        """Words one space apart have pieces that don't depend on their neighbours; a line's first word keeps its newline."""
        if any(s in text for s in self.special):
            return None
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    def join(self, found: list[bytes]) -> bytes:
        return b"".join(found)[4:]  # without the newline put before the text

    def _cut_pieces(self, text: str) -> list[bytes]:
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [p.encode() for p in self.ascii.findall(text)]
        return [self.to_bytes(p) for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, parts: list[str]) -> None:
        groups: dict[tuple[bool, bool], list[str]] = {}
        for part in parts:
            inner = part.removeprefix("\n")
            if not inner or inner[0].isspace() or inner[-1].isspace() or "\u180e" in inner:
                self.parts[part] = None
            else:
                groups.setdefault((part is inner or part[0] != "\n", part.isascii()), []).append(part)
        for (spaced, _), own in groups.items():
            pieces = self._cut_pieces("\n".join([" " + p for p in own] if spaced else [p[1:] for p in own]))
            many, now = [], []
            for p in pieces:
                if p == b"\n":
                    many.append(now)
                    now = []
                else:
                    now.append(p)
            many.append(now)
            if not spaced:
                many = [[b"\n", *m] for m in many]
            self.parts.update(zip(own, self.of_pieces(many), strict=True))

    def whole(self, text: str) -> bytes:
        parts = self.split.split(text) if self.split else [text]
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.of_pieces([self._cut_pieces(p)])[0] for p in parts if p)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings one after another; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class WordBpe(Parts):
    """A BPE vocabulary file with word ends: normalised to NFC and lower case, white space dropped, words cut by a pattern."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"]["end_of_word_suffix"] or ""
        super().__init__(path, suffix)
        #: The file's pattern on lower-case ASCII; a space keeps parts apart.
        self.ascii = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+| ", regex.ASCII)
        #: A word of small letters that normalising leaves alone, with signs (no apostrophe) before and after it: a piece each.
        self.simple = re.compile(r"([!-&(-/:-@\[-`{-~]*)([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def lower(self, text: str) -> str | None:
        """text with small letters where that changes no ids; None if it can't be cut."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None  # white space to split() only
        if "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")  # composed letters only
            except UnicodeEncodeError:
                return text
        return text.lower()

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts are cut and their parts numbered as columns; Python sees each different part of a call once."""
        lowered = list(map(self.lower, texts))
        lists = pc.utf8_split_whitespace(pa.array(["" if t is None else t for t in lowered], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [p for p in names if p not in self.parts]
        if len(self.parts) + 2 * len(new) > KEPT:
            self.parts, new = {}, names
        self.learn(new)
        found = list(map(self.parts.__getitem__, names))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        many = size[at]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], many)]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        for p in new:
            if len(p) > 64:
                del self.parts[p]
        return [self.whole(t) if low is None else ids[a:b].tobytes() for t, low, a, b in zip(texts, lowered, bounds, bounds[1:], strict=False)]

    def learn(self, parts: list[str]) -> None:
        plain, other = [], []
        own, joined, rest, simple = set(parts), " ".join(parts), parts, []
        if not any(s in joined for s in self.special):
            rest = []
            for p in parts:
                m = self.simple(p)
                if m:
                    simple.append(m)
                else:
                    rest.append(p)
        stems = list({m[2] for m in simple} - self.parts.keys())
        self.parts.update(zip(stems, self.merges.batch([p.encode() for p in stems]), strict=True))
        signed = [m.groups() for m in simple if m[1] or m[3]]
        signs = list({x for a, _, b in signed for x in (a, b)})
        ids = dict(zip(signs, self.of_pieces([[x.encode()] for x in signs]), strict=True))
        self.parts.update((a + w + b, ids[a] + self.parts[w] + ids[b]) for a, w, b in signed)
        for p in stems:
            if len(p) > 64 and p not in own:
                del self.parts[p]
        for p in rest:
            if any(s in p for s in self.special):
                self.parts[p] = self.whole(p)
            else:
                (plain if p.isascii() else other).append(p)
        many: list[list[bytes]] = [[]]
        for p in self.ascii.findall(" ".join(plain).lower()):
            if p == " ":
                many.append([])
            else:
                many[-1].append(p.encode())
        if plain:
            self.parts.update(zip(plain, self.of_pieces(many), strict=True))
        if not other:
            return
        text = self.lib.normalizer.normalize_str(" ".join(other))
        each = text.split(" ")
        if len(each) != len(other):
            self.parts.update((p, self.whole(p)) for p in other)
            return
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in each), np.int64, len(each)))
        cut = self.lib.pre_tokenizer.pre_tokenize_str(text)
        owner = np.searchsorted(ends, np.fromiter((a for _, (a, _) in cut), np.int64, len(cut)), side="right").tolist()
        many = [[] for _ in other]
        for (p, _), k in zip(cut, owner, strict=True):
            many[k].append(self.to_bytes(p))
        self.parts.update(zip(other, self.of_pieces(many), strict=True))


def loaded(kind: type, path: str):
    """One instance for each worker and file."""
    key = (kind.__name__, path)
    if key not in HELD:
        HELD[key] = kind(path)
    return HELD[key]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, with_ids also ids and decoded.

    vocabulary: path of the file, on every executor. A null or empty text has no tokens and the digests of empty
    strings; repeated rows give repeated rows; an empty table gives an empty one; other columns don't matter.
    One narrow pass: nothing is shuffled, and a worker holds one chunk of texts and tables of bounded size.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: ByteBpe = loaded(ByteBpe, vocabulary)
        sha = hashlib.sha256
        for batch, values in slices(batches, keep=True):
            counts, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for found in bpe.encode([v.decode("utf-8", "replace") for v in values]):
                ids = np.frombuffer(found, "<u4").tolist()
                counts.append(len(ids))
                ids_sha.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                text = bpe.decode(ids)
                text_sha.append(sha(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    texts.append(text)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = src.schema["id"].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if with_ids else ""
    out = src.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    return out.withColumnRenamed("id", id_col)
