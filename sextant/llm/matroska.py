"""Media columns in Matroska (operator 6): a writer, and a parser that gives packet tables.

The parser reads EBML elements with variable-length ids and sizes (unknown sizes too), clusters, simple blocks and
block groups, all four kinds of lacing, and cues. A packet has a track, a time, and the byte range of one frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB
SCALE, DURATION, NUMBER, TYPE, UID, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x2AD7B1, 0x4489, 0xD7, 0x83, 0x73C5, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMECODE, SIMPLE, GROUP, BLOCK, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER, VOID = 0xE7, 0xA3, 0xA0, 0xA1, 0xB3, 0xB7, 0xF7, 0xF1, 0xEC
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE, GROUP, CUE_TRACKS, AUDIO}
TOP = {INFO, TRACKS, CLUSTER, CUES, EBML, SEGMENT}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Payloads are padded with spaces to a multiple of UNIT samples of 8 bits; a frame has up to FRAME of them.
UNIT, FRAME, SAMPLE_RATE, FRAMES, BLOCKS = 192, 1536, 8000, 4, 16


def number(n: int, size: int = 0) -> bytes:
    """A variable-length size."""
    size = size or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * size).to_bytes(size, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + number(len(body)) + body


def whole(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], how: int) -> bytes:
    if how == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if how == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif how == EBML_LACING:
        head += number(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            size = next(k for k in range(1, 9) if abs(len(b) - len(a)) < (1 << 7 * k - 1) - 1)
            head += number(len(b) - len(a) + (1 << 7 * size - 1) - 1, size)
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A file of one audio track whose frames are the payload's bytes as 8-bit samples."""
    tick = SAMPLE_RATE // 1000
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, whole(0x4286, 1) + whole(0x42F7, 1) + whole(0x42F2, 4) + whole(0x42F3, 8) + element(0x4282, b"matroska") + whole(0x4287, 4) + whole(0x4285, 2))
    info = element(INFO, whole(SCALE, 1_000_000) + element(DURATION, np.float64(len(payload) / tick).byteswap().tobytes()))
    audio = element(AUDIO, element(RATE, np.float64(SAMPLE_RATE).byteswap().tobytes()) + whole(CHANNELS, 1) + whole(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, whole(NUMBER, 1) + whole(UID, 1) + whole(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], b""
    at = len(info) + len(tracks)
    for c in range(0, len(frames), FRAMES * BLOCKS):
        start = c * FRAME // tick
        blocks = []
        for k in range(c, min(len(frames), c + FRAMES * BLOCKS), FRAMES):
            own = frames[k : k + FRAMES]
            how = NO_LACING if len(own) == 1 else FIXED if len(own[0]) == len(own[-1]) else (XIPH, EBML_LACING)[len(own) % 2]
            blocks.append(element(SIMPLE, number(1) + (k * FRAME // tick - start).to_bytes(2, "big") + bytes([0x80 | how << 1]) + _lace(own, how)))
        cluster = element(CLUSTER, whole(TIMECODE, start) + b"".join(blocks))
        cues += element(CUE, whole(CUE_TIME, start) + element(CUE_TRACKS, whole(CUE_TRACK, 1) + whole(CUE_CLUSTER, at)))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, cues))


@dataclass
class Media:
    """What a file holds: packets as (track, time in ms, offset, size, cluster, key frame), and more."""

    packets: list[tuple[int, float, int, int, int, bool]] = field(default_factory=list)
    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, offset of the cluster in the file
    clusters: list[int] = field(default_factory=list)
    lacing: Counter = field(default_factory=Counter)
    scale: int = 1_000_000
    duration: float = 0.0


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value (with its marker bit if keep), width, and next place; value -1: unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        raise ValueError(f"EBML number cut off at byte {at}")
    n = int.from_bytes(data[at : at + size], "big")
    if not keep:
        n &= (1 << 7 * size) - 1
        if n == (1 << 7 * size) - 1:
            n = -1
    return n, size, at + size


def _block(data: bytes, at: int, end: int, media: Media, base: int, key: bool | None) -> None:
    track, _, at = _vint(data, at)
    time = base + int.from_bytes(data[at : at + 2], "big", signed=True)
    flags, at = data[at + 2], at + 3
    how = flags >> 1 & 3
    media.lacing[("none", "xiph", "fixed", "ebml")[how]] += 1
    sizes: list[int] = []
    if how == NO_LACING:
        sizes = [end - at]
    else:
        many, at = data[at] + 1, at + 1
        if how == FIXED:
            if (end - at) % many:
                raise ValueError(f"uneven fixed lacing before byte {end}")
            sizes = [(end - at) // many] * many
        else:
            for k in range(many - 1):
                if how == XIPH:
                    n = 0
                    while data[at] == 255:
                        n, at = n + 255, at + 1
                    n, at = n + data[at], at + 1
                else:
                    n, size, at = _vint(data, at)
                    if k:
                        n += sizes[-1] - ((1 << 7 * size - 1) - 1)
                sizes.append(n)
            sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError(f"lace sizes pass the block's end at byte {end}")
    for n in sizes:
        media.packets.append((track, time * media.scale / 1e6, at, n, len(media.clusters) - 1, bool(flags & 0x80) if key is None else key))
        at += n


def parse(data: bytes) -> Media:
    """The packet table of a file; ValueError if it is broken or cut off."""
    media, segment = Media(), 0
    base, cue, track = 0, {}, {}
    stack = [(0, len(data))]
    at = 0
    while stack:
        kind_, end = stack[-1]
        if at >= end:
            stack.pop()
            if kind_ == CUE and "cluster" in cue:
                media.cues.append((cue.get("time", 0), cue.get("track", 0), cue["cluster"] + segment))
            if kind_ == TRACK and "number" in track:
                media.tracks[track["number"]] = track
            continue
        kind, _, body = _vint(data, at, keep=True)
        size, _, body = _vint(data, body)
        if kind in TOP and kind_ == CLUSTER and size >= -1 and len(stack) > 1:  # ends a cluster of unknown size
            stack.pop()
            continue
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError(f"element {kind:x} at byte {at} passes its parent's end")
        if size < 0 and kind not in (SEGMENT, CLUSTER):
            raise ValueError(f"element {kind:x} at byte {at} has no size")
        at = body
        if kind in MASTERS:
            if kind == SEGMENT:
                segment = body
            elif kind == CLUSTER:
                media.clusters.append(body)
            elif kind == CUE:
                cue = {}
            elif kind == TRACK:
                track = {}
            stack.append((kind, stop))
            continue
        n = int.from_bytes(data[body:stop], "big") if stop - body <= 8 else 0
        if kind == TIMECODE:
            base = n
        elif kind == SIMPLE:
            _block(data, body, stop, media, base, None)
        elif kind == BLOCK:
            _block(data, body, stop, media, base, False)
        elif kind == SCALE:
            media.scale = n
        elif kind in (DURATION, RATE):
            value = float(np.frombuffer(data[body:stop], f">f{stop - body}")[0]) if stop - body in (4, 8) else 0.0
            if kind == DURATION:
                media.duration = value
            else:
                track["rate"] = value
        elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[{CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}[kind]] = n
        elif kind in (NUMBER, TYPE, CHANNELS, DEPTH):
            track[{NUMBER: "number", TYPE: "type", CHANNELS: "channels", DEPTH: "depth"}[kind]] = n
        elif kind == CODEC:
            track["codec"] = data[body:stop].decode("ascii", "replace")
        at = stop
    return media


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of a track one after another."""
    return b"".join(data[a : a + n] for t, _, a, n, _, _ in media.packets if t == track)


def padded(value: bytes) -> bytes:
    return value + b" " * (max(UNIT, -(-len(value) // UNIT) * UNIT) - len(value))


def feature(media: Media, payload: bytes) -> str:
    samples = np.frombuffer(payload, np.uint8)
    lacing = ",".join(f"{k}:{n}" for k, n in sorted(media.lacing.items()))
    return f"tracks={len(media.tracks)};packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};lacing={lacing};ms={media.duration:g};mean={int(samples.sum()) / len(samples):.3f};peak={int(samples.max())}"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and media: the file that holds the text. Null text: empty, that is one unit of spaces."""
    src = _source(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write(padded(v)) for v in values], pa.binary())], ["id", "media"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, media binary").withColumnRenamed("id", id_col)


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: id_col, n, track, ms, offset, size, cluster, key_frame. Null media: no packets."""
    src = files.select(files[id_col].alias("id"), files[media_col].cast("binary").alias("media"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, "media"):
            found = [(k, n, *p) for k, v in enumerate(values) if v for n, p in enumerate(parse(v).packets)]
            columns = list(zip(*found, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:]], ["id", "n", "track", "ms", "offset", "size", "cluster", "key_frame"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n long, track int, ms double, offset long, size long, cluster int, key_frame boolean").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with the digests of its file and of the payload read back from it.

    Null and empty texts hold one unit of spaces; repeated rows give repeated rows; an empty table an empty one;
    other columns don't matter. One narrow pass, nothing is shuffled.
    """
    src = _source(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches):
            rows = []
            for v in values:
                data = write(padded(v))
                media = parse(data)
                back = payload_of(data, media)
                rows.append((len(v), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, back)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    out = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, {out}").withColumnRenamed("id", id_col)
