"""Matroska media columns: EBML elements, clusters, lacing and cues.

`mux` stores 8-bit samples as a PCM track; `parse` walks any Matroska file's
elements (variable-length ids and sizes, unknown sizes included) into a packet
table: track, timestamp, byte range, key flag and place in the lace, for simple
blocks and block groups, with none, Xiph, fixed-size or EBML lacing.  Only
offsets are taken from the file, so a packet is a byte range that a reader can
fetch on its own; the cue table gives the cluster to start from.

Cases: a null text is the empty text.  Bytes that are not Matroska, a cut file
and a null column give what was parsed up to there, at worst no packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

UNIT = 576
RATE = 8000
LACE = 8
BLOCKS = 32

# Element ids of the Matroska specification.
EBML, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACING, CODEC, FRAME_NS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_PLACE}


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return _id(ident) + _size(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(ident: int, x: float) -> bytes:
    return element(ident, struct.pack(">d", x))


def lace(frames: list[bytes], how: str) -> tuple[int, bytes]:
    """(flag bits, body) of a block's frames."""
    if how == "none" or len(frames) == 1:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    if how == "fixed":
        return 0x04, head + b"".join(frames)
    if how == "xiph":
        return 0x02, head + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
    sizes = _size(len(frames[0]))
    for a, b in zip(frames[:-2], frames[1:-1], strict=True):
        step = len(b) - len(a)
        width = next(w for w in range(1, 9) if abs(step) < 1 << (7 * w - 1))
        sizes += _size(step + (1 << (7 * width - 1)) - 1, width)
    return 0x06, head + sizes + b"".join(frames)


def mux(samples: bytes, unit: int = UNIT, rate: int = RATE, per_block: int = LACE, per_cluster: int = BLOCKS, how: str = "fixed") -> bytes:
    """A Matroska file of unsigned 8-bit mono samples in frames of `unit` bytes."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
    step = unit * 1000 // rate
    count = -(-len(samples) // unit)
    info = element(INFO, number(SCALE, 1_000_000) + real(DURATION, float(count * step)) + element(MUXER, b"strandline") + element(WRITER, b"strandline"))
    audio = element(AUDIO, real(FREQUENCY, float(rate)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, int(how != "none")) + number(FRAME_NS, step * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    per_block = 1 if how == "none" else per_block
    wide = per_block * per_cluster
    for first in range(0, count, wide):
        parts = [number(TIMESTAMP, first * step)]
        for block in range(first, min(count, first + wide), per_block):
            frames = [samples[k * unit : (k + 1) * unit] for k in range(block, min(count, block + per_block, first + wide))]
            flags, data = lace(frames, how)
            parts.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (block - first) * step, 0x80 | flags) + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE, number(CUE_TIME, first * step) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    tracks: list[dict] = field(default_factory=list)
    clusters: int = 0
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)  # track, ms, offset, size, key, place in lace
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # ms, track, offset of the cluster


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int, int]:
    """(value, next offset, width); keep: with the marker, as in an id."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError("no marker")
    value = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise IndexError
    return (value if keep else value & ((1 << 7 * width) - 1)), at + width, width


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    if not lacing:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        size = (end - at) // n
        return [(at + k * size, size) for k in range(n)]
    sizes: list[int] = []
    while len(sizes) < n - 1:
        if lacing == 1:
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
        else:
            value, at, width = _vint(data, at, False)
            sizes.append(sizes[-1] + value - (1 << (7 * width - 1)) + 1 if sizes else value)
    sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes | None) -> Media:
    found = Media()
    try:
        _walk(data or b"", found)
    except (IndexError, ValueError, struct.error):
        pass  # a cut or foreign file: what came before stands
    return found


def _walk(data: bytes, m: Media) -> None:
    at, segment, cluster_ms, track, cue, group = 0, 0, 0, {}, [0, 0], None
    while at < len(data):
        ident, body, _ = _vint(data, at, True)
        size, body, width = _vint(data, body, False)
        end = len(data) if size == (1 << 7 * width) - 1 else body + size
        if ident in MASTERS:
            if ident == SEGMENT:
                segment = body
            elif ident == CLUSTER:
                m.clusters += 1
            elif ident == TRACK:
                track = {}
                m.tracks.append(track)
            elif ident == GROUP:
                group = None
            at = body
            continue
        if end > len(data):
            raise IndexError
        value = data[body:end] if size <= 8 or ident == CODEC else b""
        if ident == TIMESTAMP:
            cluster_ms = int.from_bytes(value, "big")
        elif ident in (SIMPLE, BLOCK):
            own, place, _ = _vint(data, body, False)
            step, flags = struct.unpack(">hB", data[place : place + 3])
            group = len(m.packets)
            frames = _frames(data, place + 3, end, (flags >> 1) & 3)
            key = bool(flags & 0x80) or ident == BLOCK
            each = next((t.get("frame_ns", 0) for t in m.tracks if t.get("number") == own), 0) // 1_000_000
            m.packets += [(own, cluster_ms + step + k * each, a, n, key, k) for k, (a, n) in enumerate(frames)]
        elif ident == REFERENCE and group is not None:
            m.packets[group:] = [(*p[:4], False, p[5]) for p in m.packets[group:]]
        elif ident in (NUMBER, KIND, CHANNELS, DEPTH, FRAME_NS):
            track[{NUMBER: "number", KIND: "kind", CHANNELS: "channels", DEPTH: "depth", FRAME_NS: "frame_ns"}[ident]] = int.from_bytes(value, "big")
        elif ident == CODEC:
            track["codec"] = value.decode("ascii", "replace")
        elif ident == FREQUENCY:
            track["rate"] = struct.unpack(">d" if size == 8 else ">f", value)[0]
        elif ident == CUE_TIME:
            cue[0] = int.from_bytes(value, "big")
        elif ident == CUE_TRACK:
            cue[1] = int.from_bytes(value, "big")
        elif ident == CUE_CLUSTER:
            m.cues.append((cue[0], cue[1], segment + int.from_bytes(value, "big")))
        at = end


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """All columns of `docs` (but one of that name) and the text's payload as a Matroska file."""
    own = [c for c in docs.columns if c != media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array([mux(payload_of(t.as_py())[1]) for t in part.column(text)], pa.binary())], [*own, media])

    return tv.arrow(docs.select(*dict.fromkeys([*own, text]))).mapInArrow(run, docs.select(*own).schema.add(media, "binary"))


def packet_table(rows: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a packet: track, timestamp_ms, byte_offset, byte_size, is_key, lace_index and cue_offset (the last cue at or before it)."""
    names = ["track", "timestamp_ms", "byte_offset", "byte_size", "is_key", "lace_index", "cue_offset"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(media)):
                m = parse(value.as_py())
                if not m.packets:
                    continue
                places = sorted((ms, at) for ms, _, at in m.cues)
                where = np.searchsorted([p[0] for p in places], [p[1] for p in m.packets], "right")
                cue = [places[k - 1][1] if k else None for k in where]
                columns = [pa.array(x, kind) for x, kind in zip([*zip(*m.packets, strict=True), cue], kinds, strict=True)]
                own = pa.array([i] * len(m.packets))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in keep), *columns], [*keep, *names])

    schema = rows.select(*keep).schema
    for name, kind in zip(names, ("integer", "long", "long", "long", "boolean", "integer", "long"), strict=True):
        schema = schema.add(name, kind)
    return tv.arrow(rows.select(*dict.fromkeys([*keep, media]))).mapInArrow(run, schema)


def read_back(data: bytes, m: Media, track: int = 1) -> bytes:
    """The track's bytes, from the packets' byte ranges in order of time."""
    return b"".join([data[p[2] : p[2] + p[3]] for p in sorted((p for p in m.packets if p[0] == track), key=lambda p: (p[1], p[2]))])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text"):
            n, payload = payload_of(text.as_py())
            stored = mux(payload)
            m = parse(stored)
            back = read_back(stored, m)
            samples = np.frombuffer(back, np.uint8)
            feature = f"packets={len(m.packets)};clusters={m.clusters};cues={len(m.cues)};ms={m.packets[-1][1] if m.packets else 0};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max(initial=0))};crossings={int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))}"
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op9_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a Matroska file, parsed again, and described from what was read back."""
    schema = docs.select("doc_id").schema
    for name, kind in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    return tv.arrow(docs.select(F.col("doc_id"), F.col("text"))).mapInArrow(_digest, schema)
