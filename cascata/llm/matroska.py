"""Matroska media columns (operator 10): a writer, and a parser into packet tables.

The parser reads variable-length EBML elements (also of unknown size), clusters, SimpleBlocks and
BlockGroups with Xiph, EBML and fixed-size lacing, and cues.  It gives one row per packet with its
track, timestamp in milliseconds, key flag and byte range in the file, so a reader can fetch single
packets.  The writer stores payload bytes as unsigned 8-bit PCM audio, 192 samples a packet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# EBML and Matroska element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, SCALE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x2AD7B1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383

#: Samples of a packet, packets of a laced block, blocks of a cluster, samples of a second.
PACKET, LACE, BLOCKS, SAMPLES_S = 192, 8, 32, 8000
PACKET_MS = 1000 * PACKET // SAMPLES_S


class Packet(NamedTuple):
    track: int
    timestamp_ms: int
    key: bool
    offset: int
    size: int
    cluster: int
    lacing: int


class Cue(NamedTuple):
    timestamp_ms: int
    track: int
    offset: int


def element_id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """A size: as few bytes as can hold it, all ones being kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return element_id(ident) + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace_header(sizes: list[int], kind: int) -> bytes:
    """Lacing header: frame count less one, then the sizes of all frames but the last."""
    head = bytes([len(sizes) - 1])
    if kind == 1:  # Xiph: runs of 255
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3:  # EBML: a size, then signed differences
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head


def write(payload: bytes, lacing: int = 2) -> bytes:
    """A Matroska file whose audio packets are the payload, cut at every PACKET bytes."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(SCALE, 1_000_000) + element(0x4D80, b"cascata") + element(0x5741, b"cascata"))
    audio = element(AUDIO, element(RATE, np.array(SAMPLES_S, ">f4").tobytes()) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, PACKET_MS * 1_000_000) + audio))
    body, cues = [info, tracks], []
    at, step = len(info) + len(tracks), PACKET * LACE
    for first in range(0, len(payload), step * BLOCKS):
        time = first // PACKET * PACKET_MS
        parts = [number(TIMESTAMP, time)]
        for k, lo in enumerate(range(first, min(first + step * BLOCKS, len(payload)), step)):
            data = payload[lo : lo + step]
            sizes = [min(PACKET, len(data) - i) for i in range(0, len(data), PACKET)]
            kind = 0 if len(sizes) == 1 else 3 if lacing == 2 and sizes[-1] != sizes[0] else lacing  # fixed-size lacing needs equal sizes
            flags = 0x80 | kind << 1
            lace = lace_header(sizes, kind) if kind else b""
            parts.append(element(SIMPLE_BLOCK, vint(1) + (k * LACE * PACKET_MS).to_bytes(2, "big") + bytes([flags]) + lace + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """Value and end of the variable-length number; keep: with its length mark, as ids have it.  An unknown size is -1."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no variable-length number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep:
        mask = (1 << 7 * width) - 1
        value = -1 if value & mask == mask else value & mask
    return value, at + width


def elements(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of each element's content. An element of unknown size runs to an id of ``stop`` or to the end.

    Where a file is cut short, elements that hold others are read as far as they go, and a block that is not
    whole is left out.
    """
    while at < end:
        ident, body = _vint(data, at, True)
        if ident in stop:
            return
        if body >= end:
            return
        size, body = _vint(data, body, False)
        if body + size > end and ident in (SIMPLE_BLOCK, BLOCK, BLOCK_GROUP):
            return
        last = end if size < 0 else min(end, body + size)
        if size < 0 and ident == CLUSTER:
            last = body
            for _, _, last in elements(data, body, end, frozenset({CLUSTER, CUES, INFO, TRACKS, SEGMENT})):
                pass
        yield ident, body, last
        at = last


def _number(data: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(data[lo:hi], "big")


def _block(data: bytes, lo: int, hi: int, base: int, scale: float, cluster: int, duration: dict[int, float], key: bool | None) -> Iterator[Packet]:
    track, at = _vint(data, lo, False)
    time = base + int.from_bytes(data[at : at + 2], "big", signed=True)
    flags, at = data[at + 2], at + 3
    kind = flags >> 1 & 3
    if not kind:
        sizes = [hi - at]
    else:
        n, at = data[at] + 1, at + 1
        sizes = []
        if kind == 2:
            sizes = [(hi - at) // n] * n
        else:
            for k in range(n - 1):
                if kind == 1:
                    size = 0
                    while data[at] == 255:
                        size, at = size + 255, at + 1
                    size, at = size + data[at], at + 1
                else:
                    value, end = _vint(data, at, False)
                    size = value if not k else sizes[-1] + value - (1 << 7 * (end - at) - 1) + 1
                    at = end
                sizes.append(size)
            sizes.append(hi - at - sum(sizes))
    for k, size in enumerate(sizes):
        yield Packet(track, round(time * scale + k * duration.get(track, 0)), flags >= 128 if key is None else key, at, size, cluster, kind)
        at += size


def parse(data: bytes) -> tuple[list[Packet], list[Cue]]:
    """All packets in file order, and the cues with byte positions in the file.

    Packets of a block that the file's end cuts off are left out.  Stripped headers and encrypted blocks are
    not undone: byte ranges are those of the stored bytes.
    """
    packets: list[Packet] = []
    cues: list[Cue] = []
    for ident, lo, hi in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        scale, duration, segment, n = 1.0, {}, lo, 0
        for ident, lo, hi in elements(data, segment, hi):  # noqa: B020
            if ident == INFO:
                scale = next((_number(data, a, b) for i, a, b in elements(data, lo, hi) if i == SCALE), 1_000_000) / 1e6
            elif ident == TRACKS:
                for i, a, b in elements(data, lo, hi):
                    if i == TRACK:
                        own = {j: _number(data, c, d) for j, c, d in elements(data, a, b) if j in (TRACK_NUMBER, DEFAULT_DURATION)}
                        duration[own.get(TRACK_NUMBER, 0)] = own.get(DEFAULT_DURATION, 0) / 1e6
            elif ident == CLUSTER:
                base = 0
                for i, a, b in elements(data, lo, hi):
                    if i == TIMESTAMP:
                        base = _number(data, a, b)
                    elif i == SIMPLE_BLOCK:
                        packets += _block(data, a, b, base, scale, n, duration, None)
                    elif i == BLOCK_GROUP:
                        inner = list(elements(data, a, b))
                        key = all(j != REFERENCE for j, _, _ in inner)
                        for j, c, d in inner:
                            if j == BLOCK:
                                packets += _block(data, c, d, base, scale, n, duration, key)
                n += 1
            elif ident == CUES:
                for i, a, b in elements(data, lo, hi):
                    if i == CUE_POINT:
                        point = list(elements(data, a, b))
                        time = next(_number(data, c, d) for j, c, d in point if j == CUE_TIME)
                        for j, c, d in point:
                            if j == CUE_POSITIONS:
                                own = {k: _number(data, e, f) for k, e, f in elements(data, c, d)}
                                cues.append(Cue(round(time * scale), own.get(CUE_TRACK, 0), segment + own.get(CUE_CLUSTER, 0)))
    return packets, cues


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of PACKET bytes."""
    return raw + b" " * (-len(raw) % PACKET if raw else PACKET)


def media_column(docs: DataFrame, lacing: int = 2) -> DataFrame:
    """doc_id, n_bytes (unpadded) and the Matroska file of every row's text; a null text is empty."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([write(pad(r), lacing) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet: the file's key, packet number, track, timestamp_ms, key, byte offset and size, cluster, lacing.

    A null or empty file has no packets.
    """

    def run(batches):
        names = ["packet", *Packet._fields]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [parse(m or b"")[0] for m in part.column(1).to_pylist()]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64()))
                flat = [(k, *p) for f in found for k, p in enumerate(f)]
                columns = list(zip(*flat)) if flat else [()] * len(names)
                kinds = [pa.bool_() if n == "key" else pa.int64() for n in names]
                yield pa.record_batch([keys, *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=[key, *["keyframe" if n == "key" else n for n in names]])

    kind = dict(media.dtypes)[key]
    schema = f"{key} {kind}, packet long, track long, timestamp_ms long, keyframe boolean, offset long, size long, cluster long, lacing long"
    return media.select(key, column).mapInArrow(run, schema)


def features(payload: bytes, packets: list[Packet], cues: list[Cue]) -> str:
    """Counts and signal statistics of what was read back, as text; equal files give equal features."""
    signal = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((signal[1:] >= 0) != (signal[:-1] >= 0)))
    last = packets[-1].timestamp_ms if packets else 0
    return (
        f"packets={len(packets)};clusters={len({p.cluster for p in packets})};cues={len(cues)};last_ms={last}"
        f";sum={int(signal.sum())};energy={int((signal * signal).sum())};crossings={crossings}"
    )


def digests(media: DataFrame) -> DataFrame:
    """What is read back from every file: payload size, digests and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long"

    def row(blob: bytes):
        packets, cues = parse(blob)
        payload = b"".join(blob[p.offset : p.offset + p.size] for p in packets)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), features(payload, packets, cues), len(packets)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                columns = list(zip(*map(row, part.column(2).to_pylist()))) if part.num_rows else [()] * 7
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
