import hashlib
import random
import zlib

import pytest

from cascata.llm import matroska as mk

from .helpers import docs_frame, odd_rows


@pytest.mark.parametrize("lacing", [1, 2, 3])
@pytest.mark.parametrize("size", [192, 1536, 1537, 5000, 192 * 8 * 32 + 192, 200_000])
def test_round_trip(lacing, size):
    payload = random.Random(size).randbytes(size)
    media = mk.write(payload, lacing)
    packets, cues = mk.parse(media)
    assert b"".join(media[p.offset : p.offset + p.size] for p in packets) == payload
    assert all(p.track == 1 and p.key for p in packets)
    assert [p.timestamp_ms for p in packets] == [k * mk.PACKET_MS for k in range(len(packets))]
    for cue in cues:
        assert int.from_bytes(media[cue.offset : cue.offset + 4], "big") == mk.CLUSTER
    assert len(cues) == max(p.cluster for p in packets) + 1


def test_foreign_layouts():
    """Unknown sizes, block groups, uneven EBML and Xiph lacing, several tracks, void elements, wide sizes."""
    void = mk.element(0xEC, b"\0" * 9)
    sizes = [3, 300, 7, 520]
    frames = [bytes([k]) * n for k, n in enumerate(sizes)]
    tracks = mk.element(mk.TRACKS, b"".join(mk.element(mk.TRACK, mk.number(mk.TRACK_NUMBER, t) + mk.number(mk.DEFAULT_DURATION, 5_000_000)) for t in (1, 300)))

    def block(kind, track, flags=0):
        return mk.vint(track) + (10).to_bytes(2, "big", signed=True) + bytes([flags | kind << 1]) + mk.lace_header(sizes, kind) + b"".join(frames)

    cluster = mk.element_id(mk.CLUSTER) + b"\xff" + mk.number(mk.TIMESTAMP, 1000) + void + mk.element(mk.SIMPLE_BLOCK, block(3, 1, 0x80))
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, block(1, 300)) + mk.number(mk.REFERENCE, 5))
    media = mk.element(mk.EBML, b"") + mk.element_id(mk.SEGMENT) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + tracks + cluster + mk.element_id(mk.CLUSTER) + mk.vint(len(group) + 3, 4) + mk.number(mk.TIMESTAMP, 7) + group
    packets, _ = mk.parse(media)
    assert [media[p.offset : p.offset + p.size] for p in packets] == frames * 2
    assert [(p.track, p.timestamp_ms, p.key, p.cluster) for p in packets] == [(1, 1010 + 5 * k, True, 0) for k in range(4)] + [(300, 17 + 5 * k, False, 1) for k in range(4)]


def test_query_against_brute_force(spark):
    rows = odd_rows()
    got = {(r["doc_id"], r["n_bytes"]): r for r in mk.digests(mk.media_column(docs_frame(spark, rows))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b" " * ((192 - len(raw) % 192) % 192 if raw else 192)
        r = got[i, len(raw)]
        assert r["payload_bytes"] == len(padded) and r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-16:]) and r["n_packets"] == len(padded) // 192
        media = mk.write(padded)
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
    assert mk.digests(mk.media_column(docs_frame(spark, []))).count() == 0


def test_packet_table(spark):
    media = mk.media_column(docs_frame(spark, [(1, "a" * 400), (2, ""), (3, None)]))
    rows = mk.packet_table(media).orderBy("doc_id", "packet").collect()
    assert [(r["doc_id"], r["packet"], r["size"]) for r in rows] == [(1, 0, 192), (1, 1, 192), (1, 2, 192), (2, 0, 192), (3, 0, 192)]
    empty = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, media binary")
    assert mk.packet_table(empty).count() == 0


def test_a_file_cut_short():
    whole = mk.write(bytes(range(256)) * 30)
    every, _ = mk.parse(whole)
    for n in range(1, len(whole), 37):
        packets, _ = mk.parse(whole[:-n])
        assert packets == every[: len(packets)]
