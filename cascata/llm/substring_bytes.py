"""Suffix-array deduplication of bytes (operator 1).

A byte goes if a string of WINDOW bytes that covers it also starts anywhere else in the corpus, the same
document included.  Repeated strings are found with suffix arrays built by linear grouping
(suffix_array.py) over groups of candidate contents (repeats.py): in suffix order, equal windows are
neighbours.  Strings are judged on the input, so all copies go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges
from .repeats import Pieces, Spec, Symbols, cover, split, with_runs
from .suffix_array import suffix_arrays
from .wordhash import span_hashes

WINDOW, GRAM = 200, 48
#: Window starts of the blocks that contents are cut into, and the next ones for groups of more than LANE blocks.
BLOCKS = (32, 8, 1)
LANE = 64
#: Symbols that are sorted side by side.
SORTED = 1 << 19


def exact_groups(values: np.ndarray, start: np.ndarray, size: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the spans of ``size`` values in which equal ones stand together, and where a new one begins.

    ``key`` is equal for equal spans; the spans themselves are compared as well.
    """
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    alike, ahead = np.flatnonzero(~new), np.arange(size)
    wrong = np.zeros(len(order), bool)
    for lo in range(0, len(alike), 16384):
        at = alike[lo : lo + 16384]
        wrong[at] = (values[start[order[at]][:, None] + ahead] != values[start[order[at - 1]][:, None] + ahead]).any(1)
    if wrong.any():
        # different spans under one key: their own order decides
        head = np.append(np.flatnonzero(new), len(order))
        for g in np.unique(np.searchsorted(head, np.flatnonzero(wrong), side="right") - 1).tolist():
            a, b = head[g], head[g + 1]
            spans = [values[s : s + size].tobytes() for s in start[order[a:b]].tolist()]
            own = sorted(range(b - a), key=spans.__getitem__)
            order[a:b] = order[a:b][own]
            new[a + 1 : b] = [spans[x] != spans[y] for x, y in zip(own[1:], own)]
    return order, new


def _classes(p: Pieces, window: int, total: np.ndarray, at: np.ndarray, blocks: tuple[int, ...]) -> None:
    """Adds up, for every window, the occurrences of all equal windows of its group, into ``total``.

    ``at`` is the place of each piece's first window in ``total``.  Pieces are cut into blocks of windows at
    fixed distances from the anchor; only blocks that share the symbols common to all their windows (their
    core) can hold equal windows, and blocks that share it with no other are done.
    """
    block = blocks[0]
    cut, source, shift = split(p, window, block)
    where = at[source] + shift
    core = np.add(cut.start, cut.distance % block)
    order, new = exact_groups(cut.values, core, window - block + 1, cut.group)
    head = np.flatnonzero(new)
    k = np.diff(np.append(head, len(order)))
    if block == 1:  # the core is the window
        sums = np.add.reduceat(cut.value[order], head) if len(head) else np.zeros(0, np.int64)
        total[where[order]] = np.maximum(total[where[order]], np.repeat(sums, k))
        return
    large = k > LANE
    if large.any():
        pick = order[ranges(head[large], k[large])]
        sub = Pieces(cut.values, cut.start[pick], cut.count[pick], cut.distance[pick], cut.group[pick], cut.value[pick])
        _classes(sub, window, total, where[pick], blocks[1:])
    lanes = np.flatnonzero((k > 1) & ~large)
    if not len(lanes):
        return
    # lanes of like length are sorted side by side
    size = cut.distance % block + 1 + _right(cut, window, block) + 1
    length = np.add.reduceat(size[order], head)[lanes] + 1
    by_length = np.argsort(length, kind="stable")
    lanes, length = lanes[by_length], length[by_length]
    group = np.cumsum(length) // SORTED
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(lanes))
    for a, b in zip(edges[:-1], edges[1:]):
        own = lanes[a:b]
        _sorted_lanes(cut, window, block, order[ranges(head[own], k[own])], k[own], length[a:b], total, where)


def _right(p: Pieces, window: int, block: int) -> np.ndarray:
    """Symbols of each block piece after its core."""
    return p.count - 1 + block - 1 - p.distance % block


def _sorted_lanes(p: Pieces, window: int, block: int, pick: np.ndarray, k: np.ndarray, length: np.ndarray, total: np.ndarray, at: np.ndarray) -> None:
    """One suffix array per group of blocks: symbols before the core, one symbol for the core, symbols after it.

    A window is then ``block`` symbols that hold the core's; equal windows are neighbours in suffix order.
    """
    left, right = (p.distance % block)[pick], _right(p, window, block)[pick]
    size = left + 1 + right + 1  # with a symbol that ends the piece
    lane = np.repeat(np.arange(len(k)), k)
    begin = np.cumsum(size) - size + lane  # a lane ends with one symbol more
    symbols = np.zeros(int(length.sum()), np.int16)
    symbols[ranges(begin, left)] = p.values[ranges(p.start[pick], left)].astype(np.int16) + 3
    symbols[begin + left] = 2
    after = p.start[pick] + left + window - block + 1
    symbols[ranges(begin + left + 1, right)] = p.values[ranges(after, right)].astype(np.int16) + 3
    symbols[begin + size - 1] = 1
    order = suffix_arrays(symbols, length)
    # only suffixes that are windows count
    slot = np.full(len(symbols), -1, np.int64)
    weight = np.zeros(len(symbols), np.int64)
    own = ranges(begin, p.count[pick])
    slot[own] = ranges(at[pick], p.count[pick])
    weight[own] = np.repeat(p.value[pick], p.count[pick])
    order = order[slot[order] >= 0].astype(np.int64)
    lane_of = np.repeat(np.arange(len(length)), length)[order]
    alike = lane_of[1:] == lane_of[:-1]
    # the common prefix of neighbours reaches the window's length: hashes first, then the symbols themselves
    hashes = span_hashes(symbols, order, order + block)
    alike &= hashes[1:] == hashes[:-1]
    pairs = np.flatnonzero(alike)
    ahead = np.arange(block)
    for lo in range(0, len(pairs), 32768):
        two = pairs[lo : lo + 32768]
        alike[two] = (symbols[order[two][:, None] + ahead] == symbols[order[two + 1][:, None] + ahead]).all(1)
    label = np.cumsum(np.append(0, ~alike))
    where = slot[order]
    total[where] = np.maximum(total[where], np.bincount(label, weight[order])[label].astype(np.int64))


def kernel(p: Pieces, window: int = WINDOW) -> np.ndarray:
    """Occurrences in the corpus of every window of every piece."""
    total = np.repeat(p.value, p.count)
    _classes(p, window, total, np.cumsum(p.count) - p.count, BLOCKS)
    return total


def _bytes(buf: np.ndarray, offsets: np.ndarray) -> Symbols:
    return Symbols(buf, offsets)


SPEC = Spec(WINDOW, GRAM, _bytes, kernel, by_id=False, decode=lambda buf, offsets: (buf, offsets[:-1]))


def _applied(docs: DataFrame, keep_text: bool) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept binary, spans array<struct<start:long,length:long>>" if keep_text else "kept_sha256 string")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = (text or "").encode()
                    gone = cover([(r["first"], r["length"]) for r in runs or ()], WINDOW, len(raw))
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(edge) else raw
                    spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
                    rows.append((len(raw), len(raw) - len(kept), len(spans), *((kept, spans) if keep_text else (hashlib.sha256(kept).hexdigest(),))))
                columns = list(zip(*rows)) if rows else [()] * (5 if keep_text else 4)
                span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                kinds = [pa.int64()] * 3 + ([pa.binary(), span] if keep_text else [pa.string()])
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(("kept", "spans") if keep_text else ("kept_sha256",))]
                yield pa.record_batch([part.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_runs(own, SPEC)[0].mapInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the kept bytes and the removed spans of every row.

    A null text is empty.  Texts shorter than WINDOW bytes lose nothing.  A repeated row is a second
    document, so both lose all that is at least WINDOW bytes long.
    """
    return _applied(docs, True)


def digests(docs: DataFrame) -> DataFrame:
    """As remove_repeats(), with the kept bytes' hex SHA-256 alone."""
    return _applied(docs, False)
