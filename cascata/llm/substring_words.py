"""Substring deduplication of words (operator 7) with prefix-partitioned suffix trees.

A word goes if a window of WINDOW words that covers it also starts in a document with a smaller doc_id.
Within each group of candidate contents (repeats.py) the suffixes are split by prefixes of growing length
until a part fits in memory (a part of one suffix is dropped at once); each part's suffixes are sorted
and turned into the internal nodes of a suffix tree with a stack over their common prefixes.  The leaves
below an internal node of depth WINDOW or more share that many words; the smallest doc_id below the highest
such node decides.  Within a group words are compared as bytes; across groups by 64-bit hashes (BLAKE2b for
long words).  A window with one content around its anchor in the whole corpus needs no tree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_files_of, ranges
from .repeats import Pieces, Spec, Symbols, cover, with_runs
from .wordhash import document_words, plain_words, span_hashes, word_hashes

WINDOW, GRAM = 50, 12
#: Suffixes in a part that is sorted and turned into a tree.
PART = 1 << 13
#: Words that the prefixes grow by.
STEP = 6
_WORDS = plain_words()


def partition(values: np.ndarray, start: np.ndarray, group: np.ndarray, window: int) -> list[np.ndarray]:
    """Suffix numbers in parts of at most about PART that share a prefix of some length within a group.

    Prefixes grow by STEP words at a time, up to the window; parts of single suffixes vanish.
    """
    done: list[np.ndarray] = []
    open_, key = np.arange(len(start)), group.astype(np.uint64)
    depth = 0
    while len(open_):
        step = min(STEP, window - depth)
        with np.errstate(over="ignore"):
            own = key[open_] * np.uint64(0x9E3779B97F4A7C15) ^ span_hashes(values, start[open_] + depth, start[open_] + depth + step)
        key = key.copy()
        key[open_] = own
        depth += step
        _, part, size = np.unique(own, return_inverse=True, return_counts=True)
        order = np.argsort(part, kind="stable")
        size_of = size[part[order]]
        open_ = open_[order]
        small = (size_of > 1) & (size_of <= PART)
        if depth >= window:
            small = size_of > 1
        done.append(open_[small])
        open_ = open_[(size_of > PART)] if depth < window else open_[:0]
    return done


@dataclass
class Nodes:
    """Internal nodes of a suffix tree, children before their parents: words from the root, leaves, and the least value below."""

    depth: list[int]
    left: list[int]
    right: list[int]  # the last leaf
    least: list[int]
    top: list[bool]  # whether no node above is deep enough


def sorted_suffixes(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows (suffixes, padded), and the common prefix of each with the one before it in that order."""
    order = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"V{4 * rows.shape[1]}").ravel(), kind="stable")
    common = np.zeros(len(rows), np.int64)
    for lo in range(1, len(order), 4096):
        here, before = order[lo : lo + 4096], order[lo - 1 : lo + 4095][: len(order) - lo]
        differs = rows[here] != rows[before]
        same = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
        common[lo : lo + 4096] = np.minimum(same, np.minimum(length[here], length[before]))
    return order, common


def deep_nodes(common: np.ndarray, value: np.ndarray, least_depth: int) -> Nodes:
    """The internal nodes of depth ``least_depth`` or more, from the common prefixes of neighbouring leaves.

    The stack holds the nodes on the path to the last leaf; a shorter common prefix closes the deeper ones.
    A closed node is a repeat that cannot be longer to the right.
    """
    nodes = Nodes([], [], [], [], [])
    stack: list[list[int]] = []  # depth, left leaf, least value

    def close(right: int) -> list[int]:
        last = stack.pop()
        nodes.depth.append(last[0])
        nodes.left.append(last[1])
        nodes.right.append(right)
        nodes.least.append(last[2])
        nodes.top.append(not stack)
        if stack:
            stack[-1][2] = min(stack[-1][2], last[2])
        return last

    deep = np.flatnonzero(common >= least_depth)
    before = -1
    for at, depth, one, two in zip(deep.tolist(), common[deep].tolist(), value[deep - 1].tolist(), value[deep].tolist()):
        if at != before + 1:
            while stack:
                close(before)
        left, low = at - 1, min(one, two)
        while stack and stack[-1][0] > depth:
            if len(stack) > 1 and stack[-2][0] >= depth:
                close(at - 1)
                continue
            # the closed node hangs below a new one of this depth
            last = stack[-1]
            stack.append([depth, last[1], last[2]])
            stack[-1], stack[-2] = stack[-2], stack[-1]
            close(at - 1)
        if stack and stack[-1][0] == depth:
            stack[-1][2] = min(stack[-1][2], two)
        else:
            stack.append([depth, left, low])
        before = at
    while stack:
        close(before)
    return nodes


def kernel(p: Pieces, window: int = WINDOW) -> np.ndarray:
    """The smallest doc_id in which every window of every piece starts, within its group."""
    least = np.repeat(p.value, p.count)
    start = ranges(p.start, p.count)
    length = np.repeat(p.start + p.count + window - 1, p.count) - start
    group = np.repeat(np.unique(p.group, return_inverse=True)[1], p.count)
    for part in partition(p.values, start, group, window):
        # several small parts are sorted together: the group leads each row
        for lo, hi in _cuts(part, group):
            own = part[lo:hi]
            wide = int(length[own].max())
            rows = np.zeros((len(own), wide + 1), np.uint32)
            rows[:, 0] = group[own]
            place = start[own][:, None] + np.arange(wide)
            inside = np.arange(wide) < length[own][:, None]
            rows[:, 1:] = np.where(inside, p.values[np.minimum(place, len(p.values) - 1)] + 1, 0)
            order, common = sorted_suffixes(rows, length[own] + 1)
            own = own[order]
            nodes = deep_nodes(common, least[own], window + 1)
            top = np.array(nodes.top, bool)
            left, right = np.array(nodes.left, np.int64)[top], np.array(nodes.right, np.int64)[top]
            size = right - left + 1
            least[own[ranges(left, size)]] = np.repeat(np.array(nodes.least, np.int64)[top], size)
    return least


def _cuts(part: np.ndarray, group: np.ndarray):
    """Ranges of about PART suffixes; suffixes of one group that lie together are never parted."""
    if not len(part):
        return
    own = np.argsort(group[part], kind="stable")
    part[:] = part[own]
    border = np.append(np.flatnonzero(np.diff(group[part])) + 1, len(part))
    lo = 0
    while lo < len(part):
        k = np.searchsorted(border, lo + PART, side="right") - 1
        hi = int(border[k]) if k >= 0 and border[k] > lo else int(border[np.searchsorted(border, lo, side="right")])
        yield lo, hi
        lo = hi


def _word_symbols(buf: np.ndarray, offsets: np.ndarray) -> Symbols:
    starts, ends, at = document_words(buf, offsets, _WORDS)
    return Symbols(word_hashes(buf, starts, ends), at, (starts, ends))


def word_numbers(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts as numbers, equal for equal bytes alone, and the first word of each text."""
    starts, ends, at = document_words(buf, offsets, _WORDS)
    text = pa.py_buffer(np.ascontiguousarray(buf[_WORDS[buf]]))
    places = pa.py_buffer(np.append(0, np.cumsum(ends - starts)).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places, text])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64), at[:-1]


SPEC = Spec(WINDOW, GRAM, _word_symbols, kernel, by_id=True, decode=word_numbers)


def _words_gone(raw: bytes, runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(raw, np.uint8)
    starts, ends, _ = document_words(buf, np.array([0, len(buf)]), _WORDS)
    return starts, ends, cover([(r["first"], r["length"]) for r in runs or ()], WINDOW, len(starts))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of every row.

    A null text has no words.  A repeated row loses no more than its first copy does, for its doc_id is
    not smaller.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = (text or "").encode().split()
                    kept = words
                    if runs:
                        gone = cover([(r["first"], r["length"]) for r in runs], WINDOW, len(words))
                        kept = [w for w, g in zip(words, gone.tolist()) if not g]
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                columns = list(zip(*rows)) if rows else [()] * 3
                yield pa.record_batch([part.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_runs(own, SPEC)[0].mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns; removed words are cut out of the text together with the blanks after them.

    A column n_chars, where there is one, is set to the new length.
    """
    table, _ = with_runs(docs, SPEC)
    where, last = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            out = []
            for text, runs in zip(texts, batch.column(last).to_pylist()):
                if not runs:
                    out.append(text)
                    continue
                raw = text.encode()
                starts, _, gone = _words_gone(raw, runs)
                after = np.append(starts[1:], len(raw))
                keep = np.ones(len(raw), bool)
                keep[ranges(starts[gone], (after - starts)[gone])] = False
                out.append(np.frombuffer(raw, np.uint8)[keep].tobytes().decode())
            columns = [batch.column(k) for k in range(last)]
            columns[where] = pa.array(out, batch.column(where).type)
            yield pa.record_batch(columns, schema=pa.schema([batch.schema.field(k) for k in range(last)]))

    kept = in_files_of(table, docs.count()).mapInArrow(run, docs.schema)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept
