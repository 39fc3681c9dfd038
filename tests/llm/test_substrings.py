import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cascata.llm import repeats, substring_bytes, substring_words
from cascata.llm.suffix_array import suffix_arrays

from .helpers import docs_frame, odd_rows, words


def brute_bytes(rows, w=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[k : k + w] for _, r in raws for k in range(len(r) - w + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - w + 1):
            if count[r[k : k + w]] > 1:
                gone[k : k + w] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, w=50):
    every = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, ws in every:
        for k in range(len(ws) - w + 1):
            if i is not None:
                key = tuple(ws[k : k + w])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, ws in every:
        gone = np.zeros(len(ws), bool)
        for k in range(len(ws) - w + 1):
            first = least.get(tuple(ws[k : k + w]))
            if first is not None and (i is None or first < i):
                gone[k : k + w] = True
        kept = b" ".join(x for x, g in zip(ws, gone) if not g)
        out.append((i, len(ws), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_arrays_match_sorting():
    rng = random.Random(3)
    for _ in range(60):
        lanes = [[rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] + [0] for _ in range(rng.randint(1, 9))]
        order = suffix_arrays(np.array(sum(lanes, []), np.int32), np.array([len(x) for x in lanes]))
        at = 0
        for x in lanes:
            assert (order[at : at + len(x)] - at).tolist() == sorted(range(len(x)), key=lambda i: x[i:])
            at += len(x)


@pytest.mark.parametrize("many,vast", [(2000, 100000), (2, 8), (1, 1)])
def test_bytes_and_words_against_brute_force(spark, monkeypatch, many, vast):
    """Also with group sizes from which on blocks and single windows are keyed set so low that they are used here."""
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "VAST", vast)
    rows = odd_rows()
    got = sorted((tuple(r) for r in substring_bytes.digests(docs_frame(spark, rows)).collect()), key=str)
    assert got == brute_bytes(rows)
    got = sorted((tuple(r) for r in substring_words.digests(docs_frame(spark, rows)).collect()), key=str)
    assert got == brute_words(rows)


def test_kernels_split_large_groups(spark):
    """More contents in a group than a lane or a tree part takes."""
    rng = random.Random(5)
    core = words(rng, 70)
    rows = [(k, f"{words(rng, 12)} {core} {words(rng, 12)}") for k in range(60)]
    got = sorted((tuple(r) for r in substring_bytes.digests(docs_frame(spark, rows)).collect()), key=str)
    assert got == brute_bytes(rows)
    got = sorted((tuple(r) for r in substring_words.digests(docs_frame(spark, rows)).collect()), key=str)
    assert got == brute_words(rows)


def long_words():
    """Two different words of 1024 bytes that sums of powers with an odd multiplier cannot tell apart."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_compared_as_bytes(spark):
    rng = random.Random(7)
    one, two = long_words()
    left, right = words(rng, 30), words(rng, 30)
    rows = [(1, f"{left} {one} {right}"), (2, f"{left} {two} {right}"), (3, f"x {left} {one} {right} y")]
    got = sorted((tuple(r) for r in substring_words.digests(docs_frame(spark, rows)).collect()), key=str)
    assert got == brute_words(rows) and [r[2] for r in got] == [0, 0, 61]


def test_one_line_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", 100)
    monkeypatch.setattr(repeats, "VAST", 1000)
    rng = random.Random(12)
    line = words(rng, 50)
    rows = [(k, f"{words(rng, 3, 90000)} {line} {words(rng, 3, 90000)}") for k in range(10_000)]
    got = sorted((tuple(r) for r in substring_words.digests(docs_frame(spark, rows)).collect()), key=str)
    assert got == brute_words(rows)


def test_nodes_of_a_suffix_tree_against_all_substrings():
    rng = random.Random(13)
    for _ in range(200):
        text = [rng.randint(1, rng.randint(1, 3)) for _ in range(rng.randint(2, 40))]
        value = [rng.randrange(9) for _ in text]
        rows, length = np.zeros((len(text), len(text)), np.uint32), np.arange(len(text), 0, -1)
        for k in range(len(text)):
            rows[k, : len(text) - k] = text[k:]
        order, common = substring_words.sorted_suffixes(rows, length)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
        nodes = substring_words.deep_nodes(common, np.array(value)[order], 2)
        got = {(d, frozenset(order[a : b + 1].tolist()), v) for d, a, b, v in zip(nodes.depth, nodes.left, nodes.right, nodes.least)}
        assert len(got) == len(nodes.depth)
        expected = set()
        starts = {}
        for a in range(len(text)):
            for b in range(a + 2, len(text) + 1):
                starts.setdefault(tuple(text[a:b]), set()).add(a)
        longest = {}
        for span, at in starts.items():
            if len(at) > 1:
                longest[frozenset(at)] = max(longest.get(frozenset(at), 0), len(span))
        for at, depth in longest.items():
            expected.add((depth, at, min(value[k] for k in at)))
        assert got == expected


def test_equal_keys_of_different_spans():
    values = np.frombuffer(b"abcabdabcxyzabd", np.uint8)
    start = np.array([0, 3, 6, 9, 12])
    order, new = substring_bytes.exact_groups(values, start, 3, np.array([5, 5, 5, 1, 5]))
    groups = np.split(order, np.flatnonzero(new)[1:])
    assert sorted(sorted(g.tolist()) for g in groups) == [[0, 2], [1, 4], [3]]


def test_outputs_and_empty_tables(spark):
    rows = odd_rows()
    by_id = {r["doc_id"]: r for r in substring_bytes.remove_repeats(docs_frame(spark, rows[6:18])).collect()}
    texts = dict(rows)
    for i, r in by_id.items():
        raw = texts[i].encode()
        cut = b"".join(raw[s["start"] : s["start"] + s["length"]] for s in r["spans"])
        assert len(cut) == r["n_removed"] and len(raw) - len(r["kept"]) == len(cut)
    kept = substring_words.remove_repeats(docs_frame(spark, rows))
    assert kept.columns == docs_frame(spark, rows).columns
    removed = {i: n for i, _, n, _ in brute_words(rows) if i != 42}
    for r in kept.collect():
        if r["doc_id"] not in (None, 42):
            assert len((r["text"] or "").split()) == len((texts[r["doc_id"]] or "").split()) - removed[r["doc_id"]]
            assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    none = docs_frame(spark, [])
    assert substring_bytes.digests(none).count() == substring_words.digests(none).count() == substring_words.remove_repeats(none).count() == 0
