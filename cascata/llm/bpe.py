"""Byte-pair encoding and decoding with a given vocabulary (operator 5).

A pre-token of n bytes is encoded by dynamic programming over its prefixes.  Every
prefix has exactly one *last token* in its byte-pair encoding.  For the prefix that ends
at byte e the candidates are the vocabulary entries that are suffixes of it, found by one
pass of an automaton with suffix links over the vocabulary, longest first.  A candidate
that starts at s is the last token if s is 0 or if the last token of the prefix that ends
at s and the candidate are a *compatible pair*: encoding the two tokens' bytes together
gives back these two tokens.  Following the back-pointers from n emits the ids.

Whole texts are cut at the added tokens, then into runs of white space plus a run of
other characters (no pre-token crosses the end of such a run), and each distinct run is
encoded once per worker and kept in a cache of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept_by_worker

# The Unicode White_Space characters, and the pre-tokenizer's published pattern over them.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)

#: Entries of a generation of a worker's cache of runs; when it is full it becomes the old generation, whose
#: entries come back when they are used again. Longer keys are not kept.
CACHE_ENTRIES, CACHE_KEY = 1 << 18, 64
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of every byte, by the published rule: printable Latin-1
    characters stand for themselves and the other bytes, in order, for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for a byte-level vocabulary in the ``tokenizers`` JSON layout."""

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.id_of = vocab
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (vocab[bytes(alphabet[c] for c in side)] for side in (left, right))
            joined = vocab[self.token[a] + self.token[b]]
            self.rank[a, b] = rank
            self.parts.setdefault(joined, (a, b))
            self.made.setdefault(joined, rank)
        automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            automaton.add_word(token.decode("latin-1"), (len(token), i))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.compatible = functools.lru_cache(1 << 18)(self._compatible)
        self.pre_tokens = regex.compile(PATTERN).findall
        self.runs = regex.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.by_run: dict[str, bytes] = {}
        self.by_run_old: dict[str, bytes] = {}
        self.packed = {i: i.to_bytes(4, "little") for i in self.token}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether encoding a's and b's bytes together gives [a, b].

        Undo the merges that made the two tokens, latest first.  The pair of tokens that face each
        other across the border must never have a merge that would have come before the merge just
        undone on either side (ties go to the left, as merging runs from left to right).
        """
        merges, parts, made = self.rank, self.parts, self.made
        # undone: (rank, side) of the next merge that would happen without the border being crossed
        limit = (1 << 60, 0)
        while True:
            rank = merges.get((a, b))
            if rank is not None and (rank, 1) < limit:
                return False
            left, right = made.get(a, -1), made.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:  # a merge in the left token comes first at equal rank
                limit, a = (left, 0), parts[a][1]
            else:
                limit, b = (right, 2), parts[b][0]

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ids of one pre-token.

        A pre-token that is in the vocabulary is its own last token, as the longest match starts at 0.
        """
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        compatible = self.compatible
        last: list[tuple[int, int] | None] = [None] * n  # of the prefix that ends after byte e: (token, start)
        for e, (size, token) in self.matches(word.decode("latin-1")):
            if last[e] is None:
                start = e + 1 - size
                if start == 0 or ((before := last[start - 1]) is not None and compatible(before[0], token)):
                    last[e] = (token, start)
        out, e = [], n
        while e:
            token, e = last[e - 1]
            out.append(token)
        return out[::-1]

    def _run(self, run: str) -> bytes:
        packed = self.by_run_old.get(run)
        if packed is None:
            ids = [i for word in self.pre_tokens(run) for i in self.encode_bytes(word.encode())]
            packed = b"".join(map(self.packed.__getitem__, ids))
        if len(run) <= CACHE_KEY:
            if len(self.by_run) >= CACHE_ENTRIES:
                self.by_run, self.by_run_old = {}, self.by_run
            self.by_run[run] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The text's ids, as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            known, make = self.by_run, self._run
            for run in self.runs(part):
                packed = known.get(run)
                if packed is None:
                    packed = make(run)
                    known = self.by_run
                out.append(packed)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


@kept_by_worker
def _loaded(definition: bytes) -> Bpe:
    return Bpe(definition)


def definition_of(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _over(docs: DataFrame, path: str, schema: str, rows) -> DataFrame:
    # A vocabulary file is a few MB whatever the corpus is; it is read once, by the driver.
    shared = docs.sparkSession.sparkContext.broadcast(definition_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield rows(bpe, part.column(0), part.column(1).to_pylist())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian uint32) and the decoded text.

    A null text is empty and has no ids; texts of any length are encoded whole.
    """

    def rows(bpe, ids, texts):
        packed = [bpe.encode(t) if t else b"" for t in texts]
        return pa.record_batch(
            [ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array([bpe.decode(p).decode() for p in packed], pa.string())],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    return _over(docs, path, SCHEMA, rows)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode_documents(), with hex SHA-256 digests in place of the ids and the decoded text."""

    def rows(bpe, ids, texts):
        packed = [bpe.encode(t) if t else b"" for t in texts]
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return pa.record_batch(
            [ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(map(digest, packed), pa.string()), pa.array([digest(bpe.decode(p)) for p in packed], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _over(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
