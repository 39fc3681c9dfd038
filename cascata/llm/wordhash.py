"""Vectorised word and shingle hashes over whole texts in UTF-8."""

from __future__ import annotations

import hashlib

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64
#: Bytes that part words, as the contracts' pattern [^\x20\x09-\x0D]+ has them.
BLANKS = b" \t\n\v\f\r"


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


_table: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64, from one table per process."""
    if not _table or len(_table[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        made = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            made.append(np.cumprod(factors, dtype=np.uint64))
        _table[:] = made
    return _table[0][:n], _table[1][:n]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _prefix(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the scaled symbols, and the inverse powers."""
    n = len(symbols)
    up, down = _powers(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    with np.errstate(over="ignore"):
        scaled = _BYTES[symbols] if symbols.dtype == np.uint8 else mix(symbols.astype(np.uint64) + _U(1))
        scaled *= up[:n]
        np.cumsum(scaled, out=prefix[1:])
    return prefix, down


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of symbols[s:e] for each span: equal spans of symbols have equal hashes wherever they stand."""
    prefix, down = _prefix(symbols)
    with np.errstate(over="ignore"):
        raw = (prefix[ends] - prefix[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


#: Bytes from which on a word is hashed as a whole: the sums of powers above tell short spans apart, but long ones exist
#: that are different and alike under every odd multiplier.
LONG_WORD = 256


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word; BLAKE2b of long ones."""
    out = span_hashes(buf, starts, ends)
    for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


class Hashed:
    """A symbol sequence whose grams and spans are hashed from one pass; hashes equal those of span_hashes()."""

    def __init__(self, symbols: np.ndarray):
        self.prefix, self.down = _prefix(symbols)

    def grams(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        with np.errstate(over="ignore"):
            raw = self.prefix[size:] - self.prefix[:n]
            raw *= self.down[:n]
            raw += _U(size * 0x2545F4914F6CDD1D & (1 << 64) - 1)
            return mix(raw)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
            return mix(raw + (ends - starts).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def word_spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    inside = np.concatenate(([0], is_word[buf].astype(np.int8), [0]))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def plain_words() -> np.ndarray:
    """Bytes of words that any blank parts."""
    table = np.ones(256, bool)
    table[list(BLANKS)] = False
    return table


def alphanumeric_words() -> np.ndarray:
    """Bytes of words of ASCII letters and digits and of all characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def document_words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and word offsets by document; ``offsets`` are relative to ``buf``.

    A word never crosses from one document to the next.
    """
    starts, ends = word_spans(buf, is_word)
    if len(starts):
        borders = offsets[1:-1]
        k = np.searchsorted(starts, borders, side="left") - 1  # the word that begins before the border
        over = (k >= 0) & (ends[np.maximum(k, 0)] > borders) & (borders > 0)
        split = np.unique(borders[over])
        if len(split):
            starts = np.sort(np.concatenate([starts, split]))
            ends = np.sort(np.concatenate([ends, split]))
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words (shorter by width - 1 than ``words``)."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    return Hashed(words).grams(width)
