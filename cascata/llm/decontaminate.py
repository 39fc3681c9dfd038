"""Benchmark decontamination (operator 2): containment search for short items inside long documents.

Items are partitioned by size.  An item of q distinct shingles is contained in a document at threshold t
if ceil(t q) of them occur there, so at most q - ceil(t q) are missing, and of its q - ceil(t q) + 1
smallest shingle hashes - a bottom-k MinHash sketch whose length follows from the size partition - at
least one must occur.  Documents look every shingle up in the sketches of those partitions that their own
size can contain.  The search therefore misses nothing, at any document length; each candidate is then
verified on the shingles themselves.

Words are runs of ASCII letters and digits (lower-cased) and of characters beyond ASCII; a shingle is
five words, and all words of an item that has fewer.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh_folder, text_view
from .wordhash import alphanumeric_words, document_words, lower_table, shingle_hashes, word_hashes

WIDTH, THRESHOLD = 5, 0.8
#: Bytes of item text that one pass over the documents carries; a larger benchmark takes several passes.
BLOCK_BYTES = 32 << 20
#: Items whose shingles a worker keeps ready for verification.
READY_ITEMS = 4096
SCHEMA = "doc_id long, item_id long, shared long, n_shingles long, containment double"
_WORDS, _LOWER = alphanumeric_words(), lower_table()


def words_of(raw: bytes) -> list[bytes]:
    buf = _LOWER[np.frombuffer(raw, np.uint8)]
    data = buf.tobytes()
    starts, ends, _ = document_words(buf, np.array([0, len(buf)]), _WORDS)
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def shingles_of(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def hashed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of documents in ``buf`` (offsets relative to it), and word offsets."""
    low = _LOWER[buf]
    starts, ends, at = document_words(low, offsets, _WORDS)
    return word_hashes(low, starts, ends), at


@dataclass
class SizePartition:
    """Sketches of the items of one shingle width whose size lies in one octave."""

    width: int
    least: int  # fewest shingles that a document must have to contain any of its items
    hashes: np.ndarray  # sorted sketch hashes
    items: np.ndarray  # item number of each


class Sketches:
    """All items of one block, in size partitions, with their texts for verification."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = THRESHOLD, width: int = WIDTH):
        self.ids, self.texts, self.size, self.need, self.width = [], [], [], [], []
        groups: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        least: dict[tuple[int, int], int] = {}
        for item, text in items:
            words = words_of((text or "").encode())
            if not words:
                continue
            own = min(width, len(words))
            shingles = shingles_of(words, own)
            q = len(shingles)
            need = max(1, math.ceil(threshold * q - 1e-9))
            buf = np.frombuffer((text or "").encode(), np.uint8)
            hashes = np.unique(shingle_hashes(hashed(buf, np.array([0, len(buf)]))[0], own))
            key = own, q.bit_length()
            groups[key] += [(int(h), len(self.ids)) for h in hashes[: q - need + 1]]
            least[key] = min(least.get(key, need), need)
            self.ids.append(item)
            self.texts.append((text or "").encode())
            self.size.append(q)
            self.need.append(need)
            self.width.append(own)
        self.partitions = []
        for key, pairs in sorted(groups.items()):
            pairs.sort()
            self.partitions.append(SizePartition(key[0], least[key], np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])))
        self.ready: dict[int, set[tuple[bytes, ...]]] = {}

    def shingles(self, i: int) -> set[tuple[bytes, ...]]:
        """The shingles of item number i, made when a candidate first needs them."""
        if i not in self.ready:
            if len(self.ready) >= READY_ITEMS:
                self.ready.clear()
            self.ready[i] = shingles_of(words_of(self.texts[i]), self.width[i])
        return self.ready[i]

    def search(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item number, shared shingles) of every row and item at the threshold."""
        buf, offsets = text_view(column)
        found = []
        for lo, hi in chunks(offsets):
            at = offsets[lo : hi + 1] - offsets[lo]
            part = buf[offsets[lo] : offsets[hi]]
            words, first = hashed(part, at)
            pairs: set[tuple[int, int]] = set()
            for width in {p.width for p in self.partitions}:
                all_hashes = shingle_hashes(words, width)
                for p in (p for p in self.partitions if p.width == width):
                    fits = np.diff(first) - width + 1 >= p.least
                    if not fits.any() or not len(all_hashes):
                        continue
                    k = np.searchsorted(p.hashes, all_hashes)
                    hit = np.flatnonzero(p.hashes[np.minimum(k, len(p.hashes) - 1)] == all_hashes)
                    rows = np.searchsorted(first, hit, side="right") - 1
                    good = fits[rows] & (hit + width <= first[rows + 1])
                    for row, h in zip(rows[good].tolist(), all_hashes[hit[good]]):
                        a, b = np.searchsorted(p.hashes, h, "left"), np.searchsorted(p.hashes, h, "right")
                        pairs.update((row, int(i)) for i in p.items[a:b])
            by_row = defaultdict(list)
            for row, item in sorted(pairs):
                by_row[row].append(item)
            for row, own in by_row.items():
                tokens = words_of(part[at[row] : at[row + 1]].tobytes())
                for width in {self.width[i] for i in own}:
                    there = shingles_of(tokens, width)
                    for i in own:
                        if self.width[i] == width and (shared := len(self.shingles(i) & there)) >= self.need[i]:
                            found.append((lo + row, i, shared))
        return found


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[Sketches]]:
    """The number of blocks of about ``block_bytes`` of text, and the blocks, each made when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = math.ceil(total / block_bytes) or 1

    def block(k: int) -> Sketches:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
        return Sketches([(r["item_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"]))])

    return n, map(block, range(n))


def _stored(df: DataFrame) -> DataFrame:
    path = fresh_folder(df.sparkSession, "decontaminated")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, shared, n_shingles and containment of every document and item at the threshold.

    Null and empty texts, and items without words, match nothing.  Repeated rows give one result row.
    The documents are never shuffled.  Of several blocks one at a time is held and broadcast, and its result
    is written to the shared folder before the next one is made.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def pass_over(shared) -> DataFrame:
        def run(batches):
            own = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    found = own.search(part.column(1))
                    q = [own.size[i] for _, i, _ in found]
                    yield pa.record_batch(
                        [
                            part.column(0).take(pa.array([r for r, _, _ in found], pa.int64())),
                            pa.array([own.ids[i] for _, i, _ in found], pa.int64()),
                            pa.array([n for _, _, n in found], pa.int64()),
                            pa.array(q, pa.int64()),
                            pa.array([n / k for (_, _, n), k in zip(found, q)], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "shared", "n_shingles", "containment"],
                    )

        return rows.mapInArrow(run, SCHEMA)

    n, blocks = item_blocks(benchmark, block_bytes)
    parts = []
    for sketches in blocks:
        shared = spark.sparkContext.broadcast(sketches)
        if n == 1:
            return pass_over(shared).distinct()
        parts.append(_stored(pass_over(shared)))
        shared.destroy()
    return reduce(DataFrame.union, parts).distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns, unshuffled.

    Of several blocks one at a time is held and broadcast; what it leaves is written to the shared folder.
    """
    where = docs.columns.index("text")
    n, blocks = item_blocks(benchmark, block_bytes)
    for sketches in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(sketches)

        def run(batches, shared=shared):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    clean = np.ones(part.num_rows, bool)
                    clean[[r for r, _, _ in shared.value.search(part.column(where))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:
            docs = _stored(docs)
            shared.destroy()
    return docs
