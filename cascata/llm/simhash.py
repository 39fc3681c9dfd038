"""SimHash near-duplicates (operator 8).

Fingerprints within 4 bits of each other are linked, exactly.  Two such fingerprints agree on at least
one of five blocks of bits (on two of six, three of seven and so on for more fingerprints, so that buckets
do not grow), so the distinct fingerprints are dealt out by each block's value, and every
bucket is compared tile by tile: numpy exclusive-or and bit counts over tiles that are sorted by
population count, where tile pairs whose counts differ by more than the radius are skipped.  A large
bucket is dealt out as pairs of parts of bounded size.  Every task gives a spanning forest of its links,
which connects what the links connect, and components are found on the distributed edge table.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_files_of, whole_groups
from .components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile, of a part of a bucket, and of a bucket if they are evenly spread.
TILE, PART, BUCKET = 512, 8192, 1024


def fingerprint(raw: bytes) -> int:
    """SimHash of the lower-cased words' shingles, repeats included; 0 without words.

    bytes.lower() and bytes.split() change A-Z alone and part words at the six ASCII blanks.
    """
    words = raw.lower().split()
    n = max(1, len(words) - SHINGLE + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], "<u8")
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, n, 8192):
        set_bits += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * set_bits > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and text_key (a hash of the text) of every row; a null text is empty."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = np.array([fingerprint((t or "").encode()) for t in part.column(2).to_pylist()], np.uint64)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_key", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def blocks(fp, radius: int = RADIUS, pick: int = 1):
    """(number, value) keys; fingerprints within the radius agree on at least one.

    Of radius + pick blocks of bits at most radius differ, so the two agree on some choice of ``pick`` blocks.
    """
    bounds = [64 * k // (radius + pick) for k in range(radius + pick + 1)]
    masks = [sum((1 << bounds[k + 1]) - (1 << bounds[k]) for k in chosen) for chosen in combinations(range(radius + pick), pick)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return F.array(*[F.struct(F.lit(k).cast("long").alias("block"), fp.bitwiseAND(F.lit(signed(m)).cast("long")).alias("value")) for k, m in enumerate(masks)])


def blocks_to_pick(n: int, radius: int = RADIUS, fill: int = BUCKET) -> int:
    """Blocks that a key joins, so that ``n`` evenly spread fingerprints give buckets of at most ``fill``."""
    pick = 1
    while pick < 8 and n > fill << 64 * pick // (radius + pick):
        pick += 1
    return pick


class Labels:
    """Component labels of positions, merged a row at a time; keeps the links that joined two components."""

    def __init__(self, labels: np.ndarray):
        self.of = labels.copy()
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        """Link position i with each of the others."""
        others = others[self.of[others] != self.of[i]]
        if len(others):
            old, first = np.unique(self.of[others], return_index=True)
            self.links += [(i, int(j)) for j in others[first]]
            self.of[np.isin(self.of, old)] = self.of[i]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of ``a`` and every row of ``b``, of k 64-bit words each."""
    far = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        far += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return far


def near_tiles(fps: np.ndarray, radius: int, tile: int = TILE):
    """(lo, at, near) of every pair of tiles; near[i, j]: positions lo + i < at + j differ by at most ``radius`` bits.

    Tile pairs whose population counts lie further apart are skipped.
    """
    pop = np.bitwise_count(fps).sum(1, dtype=np.int64)
    edges = np.arange(0, len(fps), tile)
    low, high = np.minimum.reduceat(pop, edges), np.maximum.reduceat(pop, edges)
    for x, lo in enumerate(edges.tolist()):
        for y in np.flatnonzero((low[x:] - high[x] <= radius) & (low[x] - high[x:] <= radius)).tolist():
            at = int(edges[x + y])
            near = distances(fps[lo : lo + tile], fps[at : at + tile]) <= radius
            yield lo, at, np.triu(near, 1) if not y else near


def compare(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The fingerprints sorted by population count, and a spanning forest of the links among them."""
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    found = Labels(np.arange(len(fps)))
    for lo, at, near in near_tiles(fps[:, None], radius, tile):
        for i in np.flatnonzero(near.any(1)).tolist():
            found.join(lo + i, at + np.flatnonzero(near[i]))
    return fps, found.links


def deal(rows: DataFrame, keys: list[str], member: str, part: int = PART) -> DataFrame:
    """Rows of the buckets with several rows, with x and y: a bucket of more than ``part`` rows is dealt out as pairs of
    parts, where each pair meets once, and a smaller one is the pair (0, 0)."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumn("_parts", F.ceil(F.col("_n") * 2 / part).cast("int"))
    own = F.pmod(F.xxhash64(member), F.col("_parts")).cast("int")
    dealt = rows.join(counts, keys).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.withColumn("x", F.least("_own", "_other").cast("long")).withColumn("y", F.greatest("_own", "_other").cast("long"))
    return dealt.drop("_n", "_parts", "_own", "_other")


def pair_batch(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (a, b) of arrays of unsigned or signed pairs."""
    both = np.concatenate(pairs).view(np.int64) if pairs else np.zeros((0, 2), np.int64)
    return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """a, b: links that connect what all links between the distinct ``fp`` of ``nodes`` connect."""
    keyed = F.explode(blocks(F.col("fp"), radius, blocks_to_pick(nodes.count(), radius)))
    rows = nodes.select("fp", keyed.alias("k")).select("fp", "k.block", "k.value")
    keys = ["block", "value", "x", "y"]

    def run(batches):
        for table, offsets in whole_groups(batches, tuple(keys)):
            fps = table.column("fp").to_numpy().view(np.uint64)
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if b - a > 1:
                    own, found = compare(fps[a:b], radius)
                    if found:
                        out.append(own[np.array(found)])
            yield pair_batch(out)

    return deal(rows, ["block", "value"], "fp", part).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, text_key and root (one value a component) of every row.

    component_id is the smallest doc_id that links can reach, itself included; a null doc_id is never the
    smallest unless there is no other.  Texts without words have fingerprint zero and are linked like any
    other, as are repeated rows.
    """
    rows = cut(fingerprints(docs))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes.select("fp")))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(least, "root").select(F.col("fp").alias("f"), "component_id", "root")
    return rows.join(by_fp, rows["fp"] == by_fp["f"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key", "root")


def keep_one(docs: DataFrame, components: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """One document of each component, with all its columns: of the smallest doc_id, that with the smallest text hash.

    ``components`` gives the doc_id, text_key and root of every row.
    """
    classes = components(docs)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    first = classes.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("keep_id"), F.col("x.text_key").alias("keep_key"))
    mark = "text_key" + "_" * max(map(len, docs.columns), default=0)
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    # ids that are null go their own way, and the keys are compared after the join (an equality would become a
    # join key), so that one shuffle by id serves both the join and the repeated rows
    named = marked.join(first, marked["doc_id"] == first["keep_id"]).filter(F.col(mark).bitwiseXOR(F.col("keep_key")) == 0).drop("keep_id", "keep_key")
    nameless = marked.filter(marked["doc_id"].isNull()).join(first.filter("keep_id IS NULL"), F.col(mark) == F.col("keep_key"), "left_semi")
    return in_files_of(named.dropDuplicates(["doc_id", mark]).union(nameless.dropDuplicates([mark])).select(*docs.columns), docs.count())
