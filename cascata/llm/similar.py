"""Near-duplicates by the Jaccard similarity of shingle sets, found with SimHash tiles: the pipeline's stage.

A document is the set of its lower-cased words' shingles, as 64-bit hashes; equal sets are one node.

1. *Candidates.*  Nodes meet by operator 8's blocks of bits of every word of their SimHash fingerprints of
   64 * LANES bits: no two within LANE_RADIUS bits on some word are missed.  No choice of blocks reaches all
   pairs at 0.8, which differ in about 40 bits, so nodes also meet in the buckets of their LOW smallest shingle
   hashes.  Of the LOW smallest hashes of two sets' union each is in both sets with a chance of their
   similarity, so a pair at 0.8 shares no such bucket with a chance below 0.2 ** LOW, which is less than that
   of two equal 64-bit hashes.
2. *Tiles.*  Every bucket is compared tile by tile as operator 8 compares its buckets: exclusive-or and bit
   counts of the fingerprints, where pairs beyond RADIUS bits are out.  Sets of a similarity of 0.8 differ in
   at most 15.6 % of the bits on average, so that a pair is lost with a chance below 1e-11.  A set of fewer
   than TELLING shingles may differ in 18.75 % of them (four of five shingles), and is out beyond WIDE bits
   (a chance below 1e-13).
3. *Clusters.*  A spanning forest of each bucket's close pairs gives components; only sets within a cluster
   can be similar.
4. *Verification.*  The whole sets of a cluster are compared exactly.  A large cluster is dealt out in parts;
   first each part by itself together with some members of the cluster that all parts have, and then, where
   components are left apart, the members of the largest one part by part with all the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, give_back, give_up_kept, in_fewer_files, ranges, text_view, whole_groups
from .components import connected_components
from .simhash import Labels, blocks, blocks_to_pick, deal, distances, near_tiles, pair_batch
from .wordhash import Hashed, document_words, lower_table, mix, plain_words, word_hashes

#: Words of a shingle, and the least similarity as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Smallest hashes of a set that key buckets; 64-bit words of a fingerprint; bits by which similar sets may differ;
#: the same for pairs with a set of fewer than TELLING shingles; bits of a word within which no pair is missed by blocks.
LOW, LANES, RADIUS, WIDE, TELLING, LANE_RADIUS = 24, 4, 84, 100, 32, 3
#: Shingles of a part of a cluster, and members that all parts of a cluster have in the first step.
PART_SHINGLES, SHARED = 1 << 18, 16
_FPS = [f"f{k}" for k in range(LANES)]
_SALTS = mix(np.arange(101, 101 + LANES, dtype=np.uint64))


def shingle_sets(column: pa.Array, width: int):
    """(lo, hi, hashes, owner) by chunk of rows: the distinct shingles of each text, by row and hash.

    A text of fewer words than a shingle is one shingle; a text without words has none.
    """
    buf, offsets = text_view(column)
    lower, is_word = lower_table(), plain_words()
    for lo, hi in chunks(offsets):
        part = lower[buf[offsets[lo] : offsets[hi]]]
        starts, ends, at = document_words(part, offsets[lo : hi + 1] - offsets[lo], is_word)
        n = np.diff(at)
        row = np.repeat(np.arange(hi - lo), n)
        words = Hashed(word_hashes(part, starts, ends)) if len(starts) else None
        left = at[1:][row] - np.arange(len(row))  # words from here to the text's end
        first = np.flatnonzero((left >= width) | ((n[row] < width) & (left == n[row])))
        hashes = words.spans(first, first + np.minimum(left[first], width)) if words else np.zeros(0, np.uint64)
        owner = row[first]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(owner), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield lo, hi, hashes[new], owner[new]


def wide_fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of LANES 64-bit words of each set; the sets lie one after the other in ``hashes``."""
    out = np.zeros((len(ends), LANES), np.uint64)
    begin = 0
    for row, end in enumerate(ends.tolist()):
        ones = np.zeros(64 * LANES, np.int64)
        for lo in range(begin, end, 8192):
            own = mix(hashes[lo : min(end, lo + 8192), None] ^ _SALTS)
            ones += np.unpackbits(own.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > end - begin, bitorder="little").view("<u8")
        begin = end
    return out


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, node (a hash of the shingle set), n (its size), the fingerprint and the smallest hashes of every row."""

    def run(batches):
        give_up_kept()
        for batch in batches:
            for lo, hi, hashes, owner in shingle_sets(batch.column(2), width):
                n = np.bincount(owner, minlength=hi - lo)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(1)))))
                ends = np.cumsum(n)
                node = mix(total[ends] - total[ends - n] + n.astype(np.uint64))
                kept = np.minimum(n, LOW)
                low = hashes[ranges(ends - n, kept)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)).astype(np.int32)), pa.array(low))
                fps = wide_fingerprints(hashes, ends).view(np.int64)
                rows = batch.slice(lo, hi - lo)
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array(node.view(np.int64)), pa.array(n.astype(np.int64)), *[pa.array(fps[:, k].copy()) for k in range(LANES)], lists],
                    names=["doc_id", "text_key", "node", "n", *_FPS, "low"],
                )
        give_back()

    return docs.mapInArrow(run, f"doc_id long, text_key long, node long, n long, {', '.join(f'{c} long' for c in _FPS)}, low array<long>")


def _fingerprints(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in _FPS], 1).view(np.uint64)


def _sizes_fit(m: np.ndarray, n: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether sets of m and n shingles can be similar enough."""
    up, down = least
    return (m * down >= n * up) & (n * down >= m * up)


def bucket_keys(n: int):
    """The buckets of each of ``n`` nodes: its fingerprint's blocks, and its smallest hashes."""
    pick = blocks_to_pick(n, LANE_RADIUS)
    own = [F.transform(blocks(F.col(c), LANE_RADIUS, pick), lambda b: F.xxhash64(F.lit(c), b["block"], b["value"])) for c in _FPS]
    return F.concat("low", *own)


def close_links(nodes: DataFrame, least: tuple[int, int], radius: int = RADIUS) -> DataFrame:
    """a, b: links that connect all nodes that share a bucket and whose fingerprints are close."""
    keys = ["low", "x", "y"]
    rows = deal(nodes.withColumn("low", F.explode(bucket_keys(nodes.count()))), ["low"], "node")
    # sets below this size can be similar to one that is not telling
    middling = -(-TELLING * least[1] // least[0])

    def run(batches):
        for table, offsets in whole_groups(batches, tuple(keys)):
            node, n, fps = table.column("node").to_numpy(), table.column("n").to_numpy(), _fingerprints(table)
            size = np.diff(offsets)
            own = np.repeat(size, size)
            group = np.repeat(np.arange(len(size)), size)
            out = []
            # all pairs of small buckets side by side
            for lag in range(1, 8):
                i = np.flatnonzero((group[lag:] == group[:-lag]) & (own[lag:] <= 8))
                i = i[_sizes_fit(n[i], n[i + lag], least)]
                far = np.bitwise_count(fps[i] ^ fps[i + lag]).sum(1, dtype=np.int64)
                i = i[far <= np.where(np.minimum(n[i], n[i + lag]) < TELLING, WIDE, radius)]
                out.append(np.stack([node[i], node[i + lag]], 1))
            for g in np.flatnonzero(size > 8).tolist():
                order = offsets[g] + np.argsort(n[offsets[g] : offsets[g + 1]], kind="stable")
                found = Labels(np.arange(len(order)))
                m = n[order]
                # small sets come first
                few = int(np.searchsorted(m, middling))
                for end, reach in ((few, WIDE), (len(m), radius)):
                    for lo, at, near in near_tiles(fps[order[:end]], reach) if end else ():
                        near &= _sizes_fit(m[lo : lo + near.shape[0], None], m[None, at : at + near.shape[1]], least)
                        for i in np.flatnonzero(near.any(1)).tolist():
                            found.join(lo + i, at + np.flatnonzero(near[i]))
                if found.links:
                    out.append(node[order[np.array(found.links)]])
            yield pair_batch(out)

    return rows.select(*keys, "node", "n", *_FPS).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def whole_sets(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with the set of all shingles of their last column, ``text``, in its place."""
    last = len(rows.columns) - 1
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches):
        for batch in batches:
            for lo, hi, hashes, owner in shingle_sets(batch.column(last), width):
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=hi - lo)))
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([*[part.column(k) for k in range(last)], sets], names=[*[f.name for f in kept], "set"])
        give_back()

    return rows.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "set array<long>"]))


def verified(dealt: DataFrame, keys: list[str], least: tuple[int, int], radius: int = RADIUS) -> DataFrame:
    """a, b: links between similar sets of each group of rows (keys, node, n, root, side, fingerprint, set) that
    connect what all such links connect; rows of one root are connected already.

    Groups with rows of both sides 0 and 1 are compared across the sides only.
    """
    up, down = least

    def similar_to(i, others, sets, at, n):
        """Those of the other positions whose sets are similar enough to that of position i."""
        sizes = n[others]
        values = sets[ranges(at[others], sizes)]
        own = sets[at[i] : at[i + 1]]
        k = np.minimum(np.searchsorted(own, values), len(own) - 1)
        hits = np.concatenate(([0], np.cumsum(own[k] == values)))
        ends = np.cumsum(sizes)
        both = hits[ends] - hits[ends - sizes]
        # both / (|s| + |t| - both) >= up / down
        return others[both * (up + down) >= (sizes + n[i]) * up]

    def run(batches):
        for table, offsets in whole_groups(batches, tuple(keys)):
            for g in range(len(offsets) - 1):
                part = table.slice(int(offsets[g]), int(offsets[g + 1] - offsets[g])).combine_chunks()
                if part.num_rows < 2:
                    continue
                n = part.column("n").to_numpy()
                order = np.argsort(n, kind="stable")
                part = part.take(pa.array(order)).combine_chunks()
                n, node, side, fps = n[order], part.column("node").to_numpy(), part.column("side").to_numpy(), _fingerprints(part)
                lists = part.column("set").combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                sets, at = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(n))
                found = Labels(np.unique(part.column("root").to_numpy(), return_inverse=True)[1])
                across = len(np.unique(side)) > 1
                for i in range(len(n) - 1):
                    end = int(np.searchsorted(n, n[i] * down // up, side="right"))
                    others = np.arange(i + 1, end)
                    others = others[found.of[others] != found.of[i]]
                    if across:
                        others = others[side[others] != side[i]]
                    if len(others):
                        others = others[distances(fps[i : i + 1], fps[others])[0] <= (radius if n[i] >= TELLING else WIDE)]
                    while len(others):
                        # a few at a time: most are connected once the first links are found
                        found.join(i, similar_to(i, others[:64], sets, at, n))
                        others = others[64:]
                        others = others[found.of[others] != found.of[i]]
                if found.links:
                    yield pair_batch([node[np.array(found.links)]])
        yield pair_batch([])

    columns = [*keys, "node", "n", "root", "side", *_FPS, "set"]
    return dealt.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int = WORDS, least: tuple[int, int] = LEAST, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """doc_id, text_key and root (one value a component) of every row: components of the pairs that are similar enough.

    Texts without words are copies of each other.  Repeated rows share a root.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = cut(signed(keyed, width))
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("text_key", "n", *_FPS, "low")).alias("v")).select("node", "v.*")
    clusters = connected_components(close_links(nodes, least)).toDF("node", "cluster")
    number = lambda column: F.ceil(F.col(column) / part_shingles).cast("long")

    # one text of each set of a cluster; its parts are told from the sizes alone, before sets are made
    members = clusters.join(nodes.drop("low"), "node")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members"))
    members = members.join(sizes, "cluster")
    chosen = keyed.select(F.col("text_key").alias("key"), "text").join(members, F.col("key") == F.col("text_key")).dropDuplicates(["node"])
    sets = cut(in_fewer_files(whole_sets(chosen.select("cluster", "shingles", "members", "node", "n", *_FPS, "text"), width), 4, 6))
    share = lambda column, parts: F.pmod(F.xxhash64(column, F.lit("part")), parts)
    in_all = share("node", F.col("members")) < SHARED
    every = F.sequence(F.lit(0).cast("long"), number("shingles") - 1)
    first = sets.withColumns({"part": F.explode(F.when(in_all, every).otherwise(F.array(share("node", number("shingles"))))), "root": F.col("node"), "side": F.lit(0).cast("long")})
    found = cut(in_fewer_files(verified(first, ["cluster", "part"], least), 4, 6))
    roots = connected_components(found).toDF("node", "root")

    # components that are still apart in a cluster: members of the largest meet all others, and the others each other
    left = sets.select("cluster", "node", "n").join(roots, "node", "left").select("cluster", "node", "n", F.coalesce("root", "node").alias("root"))
    by_root = left.groupBy("cluster", "root").agg(F.sum("n").alias("shingles"))
    by_cluster = by_root.groupBy("cluster").agg(F.max(F.struct("shingles", "root")).alias("top"), F.sum("shingles").alias("all"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    by_cluster = by_cluster.select("cluster", F.col("top.root").alias("main"), number("top.shingles").alias("mains"), F.ceil((F.col("all") - F.col("top.shingles")) / part_shingles).cast("long").alias("rests"))
    apart = left.join(by_cluster, "cluster").withColumn("is_main", F.col("root") == F.col("main"))
    own_main, own_rest = share("node", F.col("mains")), share("node", F.col("rests"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    meeting = lambda i, j, side, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(side).cast("long").alias("side"), F.lit(kind).cast("long").alias("kind"))
    main_meets = F.transform(upto("rests"), lambda j: meeting(own_main, j, 0, 0))
    rest_meets = F.concat(
        F.transform(upto("mains"), lambda i: meeting(i, own_rest, 1, 0)),
        F.transform(upto("rests"), lambda j: meeting(F.least(j, own_rest), F.greatest(j, own_rest), 0, 1)),
    )
    apart = apart.select("node", "root", F.explode(F.when(F.col("is_main"), main_meets).otherwise(rest_meets)).alias("m")).select("node", "root", "m.*")
    more = verified(apart.join(sets, "node"), ["cluster", "kind", "i", "j"], least)
    final = connected_components(found.union(more)).toDF("member", "root")
    return rows.join(final, rows["node"] == final["member"], "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))
