"""Finding repeated windows of W symbols across a corpus: candidate search, grouping and application.

Shared by the two substring operators, which differ in their symbols (bytes, words) and in the index
they build over a group (a suffix array, a suffix tree).

1. *Tiles.*  Every window of W symbols has an anchor: its leftmost smallest q-gram by hash.  Consecutive
   windows with one anchor form a tile.  Equal windows have equal anchors at equal offsets, so only tiles
   whose anchor hash occurs more than once can hold a repeated window; this loses nothing.
2. *Distinct tiles.*  Tiles are pre-aggregated by (anchor, content hash), first within each document, where a
   periodic text repeats them.  An anchor with one distinct
   content needs no index: all its windows repeat.  For the others one occurrence of each distinct content
   is fetched from its document.
3. *Groups.*  Distinct contents of one anchor go to one task, where the kernel indexes them.  Anchors with
   many distinct contents are dealt out by finer keys: the contents are cut into blocks of windows that
   start at a fixed distance from the anchor, keyed by the symbols that all windows of the block share.
   Contents of the largest groups are cut into single windows, which are summed up (with partial sums before
   the shuffle) by two independent 64-bit hashes and never meet in one task.
   Symbols travel as the bytes of the text, so that the index compares what stands there.
4. *Results.*  Runs of repeated windows are joined back to all occurrences and gathered by document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh_folder, give_back, in_fewer_files, ranges, same, text_view
from .wordhash import Hashed, span_hashes

#: Distinct contents of an anchor from which on blocks of BLOCK windows, and single windows, are keyed on their own.
MANY, VAST, BLOCK = 2_000, 100_000, 16
#: Symbols that a kernel indexes at a time.
BATCH_SYMBOLS = 1 << 20
_SLAB = 1 << 22
_POSITION = np.uint64((1 << 26) - 1)
_U = np.uint64


@dataclass
class Symbols:
    """Documents as symbol sequences: one array, and the offsets of the documents in it."""

    values: np.ndarray
    offsets: np.ndarray
    spans: tuple[np.ndarray, np.ndarray] | None = None  # bytes of each symbol, where symbols are not bytes


@dataclass
class Spec:
    """What differs between the operators."""

    window: int
    gram: int
    symbols: Callable[[np.ndarray, np.ndarray], Symbols]  # of (bytes, offsets)
    kernel: Callable[["Pieces"], np.ndarray]  # a value for every window of every piece
    by_id: bool  # values are least doc_ids (else counts of occurrences)
    decode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # (bytes, offsets) of contents to symbols and offsets


@dataclass
class Pieces:
    """Contents in groups: each has ``count`` windows, the first at ``start`` in ``values``."""

    values: np.ndarray  # symbols of all contents
    start: np.ndarray  # where a content begins in values
    count: np.ndarray  # windows (a content has count + W - 1 symbols)
    distance: np.ndarray  # from its first window's start to the anchor
    group: np.ndarray  # key of its group
    value: np.ndarray  # occurrences, or least doc_id


def tiles(symbols: Symbols, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, content hash, start in document, windows, distance to the anchor) of all tiles."""
    span = window - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    values, offsets = symbols.values, symbols.offsets
    total = len(values)
    for a in range(0, max(0, total - window + 1), _SLAB):
        part = values[a : min(total, a + _SLAB + window - 1)]
        hashed = Hashed(part)
        grams = hashed.grams(gram)
        low = grams & ~_POSITION
        low |= np.arange(len(grams), dtype=np.uint64)
        have = 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        # windows that would cross into the next document do not count
        border = np.zeros(len(low) + 1, np.int8)
        inner = offsets[1:-1][(offsets[1:-1] > a) & (offsets[1:-1] < a + len(part))] - a
        inner = np.unique(inner)
        first = np.maximum(inner - window + 1, 0)
        first[1:] = np.maximum(first[1:], inner[:-1])
        np.add.at(border, np.minimum(first, len(low)), 1)
        np.add.at(border, np.minimum(inner, len(low)), -1)
        starts = np.flatnonzero(np.cumsum(border[:-1], dtype=np.int8) == 0)
        if not len(starts):
            continue
        own = low[starts]  # hash bits and position of each window's anchor
        new = own[1:] != own[:-1]
        new |= np.diff(starts) != 1
        head = np.append(0, np.flatnonzero(new) + 1)
        first = starts[head]
        count = np.diff(np.append(head, len(starts)))
        anchor = (own[head] & _POSITION).astype(np.int64)
        doc = np.searchsorted(offsets, a + first, side="right") - 1
        content = hashed.spans(first, first + count + window - 1)
        out.append((doc, grams[anchor].view(np.int64), content.view(np.int64), a + first - offsets[doc], count, anchor - first))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*out))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _tile_rows(docs: DataFrame, spec: Spec) -> DataFrame:
    """One row per document, anchor and content; ``more`` has the further starts in periodic texts, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_view(batch.column(2))
            for lo, hi in chunks(offsets):
                doc, anchor, content, start, count, distance = tiles(spec.symbols(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), spec.window, spec.gram)
                order = np.lexsort((start, content, anchor, doc))
                same_as_last = np.zeros(len(order), bool)
                key = np.stack([doc, anchor, content], 1)[order]
                same_as_last[1:] = (key[1:] == key[:-1]).all(1)
                head = np.flatnonzero(~same_as_last)
                further = start[order[same_as_last]].astype(np.int32)
                sizes = np.diff(np.append(head, len(order))) - 1
                at = np.append(0, np.cumsum(sizes)).astype(np.int32)
                more = pa.ListArray.from_arrays(pa.array(at, mask=np.append(sizes == 0, False)), pa.array(further)) if len(head) else pa.array([], pa.list_(pa.int32()))
                own = order[head]
                rows = pa.array(doc[own] + lo)
                small = lambda c: pa.array(c[own].astype(np.int32))  # noqa: E731, B023
                yield pa.record_batch(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor[own]), pa.array(content[own]), small(start), small(count), small(distance), more],
                    names=["doc_id", "text_key", "anchor", "content", "start", "count", "distance", "more"],
                )
        give_back()

    return docs.mapInArrow(run, "doc_id long, text_key long, anchor long, content long, start int, count int, distance int, more array<int>")


def split(p: Pieces, window: int, block: int) -> tuple[Pieces, np.ndarray, np.ndarray]:
    """Pieces cut into blocks of windows at fixed distances from the anchor, keyed by what all windows of a
    block share; with the piece that each came from and its first window there."""
    number = p.distance // block
    last = (p.distance - p.count + 1) // block
    k = number - last + 1
    source = np.repeat(np.arange(len(k)), k)
    own = np.repeat(number, k) - (ranges(np.zeros(len(k)), k))  # block number, downwards from the first window
    top = np.minimum(p.distance[source], own * block + block - 1)  # distance of the block's first window here
    bottom = np.maximum(p.distance[source] - p.count[source] + 1, own * block)
    shift = p.distance[source] - top
    start = p.start[source] + shift
    anchor_at = p.start[source] + p.distance[source]
    core = span_hashes(p.values, anchor_at - own * block, anchor_at - own * block - block + 1 + window)
    with np.errstate(over="ignore"):
        key = (core ^ (p.group[source].view(np.uint64) * _U(0x9E3779B97F4A7C15))) + (own.astype(np.uint64) << _U(48))
    return Pieces(p.values, start, top - bottom + 1, top, key.view(np.int64), p.value[source]), source, shift


def _piece_rows(docs: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """Contents of the wanted tiles, cut from their documents; very large groups in blocks."""

    def run(batches):
        for batch in batches:
            buf, offsets = text_view(batch.column(0))
            wants = batch.column(1)
            for lo, hi in chunks(offsets):
                part = wants.slice(lo, hi - lo)
                lists = part.flatten()
                sizes = np.diff(part.offsets.to_numpy())
                if not len(lists):
                    continue
                part_bytes = buf[offsets[lo] : offsets[hi]]
                s = spec.symbols(part_bytes, offsets[lo : hi + 1] - offsets[lo])
                get = lambda name: lists.field(name).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
                start = s.offsets[:-1][np.repeat(np.arange(hi - lo), sizes)] + get("start")
                anchor, content, kinds = get("anchor"), get("content"), get("kinds")
                whole = Pieces(s.values, start, get("count"), get("distance"), anchor, get("value"))
                for least, most, block in ((0, MANY, 0), (MANY, VAST, BLOCK), (VAST, 1 << 62, 1)):
                    pick = np.flatnonzero((kinds > least) & (kinds <= most))
                    if not len(pick):
                        continue
                    p = Pieces(whole.values, whole.start[pick], whole.count[pick], whole.distance[pick], anchor[pick], whole.value[pick])
                    source, shift = np.arange(len(pick)), np.zeros(len(pick), np.int64)
                    if block:
                        p, source, shift = split(p, spec.window, block)
                    for a in range(0, len(source), 4096):
                        b = slice(a, a + 4096)
                        n = p.count[b] + spec.window - 1
                        first = p.start[b]
                        if s.spans:
                            first, n = s.spans[0][first], s.spans[1][first + n - 1] - s.spans[0][first]
                        data = pa.py_buffer(part_bytes[ranges(first, n)].tobytes())
                        at = pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int32).tobytes())
                        binary = pa.Array.from_buffers(pa.binary(), len(n), [None, at, data])
                        columns = (p.group[b], anchor[pick][source[b]], content[pick][source[b]], shift[b], p.count[b], p.distance[b], p.value[b])
                        vast = pa.array(np.full(len(n), block == 1))
                        yield pa.record_batch([*map(pa.array, columns), binary, vast], names=["key", "anchor", "content", "shift", "count", "distance", "value", "symbols", "vast"])
        give_back()

    rows = docs.join(wanted, same(docs["doc_id"], wanted["w_id"]) & (docs["text_key"] == wanted["w_key"])).select("text", "wants")
    return rows.mapInArrow(run, "key long, anchor long, content long, shift long, count long, distance long, value long, symbols binary, vast boolean")


def _single_windows(pieces: DataFrame, spec: Spec) -> DataFrame:
    """The same for pieces of one window: summed up by the window's hashes, without an index."""
    one = pieces.select("key", F.xxhash64("symbols").alias("other"), "anchor", "content", "shift", "value").dropDuplicates(["anchor", "content", "shift"])
    found = one.groupBy("key", "other").agg((F.min("value") if spec.by_id else F.sum("value")).alias("found"))
    one = one.join(stored(found, "windows"), ["key", "other"])
    one = one.filter(F.col("found") < F.col("value") if spec.by_id else F.col("found") >= 2)
    return one.select("anchor", "content", F.col("shift").alias("first"), F.lit(1).cast("long").alias("length"), (F.col("found") if spec.by_id else F.lit(1).cast("long")).alias("value"))


def _indexed(pieces: DataFrame, spec: Spec) -> DataFrame:
    """Runs of windows with their values, for every content, from the kernel."""
    large = BATCH_SYMBOLS * (8 if spec.by_id else 1)

    def batches_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole groups of about BATCH_SYMBOLS symbols (or one larger group)."""
        held, size = [], 0
        for batch in rows:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if held and size >= large:
                # the group that is open goes on with this batch; what is before it is complete
                table = pa.Table.from_batches(held)
                own = table.column(0).to_numpy()
                border = int(np.searchsorted(own != own[-1], False)) if own[0] == own[-1] else int(np.flatnonzero(own != own[-1])[-1]) + 1
                if keys[0] != own[-1]:
                    border = len(own)
                if border:
                    yield table.slice(0, border)
                    held = table.slice(border).to_batches()
                    size = sum(b.column(7).nbytes for b in held)
            held.append(batch)
            size += batch.column(7).nbytes
        if held:
            yield pa.Table.from_batches(held)

    def run(rows):
        for table in batches_of(rows):
            table = table.combine_chunks()
            column = {c: table.column(c).combine_chunks() if table.num_rows else None for c in table.column_names}
            get = lambda c: column[c].to_numpy()  # noqa: E731, B023
            data = column["symbols"].chunk(0) if isinstance(column["symbols"], pa.ChunkedArray) else column["symbols"]
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            values, start = spec.decode(raw, offsets - offsets[0])
            # a repeated document row brings the same content again
            ident = np.stack([get("key"), get("anchor"), get("content"), get("shift")], 1)
            _, pick = np.unique(ident, axis=0, return_index=True)
            p = Pieces(values, start[pick], get("count")[pick], get("distance")[pick], get("key")[pick], get("value")[pick])
            found = spec.kernel(p)
            piece = np.repeat(np.arange(len(pick)), p.count)
            within = ranges(np.zeros(len(pick)), p.count)
            good = found >= 2 if not spec.by_id else found < np.repeat(p.value, p.count)
            value = found if spec.by_id else np.ones(len(found), np.int64)
            at = np.flatnonzero(good)
            if not len(at):
                continue
            new = np.append(True, (np.diff(at) != 1) | (piece[at[1:]] != piece[at[:-1]]) | (value[at[1:]] != value[at[:-1]]))
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(at)))
            own = pick[piece[at[head]]]
            yield pa.record_batch([pa.array(get("anchor")[own]), pa.array(get("content")[own]), pa.array(get("shift")[own] + within[at[head]]), pa.array(length), pa.array(value[at[head]])], names=["anchor", "content", "first", "length", "value"])
        give_back()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "anchor long, content long, first long, length long, value long")


def stored(df: DataFrame, name: str, summed: bool = True) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again; summed: few narrow rows after an aggregation."""
    path = fresh_folder(df.sparkSession, name)
    (in_fewer_files(df, 16, 12) if summed else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def covered_runs(docs: DataFrame, spec: Spec) -> DataFrame:
    """w_id, w_key and ``runs``: for each document with repeated windows, (first window, windows) runs.

    With ``by_id``, windows that also start in a document of a smaller doc_id; else windows that start
    anywhere else too.  A null doc_id is never smaller; repeated rows count as documents of their own.
    """
    docs = _keyed(docs)
    found = _tile_rows(docs, spec)
    count = F.sum(F.coalesce(F.array_size("more"), F.lit(0)) + 1)
    repeated = (F.min("doc_id").eqNullSafe(F.max("doc_id")) == F.lit(False)) | F.max(F.col("doc_id").isNull()) if spec.by_id else count > 1
    # stored, so that the join deals out both sides anew and may split a frequent anchor's partition
    anchors = stored(found.groupBy("anchor").agg(repeated.alias("again"), count.alias("n")).filter("again AND n > 1").select("anchor"), "anchors")
    occurrences = stored(found.join(anchors, "anchor"), "tiles", summed=False)
    first = F.min(F.struct("doc_id", "text_key", "start", "count", "distance"))
    kinds = stored(occurrences.groupBy("anchor", "content").agg(count.alias("n"), F.min("doc_id").alias("least"), first.alias("rep")), "contents")
    # stored as well, so that a frequent anchor's contents may be split where they meet their number
    many = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    kinds = stored(kinds.join(many, "anchor"), "numbered", summed=False)
    value = F.coalesce("least", F.lit((1 << 63) - 1)) if spec.by_id else F.col("n")
    single = kinds.filter("kinds = 1").select("anchor", "content", F.lit(0).cast("long").alias("first"), F.col("rep.count").cast("long").alias("length"), value.cast("long").alias("value"))
    if not spec.by_id:
        single = single.filter("value > 1")
    several = kinds.filter("kinds > 1").select("rep.*", "anchor", "content", "kinds", value.cast("long").alias("value"))
    item = F.struct("anchor", "content", F.col("start").cast("long").alias("start"), F.col("count").cast("long").alias("count"), F.col("distance").cast("long").alias("distance"), "kinds", "value")
    wanted = several.groupBy(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")).agg(F.collect_list(item).alias("wants"))
    several_kinds = kinds.agg(F.max("kinds")).first()[0] or 0
    pieces = _piece_rows(docs, wanted, spec)
    runs = _indexed(pieces.filter("NOT vast") if several_kinds > VAST else pieces, spec)
    if several_kinds > VAST:
        runs = runs.union(_single_windows(pieces.filter("vast"), spec))
    own = single if not spec.by_id else single.union(several.select("anchor", "content", F.lit(0).cast("long"), F.col("count").cast("long"), "value"))
    if not spec.by_id:
        own = own.union(several.filter("value > 1").select("anchor", "content", F.lit(0).cast("long"), F.col("count").cast("long"), "value"))
    # one row per content, which has at most a window's number of runs, so an occurrence meets one row
    masks = stored(own.union(runs).groupBy("anchor", "content").agg(F.collect_list(F.struct("first", "length", "value")).alias("found")), "masks")
    hits = occurrences.join(masks, ["anchor", "content"])
    own_id = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    wanted_runs = F.filter("found", lambda r: r["value"] < own_id) if spec.by_id else F.col("found")
    starts = F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<int>")))
    moved = F.flatten(F.transform(starts, lambda s: F.transform(wanted_runs, lambda r: F.struct((s + r["first"]).alias("first"), r["length"].alias("length")))))
    rows = hits.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), moved.alias("runs")).filter(F.size("runs") > 0)
    return rows.groupBy("w_id", "w_key").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def cover(runs: list[tuple[int, int]], window: int, n: int) -> np.ndarray:
    """Mask of the n symbols that the windows of the runs cover."""
    step = np.zeros(n + 1, np.int64)
    if runs:
        r = np.array(runs, np.int64)
        np.add.at(step, r[:, 0], 1)
        np.add.at(step, r[:, 0] + r[:, 1] + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def with_runs(docs: DataFrame, spec: Spec) -> tuple[DataFrame, str]:
    """``docs`` (all columns) with one more column, null where nothing repeats, and that column's name."""
    mark = uuid.uuid4().hex  # no column of the input has such a name
    found = covered_runs(docs, spec).toDF(f"id_{mark}", f"key_{mark}", f"runs_{mark}")
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    joined = docs.join(found, same(docs["doc_id"].cast("long"), found[f"id_{mark}"]) & (key == found[f"key_{mark}"]), "left")
    return joined.select(*[docs[c] for c in docs.columns], found[f"runs_{mark}"]), f"runs_{mark}"
