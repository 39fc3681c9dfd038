"""Helpers shared by the operators: byte views of Arrow columns, numbering, and the engine's shared folders."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, fresh_folder, shared_folder

__all__ = ["CHUNK_BYTES", "chunks", "crc_bucket", "cut", "documents", "fresh_folder", "give_back", "give_up_kept", "in_fewer_files", "in_files_of", "kept_by_worker", "ranges", "same", "shared_folder", "text_view", "whole_groups"]

#: Bytes of text that a kernel looks at in one numpy call; bounds a worker's memory.
CHUNK_BYTES = 1 << 20


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one UTF-8 byte array and the n+1 offsets into it; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (lo, hi) of about ``limit`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each pair."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, e = np.asarray(starts, np.int64)[full], ends[full]
    heads = np.concatenate(([0], e[:-1]))
    out[heads] = s
    out[heads[1:]] -= s[:-1] + lengths[full][:-1] - 1
    return np.cumsum(out)


_KEPT = []


def kept_by_worker(make):
    """``make``, whose last two results a worker keeps from task to task, until a kernel of another operator needs the room."""
    found = functools.lru_cache(2)(make)
    _KEPT.append(found)
    return found


@functools.cache
def _trim():
    """The C library's malloc_trim, or, where it has none, a function that does nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Memory that is free in this process goes back to the system: Arrow's, and the C library's, which keeps whatever lies below a block in use."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def give_up_kept() -> None:
    """Workers are used again: what other operators keep in this one goes, and what earlier kernels have freed."""
    if any(f.cache_info().currsize for f in _KEPT):
        for f in _KEPT:
            f.cache_clear()
        gc.collect()
    give_back()


def whole_groups(batches, keys: tuple[str, ...]):
    """(table, offsets) of whole groups of rows that come sorted by integer keys; group g is rows offsets[g] to offsets[g + 1]."""

    def closed(held):
        table = pa.Table.from_batches(held).combine_chunks()
        own = np.stack([table.column(c).to_numpy() for c in keys], 1)
        return table, np.concatenate(([0], np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1, [len(own)]))

    give_up_kept()
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(c).to_numpy() for c in keys], 1)
        changes = np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1
        if len(changes) or (held and (own[0] != last).any()):
            border = int(changes[-1]) if len(changes) else 0
            if border:
                held.append(batch.slice(0, border))
            if held:
                yield closed(held)
            held = []
            batch = batch.slice(border)
        held.append(batch)
        last = own[-1]
    if held:
        yield closed(held)
    del held
    give_back()


def in_fewer_files(df: DataFrame, by: int = 8, least: int = 1) -> DataFrame:
    """A shuffle's result in a ``by``-th of its partitions, ``least`` or more: for narrow rows, whose partitions make tiny files.

    Each task reads its partitions one after the other, so it needs no more memory than one of them.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, min(partitions, least), partitions // by))


def in_files_of(df: DataFrame, rows: int, each: int = 4096, least: int = 12) -> DataFrame:
    """A shuffle's result in no more partitions than ``rows`` documents need at ``each``, or ``least``.

    On a local disk Hadoop starts processes for each file, however small.  ``each`` is less than the rows of an Arrow batch,
    which both sides hold whole, so that batches stay about as small as without this.
    """
    return df.coalesce(max(least, -(-rows // each)))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def same(a, b):
    """Null-safe equality of two columns."""
    return a.eqNullSafe(b)


def crc_bucket(column, modulus: int):
    """crc32 of the id written as text, modulo; a null id is the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
