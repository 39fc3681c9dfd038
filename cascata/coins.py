"""Deterministic coins: all randomness is a pure function of keys, the same in Spark and in DuckDB.

A coin's key is a purpose tag and ids joined by '-'; its value is the first 8 hex digits of the key's MD5
as an unsigned 32-bit number.  An event of probability num / den happens if value * den < num * 2**32.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = 1 << 32


def u32(tag: str, *parts) -> Column:
    key = F.concat_ws("-", F.lit(tag), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def uniform(tag: str, *parts) -> Column:
    return u32(tag, *parts) / F.lit(float(SIDES))


def happens(coin: Column, num: Column, den: int) -> Column:
    """Whether an event of probability num / den happens (never at 0, always from den on)."""
    return coin * den < F.least(num, F.lit(den)) * SIDES


def u32_sql(tag: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('-', '{tag}', {', '.join(parts)})), 1, 8) AS BIGINT)"


def happens_sql(coin: str, num: str, den: int) -> str:
    return f"({coin} * {den} < least({num}, {den}) * {SIDES})"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned numbers (SplitMix64's), for coins that are drawn in tasks only."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
