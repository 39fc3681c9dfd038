"""Analytics on result series(run, l, value): envelopes, windows, divergences, fits, reshaping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def envelope(series: DataFrame, keys: list[str], how: str = "min") -> DataFrame:
    """Element-wise least (or largest) value over the strategies, by level."""
    return series.groupBy(*keys, "l").agg((F.min if how == "min" else F.max)("value").alias("value"))


def resilience(series: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Sum of the series over n."""
    return series.groupBy(*keys).agg((F.sum("value") / n).alias("rob"))


def moving_average(series: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Mean of the ``period`` values before the current one; null for the first ``period``."""
    order = Window.partitionBy(*keys).orderBy("l")
    mean = F.avg("value").over(order.rowsBetween(-period, -1))
    return series.withColumn("average", F.when(F.row_number().over(order) > period, mean))


def running_mean(series: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("l").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("average", F.avg("value").over(order))


def difference(series: DataFrame, keys: list[str]) -> DataFrame:
    """Change from the level before; null for the first."""
    return series.withColumn("diff", F.col("value") - F.lag("value").over(Window.partitionBy(*keys).orderBy("l")))


def relative_loss(series: DataFrame, keys: list[str]) -> DataFrame:
    """(first - value) / first."""
    first = F.first_value("value").over(Window.partitionBy(*keys).orderBy("l").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.withColumn("loss", (first - F.col("value")) / first)


def next_ratio(series: DataFrame, keys: list[str]) -> DataFrame:
    """Ratio of the next value to this one (gains of consecutive seeds)."""
    return series.withColumn("ratio", F.lead("value").over(Window.partitionBy(*keys).orderBy("l")) / F.col("value"))


def stacked(frame: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Cumulative sum within groups."""
    return frame.withColumn("stacked", F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def keep_last(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def jensen_shannon(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, jsd of columns p and q after each is scaled to sum 1 (natural logarithm)."""
    sums = pairs.groupBy(*keys).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    x = pairs.join(sums, keys).withColumn("p", F.col("p") / F.col("sp")).withColumn("q", F.col("q") / F.col("sq")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / F.col("m"))).otherwise(0.0)
    return x.groupBy(*keys).agg(((F.sum(part("p")) + F.sum(part("q"))) / 2).alias("jsd"))


def r2_score(pairs: DataFrame, keys: list[str], true: str = "y", fake: str = "f") -> DataFrame:
    """1 - sum((y - f)^2) / sum((y - mean y)^2)."""
    e = F.col(true) - F.col(fake)
    return pairs.groupBy(*keys).agg((1 - F.sum(e * e) / (F.var_pop(true) * F.count(true))).alias("r2"))


def correlations(frame: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of every pair of columns, as rows."""
    row = frame.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in columns for b in columns])
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a in columns for b in columns]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def interpolated(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, l, value on every integer level between the sampled ones, linearly."""
    order = Window.partitionBy(*keys).orderBy("l")
    spans = samples.withColumn("_l", F.lead("l").over(order)).withColumn("_v", F.lead("value").over(order))
    end = F.when(F.col("_l").isNull(), F.col("l")).otherwise(F.col("_l") - 1)
    rows = spans.withColumn("_x", F.explode(F.sequence(F.col("l"), end)))
    share = F.coalesce((F.col("_x") - F.col("l")) / (F.col("_l") - F.col("l")), F.lit(0.0))
    return rows.select(*keys, F.col("_x").alias("l"), (F.col("value") + share * (F.coalesce("_v", "value") - F.col("value"))).alias("value"))


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with not-a-knot ends (a parabola through three points, a line through two)."""
    n = len(x)
    if n <= 3:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a = np.zeros((n, n))
    b = np.zeros(n)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (d[i] - d[i - 1])
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[k]
    return y[k] + t * (d[k] - h[k] * (2 * m[k] + m[k + 1]) / 6) + t**2 * m[k] / 2 + t**3 * (m[k + 1] - m[k]) / (6 * h[k])


def spline(samples: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, l, value for l = 0..n-1, from a cubic spline through each group's samples."""
    kinds = dict(samples.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("l")
        at = np.arange(n)
        out = pd.DataFrame({k: [own[k].iloc[0]] * n for k in keys})
        return out.assign(l=at.astype(np.int32), value=not_a_knot(own["l"].to_numpy(float), own["value"].to_numpy(float), at.astype(float)))

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "l int", "value double"])
    return samples.groupBy(*keys).applyInPandas(run, schema)


def cubic_fit(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the coefficients c3..c0 of the least-squares cubic of y over x."""
    kinds = dict(frame.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.polyfit(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), min(3, max(0, pdf["x"].nunique() - 1)))
        c = np.concatenate([np.zeros(4 - len(c)), c])
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], *c]], columns=[*keys, "c3", "c2", "c1", "c0"])

    return frame.groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "c3 double", "c2 double", "c1 double", "c0 double"]))


def unpivoted(frame: DataFrame, ids: list[str], columns: list[str], name: str = "solver", value: str = "objective") -> DataFrame:
    return frame.unpivot(ids, columns, name, value)


def upper_median(column: str) -> Column:
    """The element at size / 2 of the sorted group (nth-element median)."""
    return F.element_at(F.sort_array(F.collect_list(column)), F.floor(F.count(column) / 2).cast("int") + 1)


# scalar functions


def title(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "_", " "))


def initials(c: Column) -> Column:
    """First letters of the words that '_' parts."""
    return F.array_join(F.transform(F.split(c, "_"), lambda x: F.substring(x, 1, 1)), "")


def footprint(c: Column) -> Column:
    """Sorted tokens joined by '_', without dots."""
    return F.replace(F.array_join(F.array_sort(F.split(c, "-")), "_"), F.lit("."), F.lit(""))


def md5_number(c: Column) -> Column:
    """First 60 bits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def flag_value(c: Column, flag: str) -> Column:
    """The integer after a flag of a command line."""
    return F.regexp_extract(c, rf"-{flag} ([0-9]+)", 1).cast("long")


def pairs_of(c: Column) -> Column:
    """[u0, v0, u1, v1, ...] as an array of (src, dst)."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 2).cast("int") - 1), lambda i: F.struct(F.get(c, 2 * i).alias("src"), F.get(c, 2 * i + 1).alias("dst")))


def contains_all(a: Column, b: Column) -> Column:
    """Whether b's elements are all in a."""
    return F.size(F.array_except(b, a)) == 0
