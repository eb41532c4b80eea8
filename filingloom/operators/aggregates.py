"""Counts, rates, medians and pivots of the diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.operators.windows import group_hash, sampled_bucket


def top_counts(df: DataFrame, by: str, first: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values; of equally frequent ones the first seen by ``first``."""
    counted = df.groupBy(by).agg(F.count("*").alias("cnt"), F.min(first).alias("_first"))
    return counted.orderBy(F.desc("cnt"), F.asc("_first")).limit(n).drop("_first")


def rate_by_group(df: DataFrame, group: Sequence[str], hit: Column) -> DataFrame:
    """``hits``, ``total`` and ``rate`` per group, groups without a hit left out."""
    counted = df.groupBy(*group).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))
    return counted.where("hits > 0").withColumn("rate", F.col("hits") / F.col("total"))


def pivot_counts(df: DataFrame, index: str, columns: str, values: str, names: Sequence[str]) -> DataFrame:
    """Non-null ``values`` counted per index and named column value, zero where none.

    The column values are named by the caller, so no extra job looks for them.
    """
    return df.groupBy(index).pivot(columns, list(names)).agg(F.count(values)).na.fill(0, list(names))


def upper_median(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``upper_median``: the element at index n // 2 of the sorted non-null values,
    and their count ``n``, per group (of the whole table for an empty ``group``).

    Equal values are counted before they move. The different values are cut into
    ranges at sampled bounds; the running count over a group's ranges finds the one
    that holds the middle, and only its values are looked at. No group is sorted or
    gathered as a whole.
    """
    keys = [c.alias(n) for n, c in group_hash(group).items()]
    hashed = list(group_hash(group))
    values = df.where(F.col(value).isNotNull()).select(*group, *keys, F.col(value).alias("_v"))
    counts = values.groupBy(*group, *hashed, "_v").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_bucket", sampled_bucket(values, ["_v"]))
    coarse = counts.groupBy(*hashed, "_bucket").agg(F.sum("_c").alias("_s"))
    whole = Window.partitionBy(*hashed)
    upto = F.sum("_s").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    spots = coarse.select(*hashed, "_bucket", (upto - F.col("_s")).alias("_before"), upto.alias("_upto"), F.sum("_s").over(whole).alias("_n"))
    target = F.floor(F.col("_n") / 2) + 1
    spots = spots.where((F.col("_before") < target) & (target <= F.col("_upto"))).drop("_upto")
    inside = counts.join(spots, [*hashed, "_bucket"])
    run = F.sum("_c").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    found = inside.withColumn("_run", run).where((F.col("_run") - F.col("_c") < target) & (target <= F.col("_run")))
    return found.select(*group, F.col("_v").alias("upper_median"), F.col("_n").alias("n"))


def over_limit(df: DataFrame, value: str, limit: int) -> DataFrame:
    """``over``, ``total``, ``share`` of the values above ``limit``, and the largest."""
    return df.agg(F.count_if(F.col(value) > limit).alias("over"), F.count("*").alias("total"), F.max(value).alias("largest")).withColumn("share", F.col("over") / F.col("total"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """How many rows beyond the first share a key: ``n_rows``, ``n_keys``, ``repeated``."""
    return df.agg(F.count(key).alias("n_rows"), F.countDistinct(key).alias("n_keys")).withColumn("repeated", F.col("n_rows") - F.col("n_keys"))


def weighted_cost(df: DataFrame, per_million: Mapping[str, float], out: str = "cost") -> DataFrame:
    """Sum of columns times a weight per million, rounded to six places."""
    total = sum((F.col(c) / F.lit(1e6) * F.lit(float(w)) for c, w in per_million.items()), F.lit(0.0))
    return df.withColumn(out, F.round(total, 6))


def failures(df: DataFrame, failed: Column, order: Sequence[str], n: int = 3) -> DataFrame:
    """A sample of at most ``n`` failed rows, the first by ``order``, for a report."""
    return df.where(failed).orderBy(*order).limit(n)


def median_or_least(df: DataFrame, value: str, low: int, high: int, ties: Sequence[str]) -> DataFrame:
    """A sample row: the upper-median row of those with low <= value < high, else
    the row with the least value."""
    band = df.where((F.col(value) >= low) & (F.col(value) < high))
    n = band.count()
    if n:
        middle = upper_median(band, [], value).select(F.col("upper_median").alias("_m"))
        # the middle row among those of the middle value, by the tie-break
        same = band.join(F.broadcast(middle), F.col(value) == F.col("_m")).drop("_m")  # one row
        before = band.join(F.broadcast(middle), F.col(value) < F.col("_m")).count()
        return same.orderBy(*ties).offset(n // 2 - before).limit(1)
    return df.where(F.col(value).isNotNull()).orderBy(value, *ties).limit(1)
