"""Ordered semantics: running switches, suffixes for repeated keys, cold starts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_hash(group: Sequence[str]) -> dict[str, Column]:
    """128 bits that stand for the group columns, nulls told apart; joins on them are
    plain equi-joins, whatever the columns' nulls."""
    parts = [x for g in group for x in (F.isnull(g), F.col(g))]
    return {"_g0": F.xxhash64(F.lit(0), *parts), "_g1": F.xxhash64(F.lit(1), *parts)}


def running_switch(df: DataFrame, group: Sequence[str], order: Sequence[str], event: Column, at: int, before: str, after: str, out: str = "part") -> DataFrame:
    """``before`` until the ``at``-th event of the group (by ``order``), then ``after``."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.coalesce(event.cast("int"), F.lit(0))).over(upto)
    return df.withColumn(out, F.when(seen >= at, after).otherwise(before))


def sampled_bucket(df: DataFrame, order: Sequence[str], parts: int = 1024, sample: int = 16_384) -> Column:
    """The number of each row's range of the order columns, -1 for a null first one.

    The bounds are quantiles of a sample of fixed size (the rows of least hash, so the
    same rows every time), so they follow the data wherever it lies, numbers or
    strings. Where single values of the first column fill whole ranges, the bounds go
    on to the other columns. Nothing but the sample comes to the driver.
    """
    first = df.where(F.col(order[0]).isNotNull()).select(*order)
    rows = [tuple(r) for r in first.orderBy(F.xxhash64(*order)).limit(sample).collect()]  # ``sample`` rows at most
    whole = len(order) > 1 and all(x is not None for r in rows for x in r)
    rows = sorted(r if whole else r[:1] for r in rows)
    cuts = sorted({rows[i * len(rows) // parts] for i in range(1, parts)}) if rows else []
    heads = [c[0] for c in cuts]
    single = not whole or len(set(heads)) == len(heads)
    bounds = np.array(heads if single else [None] * len(cuts), None if single and heads and isinstance(heads[0], (int, float)) else object)
    if not single:
        bounds[:] = cuts

    @F.pandas_udf("int")
    def bucket(*columns: pd.Series) -> pd.Series:
        there = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
        kept = [[x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in c[there]] if c.dtype.kind == "M" else c[there].to_numpy() for c in columns]
        values = np.empty(int(there.sum()), object) if not single or bounds.dtype == object else kept[0]
        if values.dtype == object:
            values[:] = kept[0] if single else list(zip(*kept))
        at = np.full(len(there), -1, np.int32)
        at[there] = np.searchsorted(bounds, values, "right")
        # a null in a later column: the range of the first column alone
        for i in np.flatnonzero(~there & columns[0].notna().to_numpy()):
            at[i] = bisect_left(heads, columns[0][i])
        return pd.Series(at)

    return bucket(*[F.col(c) for c in (order[:1] if single else order)])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "n", buckets: int = 1024) -> DataFrame:
    """Row numbers within groups of any size: no task sorts a whole group.

    The rows' order is cut into ranges at sampled bounds (``sampled_bucket``; nulls of
    the first column come first); rows are counted per group and range, the counts are
    summed up over a group's ranges, and rows are numbered within a range.
    """
    rows = df.withColumn("_bucket", sampled_bucket(df, order, buckets)).withColumns(group_hash(group))
    hashed = list(group_hash(group))
    counts = rows.groupBy(*hashed, "_bucket").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*hashed).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*hashed, "_bucket", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(*hashed, "_bucket").orderBy(*[F.col(c).asc() for c in order]))
    joined = rows.withColumn("_local", local).join(offsets, [*hashed, "_bucket"])
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_bucket", "_local", "_before", *hashed)


def suffix_duplicates(df: DataFrame, key: Column, order: Sequence[str], out: str = "key") -> DataFrame:
    """Unique keys by arrival: the first keeps its key, later ones get ``#2``, ``#3``..."""
    keyed = numbered(df.withColumn("_key", key), ["_key"], order, "_n")
    return keyed.withColumn(out, F.when(F.col("_n") == 1, F.col("_key")).otherwise(F.concat("_key", F.lit("#"), F.col("_n").cast("string")))).drop("_key", "_n")


def without_first(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows but the first (cold) one of each group; a group of one keeps it.

    The first row comes from an aggregate, which combines before it moves.
    """
    place = F.struct(*order)
    firsts = df.groupBy(*group).agg(F.min(place).alias("_first"), F.count("*").alias("_rows"))
    return df.join(firsts, list(group)).where((place > F.col("_first")) | (F.col("_rows") == 1)).drop("_first", "_rows")


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
