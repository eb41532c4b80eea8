"""Selecting rows per entity: newest N, between bounds, skips, upserts, lookups.

Every ordered choice takes tie-break columns, as Spark's sorts are not stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_n(df: DataFrame, entity: Sequence[str], by: str, n: int, ties: Sequence[str], until: object = None, where: Column | None = None) -> DataFrame:
    """The ``n`` rows of each entity with the largest ``by`` not after ``until``.

    Rows with a null or empty ``by`` are left out. Adds ``rn`` (1 is the newest);
    Catalyst prunes each partition to ``n`` rows per entity before the shuffle.
    """
    rows = df.where(F.col(by).isNotNull() & (F.col(by).cast("string") != ""))
    if until is not None:
        rows = rows.where(F.col(by) <= F.lit(until))
    if where is not None:
        rows = rows.where(where)
    order = Window.partitionBy(*entity).orderBy(F.col(by).desc(), *[F.col(t).asc() for t in ties])
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def between_latest_two(inner: DataFrame, outer: DataFrame, entity: str, by: str, ties: Sequence[str]) -> DataFrame:
    """Rows of ``inner`` strictly between the newest and second newest ``by`` of
    the entity in ``outer``; entities with fewer than two give nothing.

    The bounds are one row per entity, joined on the entity with a range residual.
    """
    top = latest_n(outer.select(entity, by, *[t for t in ties if t not in (entity, by)]), [entity], by, 2, ties)
    bounds = top.groupBy(entity).agg(F.max(F.when(F.col("rn") == 1, F.col(by))).alias("_newest"), F.max(F.when(F.col("rn") == 2, F.col(by))).alias("_prior"))
    bounds = bounds.where("_prior is not null")
    return inner.join(bounds, entity).where((F.col("_prior") < F.col(by)) & (F.col(by) < F.col("_newest"))).drop("_newest", "_prior")


def not_yet_present(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Idempotent skip: the wanted rows whose keys are not present."""
    return wanted.join(present.select(*keys), list(keys), "left_anti")


def latest_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def latest_version(df: DataFrame, keys: Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one with the largest ``version`` (nulls last)."""
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def lookup_with_override(df: DataFrame, base: DataFrame, override: DataFrame, key: str, value: str) -> DataFrame:
    """Inner lookup of ``value``: the override wins over the base, unmatched rows go.

    No broadcast is forced: Spark broadcasts a side only under its size threshold.
    """
    b = base.select(key, F.col(value).alias("_base"))
    o = override.select(key, F.col(value).alias("_own"))
    joined = df.join(o, key, "left").join(b, key, "left")
    return joined.withColumn(value, F.coalesce("_own", "_base")).drop("_own", "_base").where(F.col(value).isNotNull())


def argmax_per_group(df: DataFrame, group: Sequence[str], by: str, first: Sequence[str]) -> DataFrame:
    """The row with the largest ``by`` per group; of equal ones the first by ``first``."""
    order = Window.partitionBy(*group).orderBy(F.col(by).desc_nulls_last(), *[F.col(c).asc() for c in first])
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def missing_keys(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected keys that do not occur; null keys are not expected."""
    return expected.select(key).where(F.col(key).isNotNull()).distinct().join(present.select(key), key, "left_anti")


def rows_of_columns(df: DataFrame, keep: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Columnar records (parallel arrays) to one row per position, with ``pos``."""
    zipped = df.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_z"))
    return zipped.select(*keep, "pos", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def first_match(df: DataFrame, key: str, value: object, order: Sequence[str]) -> DataFrame:
    """Point lookup: the first row (by ``order``) whose key equals ``value``."""
    return df.where(F.col(key) == F.lit(value)).orderBy(*order).limit(1)
