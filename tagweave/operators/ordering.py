"""Ordered operators that never put a whole group, or a whole table, into one task.

Each works on two levels: rows are shuffled by ``(keys, bucket)``, where the bucket grows with the
order, and only one summary row per bucket is ordered over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagweave.session import cut_lineage


def _bucketed(keys: list[str]) -> list[str]:
    return [*keys, "_bucket"]


def rank_in_group(df: DataFrame, keys: list[str], order: list, bucket: Column,
                  name: str = "rank") -> DataFrame:
    """Exact ``row_number`` over keys and order. ``bucket`` must be monotone in the order."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*_bucketed(keys)).count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inner = Window.partitionBy(*_bucketed(keys)).orderBy(*order)
    return (
        rows.withColumn("_inner", F.row_number().over(inner))
        .join(offsets, _bucketed(keys))
        .withColumn(name, (F.col("_inner") + F.col("_offset")).cast("bigint"))
        .drop("_bucket", "_inner", "_offset")
    )


def rank_by_range(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """Exact ``row_number`` without a bucket: Spark cuts the rows into ranges of sampled quantiles, which
    are written out once; ranks are counted within ranges, and only one summary row per range and key
    is ordered over a whole group. Keys of few rows and a whole table (no keys) are equally fine."""
    cut = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    return rank_in_group(cut_lineage(cut), keys, order, F.col("_range"), name).drop("_range")


def next_in_group(df: DataFrame, keys: list[str], position: str, value: str, name: str,
                  width: int = 1024) -> DataFrame:
    """``lead(value)`` over keys ordered by an integer position."""
    rows = df.withColumn("_bucket", F.floor(F.col(position) / width))
    inner = Window.partitionBy(*_bucketed(keys)).orderBy(position)
    following = (
        rows.groupBy(*_bucketed(keys)).agg(F.min_by(value, position).alias("_first"))
        .withColumn("_next_first", F.lead("_first").over(
            Window.partitionBy(*keys).orderBy("_bucket")))
        .drop("_first")
    )
    last = F.lead(F.lit(1)).over(inner).isNull()
    return (
        rows.withColumn("_last", last).withColumn("_lead", F.lead(value).over(inner))
        .join(following, _bucketed(keys))
        .withColumn(name, F.when(F.col("_last"), F.col("_next_first")).otherwise(F.col("_lead")))
        .drop("_bucket", "_last", "_lead", "_next_first")
    )


def carry_forward(df: DataFrame, keys: list[str], position: str, value: Column, name: str,
                  width: int = 1024) -> DataFrame:
    """Last non-NULL value up to and including this row, keys ordered by an integer position."""
    rows = df.withColumn("_value", value).withColumn("_bucket", F.floor(F.col(position) / width))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*_bucketed(keys))
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(position))).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
        .drop("_last")
    )
    inner = Window.partitionBy(*_bucketed(keys)).orderBy(position).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_inner", F.last("_value", ignorenulls=True).over(inner))
        .join(carried, _bucketed(keys))
        .withColumn(name, F.coalesce("_inner", "_carried"))
        .drop("_bucket", "_value", "_inner", "_carried")
    )


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int,
                  rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark cuts every task to k rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
            .withColumn(rank, F.col(rank).cast("bigint")))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest order per key, combined before the shuffle. Rows and orders of texts
    make it a sort aggregate: a task sorts its own rows by key."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns added or replaced that are computed once each: a generator of one row keeps the
    optimizer from writing their expressions into every later use."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
