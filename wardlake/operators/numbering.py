"""Exact row numbers for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlake.session import durable, stored

# Largest group that one task sorts by itself.
GROUP_ROWS = 5_000_000


def number_rows(
    df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "rn", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """1-based numbers in ``order``, starting again per ``within`` group. The order must be total.

    Eager: it first counts the groups. Groups of up to ``group_rows`` rows take a plain window; the rows
    of larger ones (all rows, if there are no groups) are numbered slice by slice.
    """
    if not within:
        return _number_slices(df, order, within, name)
    large = df.groupBy(*within).count().filter(F.col("count") > group_rows).select(
        *[F.col(c).alias(f"_{c}") for c in within]
    )
    plain = F.row_number().over(W.partitionBy(*within).orderBy(*order)).cast("bigint")
    if large.isEmpty():
        return df.withColumn(name, plain)
    large = stored(large, "large-groups")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
    small_part = df.join(large, same, "left_anti").withColumn(name, plain)
    return small_part.unionByName(_number_slices(df.join(large, same, "left_semi"), order, within, name))


def _number_slices(df: DataFrame, order: Sequence[Column], within: Sequence[str], name: str) -> DataFrame:
    """Cut the sort order into ranges, number each range, add the rows of the ranges before it.

    The ranges come from a sample, so they are stored before they are used twice: a lost executor must
    not draw them again.
    """
    ranges = df.repartitionByRange(*[F.col(c) for c in within], *order)
    ranges = durable(ranges.withColumn("_slice", F.spark_partition_id()))
    keys = [*within, "_slice"]
    before = W.partitionBy(*within).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranges.groupBy(*keys).agg(F.count("*").alias("_rows"))
    offsets = sizes.select(
        *[F.col(k).alias(f"_at_{k}") for k in keys],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
    )
    local = ranges.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    joined = local.join(offsets, same)
    return joined.withColumn(name, F.col("_local") + F.col("_offset")).select(*df.columns, name)
