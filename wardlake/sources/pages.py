"""A result stored with a directory of its pages: page n is read from the one or two ranges that hold it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardlake.operators.search import PAGE_SIZE


def write_pages(df: DataFrame, key: str, folder: str, ranges: int | None = None) -> None:
    """Store the rows by ranges of the key, which must be unique, and how many rows each range has.

    Whole rows are shuffled this once; which rows a page has follows from the counts.
    """
    dealt = df.repartitionByRange(ranges, key) if ranges else df.repartitionByRange(key)
    dealt = dealt.withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", key)
    dealt.write.mode("overwrite").partitionBy("_range").parquet(f"{folder}/rows")
    spark = df.sparkSession
    counts = spark.read.schema(dealt.schema).parquet(f"{folder}/rows").groupBy("_range").agg(F.count("*").alias("n"))
    head = spark.createDataFrame([(-1, 0, key, dealt.schema.json())], "_range int, n bigint, key string, shape string")
    counts = counts.select("_range", "n", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("shape"))
    head.unionByName(counts).coalesce(1).write.mode("overwrite").parquet(f"{folder}/directory")


def page_total(spark: SparkSession, folder: str) -> DataFrame:
    """(total): rows of the stored result."""
    return spark.read.parquet(f"{folder}/directory").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))


def read_page(spark: SparkSession, folder: str, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """Rows of a page (from 1) in the order of the key, none behind the last page.

    The directory has a row per range, so it comes to the driver.
    """
    first, last = (page - 1) * size, page * size
    head, *entries = sorted(spark.read.parquet(f"{folder}/directory").collect(), key=lambda r: r["_range"])
    before, skipped, hit = 0, 0, []
    for entry in entries:
        if before < last and before + entry["n"] > first:
            hit.append(entry["_range"])
        elif before + entry["n"] <= first:
            skipped += entry["n"]
        before += entry["n"]
    rows = spark.read.schema(StructType.fromJson(json.loads(head["shape"]))).parquet(f"{folder}/rows")
    found = rows.filter(F.col("_range").isin(hit)).drop("_range")
    return found.orderBy(head["key"]).offset(first - skipped if hit else 0).limit(size)
