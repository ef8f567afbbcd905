"""Parquet tables and datasets: a dataset is a folder with one ``<table>.parquet`` per table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SUFFIX = ".parquet"
# Records and rows are much alike from one to the next: half the size that the default codec gives.
CODEC = "zstd"


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def table_path(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{table.removesuffix(SUFFIX)}{SUFFIX}"


def scan_table(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """One table of a dataset, None if absent. Columns and filters used later reach the Parquet scan."""
    path = table_path(folder, table)
    return spark.read.parquet(path) if exists(spark, path) else None


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    at, fs = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def list_tables(spark: SparkSession, folder: str, hidden: tuple[str, ...] = ()) -> list[str]:
    """Table names of a dataset, sorted."""
    names = list_names(spark, folder)
    return sorted(n.removesuffix(SUFFIX) for n in names if n.endswith(SUFFIX) and n.removesuffix(SUFFIX) not in hidden)


def scan_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table of a folder, by name."""
    return {t: spark.read.parquet(table_path(folder, t)) for t in list_tables(spark, folder)}


def write_table(
    df: DataFrame, folder: str, table: str, copy_to: str | None = None, keep_empty: bool = False
) -> bool:
    """Replace a table; one without rows is written only if ``keep_empty``. Says whether it was.

    The rows go to a new folder first, which then takes the table's place: readers never see half a table
    (for a moment they may see none), and the plan may read the very table that it replaces. The old table is moved
    aside and deleted only when the new one is in place; if that fails, it is put back. A second copy is made from
    the files written.
    """
    spark = df.sparkSession
    target = table_path(folder, table)
    fresh = f"{folder.rstrip('/')}/_new-{table}-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    at, fs = _path(spark, fresh)
    written = spark.read.schema(df.schema).parquet(fresh)
    if not keep_empty and written.isEmpty():
        fs.delete(at, True)
        return False
    if copy_to:
        written.write.mode("overwrite").parquet(table_path(copy_to, table))
    goal, _ = _path(spark, target)
    aside, _ = _path(spark, f"{folder.rstrip('/')}/_old-{table}-{uuid.uuid4().hex}")
    had = fs.exists(goal)
    if had and not fs.rename(goal, aside):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(at, goal):
        if had:
            fs.rename(aside, goal)
        raise OSError(f"cannot move {fresh} to {target}")
    if had:
        fs.delete(aside, True)
    return True


def append_table(df: DataFrame, folder: str, table: str) -> int:
    """Add rows to a table; what is there is not rewritten. The write itself counts them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(table_path(folder, table), compression=CODEC)
    return seen.get["n"]


def move_table(spark: SparkSession, source: str, target: str, table: str) -> bool:
    """Give a table to a dataset that lacks it, without a copy; False if the two lie in different stores."""
    at, fs = _path(spark, table_path(source, table))
    goal, other = _path(spark, table_path(target, table))
    if str(fs.getUri().toString()) != str(other.getUri().toString()):
        return False
    other.mkdirs(goal.getParent())
    return bool(fs.rename(at, goal))


def drop_tables(spark: SparkSession, folder: str, tables) -> None:
    """Start from empty tables; the key index of a table goes with it."""
    for table in tables:
        for path in (table_path(folder, table), f"{folder.rstrip('/')}/{table}.keys"):
            remove(spark, path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of one's own, such as the stage of a finished import."""
    at, fs = _path(spark, folder)
    fs.delete(at, True)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Values of a text file, one per line; blanks around them and empty lines are dropped."""
    return spark.read.text(path).select(F.trim("value", F.lit(" \t\r\f\x0b")).alias("value")).filter("value <> ''")
