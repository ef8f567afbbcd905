"""Session helpers: shared folders for what must survive a lost executor."""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor reaches: the one named in ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own, not yet there, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/wardlake/{name}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidy, _tidied, _before = threading.Lock(), Counter(), {}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files behind.

    Spark keeps them until the driver happens to collect its garbage, so a job of many steps holds those of all steps. Meant
    for steps that are stored: nothing reads their shuffles again. Threads and nested uses share the setting; the last one puts
    it back.
    """
    session = spark._jsparkSession.sessionUUID()
    with _tidy:
        if not _tidied[session]:
            _before[session] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _tidied[session] += 1
    try:
        yield
    finally:
        with _tidy:
            _tidied[session] -= 1
            if not _tidied[session]:
                before = _before.pop(session)
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def side_by_side(action: Callable[[Any], Any], items: Iterable[Any]) -> list:
    """Run an action (one Spark job or more) per item at the same time; results in the order of the items.

    Independent writes then share the cluster instead of waiting for each other's last tasks. The threads keep the
    job group and the pool of the caller; the first error is raised when all have ended.
    """
    items = list(items)
    results: list = [None] * len(items)
    errors: list[BaseException] = []

    def run(place: int) -> None:
        try:
            results[place] = action(items[place])
        except Exception as error:
            errors.append(error)

    threads = [InheritableThread(target=run, args=(i,)) for i in range(len(items))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if errors:
        raise errors[0]
    return results


def spread(df: DataFrame) -> DataFrame:
    """Give a small input to all cores.

    A small file is one split, however much work follows per row. An input that has a split per core and more
    is left as it is: large tables are never shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    per_split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if size < cores * per_split else df


def durable(df: DataFrame) -> DataFrame:
    """The rows, stored once in the shared folder. Eager."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()  # planned here, so that it is tidied up


def stored(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """The rows, written once below the shared folder (or to ``path``) and read back. Eager.

    Spark knows the size of what is read back, so a join broadcasts it only if it is small, and does so
    without shuffling the other side first. Meant for small results that are used several times, and for what costs more to
    make again than to read. ``options`` are those of Spark's Parquet files.
    """
    path = path or scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
