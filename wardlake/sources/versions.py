"""The latest version of every record, kept as a snapshot and the writes behind it.

A snapshot is dealt into buckets of the key. New writes go to a log beside it. The current state is the snapshot, less the
keys that were written since, and the latest of those writes: the log alone is sorted, the snapshot is read as it lies.
``compact`` takes the log into the snapshot: only the buckets whose keys were written are read and written anew; the others
stay where earlier snapshots put them, as the list of the new one says. A writer at a time; a compaction that fails leaves
the old list in force.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.operators.search import latest_versions
from wardlake.sources import tables as store

BUCKETS = 64


class VersionStore:
    """``keys`` name a record, ``order`` tells which of its writes is later (ties have to be settled by it)."""

    def __init__(
        self, spark: SparkSession, folder: str, keys: Sequence[str] = ("type", "id"), order: Sequence[str] = ("written_at", "seq")
    ) -> None:
        self.spark, self.folder, self.keys, self.order = spark, folder.rstrip("/"), list(keys), list(order)

    def _numbers(self, name: str) -> list[int]:
        found = store.list_names(self.spark, f"{self.folder}/{name}")
        return sorted(int(n) for n in found if store.exists(self.spark, f"{self.folder}/{name}/{n}/_SUCCESS"))

    def put(self, writes: DataFrame) -> None:
        """Add writes to the log."""
        number = max([*self._numbers("log"), *self._numbers("list"), 0]) + 1
        writes.write.parquet(f"{self.folder}/log/{number}")

    def _placed(self) -> tuple[int, dict[int, int]]:
        """The last write in the snapshot, and the snapshot that holds each bucket."""
        numbers = self._numbers("list")
        if not numbers:
            return 0, {}
        rows = self.spark.read.parquet(f"{self.folder}/list/{numbers[-1]}").collect()  # a row per bucket
        return numbers[-1], {r["bucket"]: r["number"] for r in rows if r["number"]}

    def _log(self, after: int) -> DataFrame | None:
        paths = [f"{self.folder}/log/{n}" for n in self._numbers("log") if n > after]
        return self.spark.read.parquet(*paths) if paths else None

    def _snapshot(self, placed: dict[int, int], buckets: Sequence[int]) -> DataFrame | None:
        paths = [f"{self.folder}/snapshot/{placed[b]}/_bucket={b}" for b in buckets if b in placed]
        return self.spark.read.parquet(*paths) if paths else None

    def current(self) -> DataFrame | None:
        """The latest write of every key; None while there is none."""
        upto, placed = self._placed()
        log, snapshot = self._log(upto), self._snapshot(placed, sorted(placed))
        if log is None or snapshot is None:
            return snapshot if log is None else latest_versions(log, self.keys, self.order)
        written = log.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        # Writes may arrive late: what the snapshot has of the same keys is judged with them.
        judged = latest_versions(log.unionByName(snapshot.join(written, same, "left_semi")), self.keys, self.order)
        return snapshot.join(written, same, "left_anti").unionByName(judged)

    def compact(self) -> int:
        """Take the log into the snapshot; returns how many buckets were written."""
        upto, placed = self._placed()
        log = self._log(upto)
        if log is None:
            return 0
        number = max(self._numbers("log"))
        log = log.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int"))
        hit = sorted(r["_bucket"] for r in log.select("_bucket").distinct().collect())
        old = self._snapshot(placed, hit)
        if old is not None:
            log = log.unionByName(old.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")))
        latest = latest_versions(log, self.keys, self.order)
        latest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/snapshot/{number}")
        rows = [(b, number if b in hit else placed.get(b, 0)) for b in range(BUCKETS)]
        listed = self.spark.createDataFrame(rows, "bucket int, number int").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.folder}/list/{number}")
        return len(hit)
