"""Steps that are stored leave no shuffle files behind."""

import os
import time

from pyspark.sql import functions as F

from wardlake.session import CLEANUP, durable, stored, tidy


def shuffled(spark):
    """Names of the shuffle files that Spark holds."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for top in manager.localDirsString() for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}


def left(spark, before):
    until = time.time() + 20
    while (more := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return more


def test_stored_steps_leave_no_shuffle_files(spark, tmp_path):
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffled(spark)
    first, again = stored(counts, "counts", str(tmp_path / "counts")), durable(counts)
    assert not left(spark, before)
    assert first.count() == 7 and sorted(r["count"] for r in again.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_the_setting_comes_back(spark):
    was = spark.conf.get(CLEANUP, None)
    with tidy(spark):
        with tidy(spark):
            assert spark.conf.get(CLEANUP) == "true"
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP, None) == was
