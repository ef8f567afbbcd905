"""A key that holds a third of all rows, or none at all, changes neither results nor the shape of plans."""

import pytest
from pyspark.sql import functions as F

from wardlake.operators import enrich, extract, merge
from wardlake.operators import filters as flt


@pytest.fixture
def skewed(spark):
    """A third of the rows has one patient, a third has none."""
    key = "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN CAST(null AS STRING) ELSE concat('p', id % 500) END"
    return spark.range(30_000).selectExpr(f"{key} AS PATID", "concat('e', id % 999) AS EVTID", "concat('x', id) AS ELTID")


@pytest.fixture
def joins(spark):
    """No broadcast, and thresholds that make the adaptive join split partitions of test size."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in settings:
        spark.conf.unset(k)


def patients(spark):
    found = spark.range(500).selectExpr("concat('p', id) AS PATID", "'F' AS PATSEX", "CAST(id % 90 AS INT) AS PATAGE", "'1980' AS PATBD")
    hot = spark.createDataFrame([("hot", "M", 7, "2017")], "PATID string, PATSEX string, PATAGE int, PATBD string")
    return found.unionByName(hot)


def test_enrichment_spreads_rows_without_a_key_and_splits_a_hot_key(joins, skewed):
    facts = extract.enforce_schema(skewed.repartition(16), "pharma")
    joined = enrich.enrich_patient(facts, patients(joins))
    joined.write.format("noop").mode("overwrite").save()
    rows = joined.groupBy("PATSEX").count().collect()
    assert {r.PATSEX: r["count"] for r in rows} == {"M": 10_000, None: 10_000, "F": 10_000}
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()

    sizes = [
        r.n for r in facts.withColumn("_key", F.coalesce("PATID", F.pmod(F.xxhash64("EVTID", "ELTID"), F.lit(enrich.NULL_SPREAD)).cast("string")))
        .filter("PATID IS NULL").repartition(8, "_key").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    ]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_merge_with_a_hot_key(joins, skewed):
    base = skewed.filter("PATID = 'hot' OR PATID IS NULL").limit(12_000)
    fresh = merge.new_rows(base, skewed, ["PATID"])
    assert {r.PATID for r in fresh.select("PATID").distinct().collect()}.isdisjoint({"hot", None})
    assert fresh.count() == 10_000


def test_propagation_of_a_hot_key(joins, skewed):
    data = {"a": skewed, "b": skewed.select("PATID", "EVTID")}
    kept = flt.filter_dataset(data, [flt.Where("a", "PATID", "==", "hot")], [flt.Propagate("PATID", "a")])
    assert kept["b"].count() == 10_000
    plan = kept["b"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Cross" not in plan
