"""The inverted index and many criteria give what a scan or a filter per criterion gives."""

import glob
import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wardlake.functions import records
from wardlake.operators import search
from wardlake.sources import tokenindex
from wardlake.streaming import arrivals
from wardlake.workload import fixtures as fx

SMALL = "/root/testdata/sf0.001"
PATHS = {"Observation": ["status", "code.coding[0].code", "subject.reference"], "Condition": ["code.text"]}


def ids(df):
    return sorted(r.id for r in df.collect())


def test_index_equals_the_scan_on_all_tokens(spark, tmp_path):
    found = fx.resources(spark, SMALL, "Condition")
    tokenindex.write_index(tokenindex.token_rows(found, {"Condition": ["code.text"]}, names=False), str(tmp_path))
    index = tokenindex.read_index(spark, str(tmp_path))
    own = records.json_path(F.col("resource"), "id").alias("id")
    tokens = sorted(r.token for r in index.select("token").distinct().collect())
    assert len(tokens) == 5
    for token in [*tokens, "none"]:
        assert ids(tokenindex.find(index, "Condition", "code.text", token)) == ids(
            search.search_by_token(found, "Condition", "code.text", token).select(own)
        )


def test_values_of_all_shapes(spark, tmp_path):
    rows = [
        ("Observation", {"id": "1", "status": "final", "code": {"coding": [{"code": "x"}]}}),
        ("Observation", {"id": "2", "status": "final"}), ("Observation", {"status": "final"}), ("Observation", "broken"),
        ("Condition", {"id": "1", "code": {"text": "final"}}),
        ("Patient", {"id": "p", "name": [{"family": "De Ville", "given": ["Ann", "Mae"]}, {"text": "Ann D"}]}),
        ("Patient", {"id": "q", "name": [{"family": "Annan"}]}), ("Patient", {"id": "r"}),
    ]
    df = spark.createDataFrame([(t, r if isinstance(r, str) else json.dumps(r)) for t, r in rows], "resource_type string, resource string")
    tokenindex.write_index(tokenindex.token_rows(df, PATHS), str(tmp_path))
    index = tokenindex.read_index(spark, str(tmp_path))
    assert ids(tokenindex.find(index, "Observation", "status", "final")) == ["1", "2"]
    assert ids(tokenindex.find(index, "Observation", "status", "final", "x")) == ["1", "2"]
    assert ids(tokenindex.find(index, "Observation", "code.coding[0].code", "x")) == ["1"]
    assert ids(tokenindex.find_name(index, "ANN")) == ["p", "q"] and ids(tokenindex.find_name(index, "ann", family_only=True)) == ["q"]
    assert ids(tokenindex.find_name(index, "de v")) == ["p"]


def test_a_search_reads_few_row_groups(spark, tmp_path):
    """The token reaches the scan, and the files are sorted by it."""
    df = spark.range(40_000).select(
        F.lit("Observation").alias("resource_type"), F.lit("code").alias("path"), F.format_string("t%05d", F.col("id") % 20_000).alias("token"),
        F.col("id").cast("string").alias("id"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tokenindex.write_index(df, str(tmp_path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = tokenindex.find(tokenindex.read_index(spark, str(tmp_path)), "Observation", "code", "t00007")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    assert "EqualTo(token,t00007)" in found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert ids(found) == ["20007", "7"]
    spans = [
        (r.low, r.high) for r in tokenindex.read_index(spark, str(tmp_path)).groupBy(F.input_file_name())
        .agg(F.min("token").alias("low"), F.max("token").alias("high")).collect()
    ]
    assert len(spans) > 1 and sum(low <= "t00007" <= high for low, high in spans) == 1


def test_ten_thousand_criteria_at_once(spark, tmp_path):
    lines = [{"resourceType": "Observation", "id": str(i), "status": ("final", "draft")[i % 2], "code": {"text": f"c{i % 700}"}} for i in range(900)]
    lines += [{"resourceType": "Task", "id": f"t{i}", "status": "final"} for i in range(5)] + [{"resourceType": "Other", "id": "o"}]
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "x.txt").write_text("\n".join(map(json.dumps, lines)) + "\nnoise")
    criteria = [(f"code {i}", "Observation", "code.text", f"c{i}") for i in range(10_000)]
    criteria += [("final", "Observation", "status", "final"), ("all", "Task", None, None), ("none", "Task", "status", None), ("final", "Observation", "status", "final")]
    out = str(tmp_path / "out")
    table = spark.createDataFrame(criteria, "criterion string, resource_type string, path string, token string")
    query = arrivals.stream_subscriptions(arrivals.arriving_resources(spark, str(folder)), table, out, str(tmp_path / "check"))
    assert query.awaitTermination(300)
    got = sorted((r.criterion, json.loads(r.resource)["id"]) for r in spark.read.parquet(out).collect())

    def value(record, path):
        for step in path.split("."):
            record = record.get(step) if record else None
        return record

    want = sorted({(c, r["id"]) for c, t, p, token in criteria for r in lines
                   if r["resourceType"] == t and (p is None or (token is not None and value(r, p) == token))})
    assert got == want
    assert arrivals.matches(table.selectExpr("'Task' AS resource_type", "'{}' AS resource"), table.limit(0)).count() == 0


def test_index_is_made_once_and_sorted_in_its_ranges(spark, tmp_path):
    """Rows that come twice, far apart and in one token that most records have; the rows are not made again for the ranges."""
    tokens = tokenindex.token_rows(fx.resources(spark, SMALL, "Observation"), {"Observation": PATHS["Observation"]}, names=False)
    assert "lambdafunction" not in tokens._jdf.queryExecution().optimizedPlan().toString()
    made, folder = spark.sparkContext.accumulator(0), str(tmp_path / "index")

    def rows(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame[["resource_type", "path", "token", "id"]]

    source = spark.range(0, 6000, 1, 6).select(
        F.lit("T").alias("resource_type"), F.lit("p").alias("path"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id") % 7)).otherwise("hot").alias("token"),
        (F.col("id") % 2000).cast("string").alias("id"),
    )
    tokenindex.write_index(source.mapInPandas(rows, tokenindex.SCHEMA), folder)
    assert made.value == 6000
    index = tokenindex.read_index(spark, folder)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, source.distinct().collect()))
    for file in glob.glob(f"{folder}/*.parquet"):
        kept = [tuple(r.values()) for r in pq.read_table(file).to_pylist()]
        assert kept == sorted(set(kept))
