"""What is written, sorted and parsed at volume: forms that keep disk, memory and time small."""

import datetime as dt
import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wardlake.operators import export
from wardlake.plans import importing
from wardlake.sources import bundles, runs, tables
from wardlake.streaming import arrivals
from wardlake.workload import exports, reports
from wardlake.workload import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def given(spark, folder):
    """Tables with a line that names no order, one that names no part, and an order that comes twice."""
    day = dt.datetime(1997, 1, 1)
    spark.createDataFrame([(1, 7), (2, 8), (2, 9)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        [(5, "n", "t", "b")], "p_partkey bigint, p_name string, p_type string, p_brand string"
    ).write.parquet(f"{folder}/part.parquet")
    rows = [(o, p, 1, n, float(n), "A", "F", day) for n, (o, p) in enumerate([(1, 5), (2, 5), (3, 5), (None, 5), (1, None), (1, 6)])]
    shape = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, shape).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def clinic(spark, folder):
    """``given``, orders, customers, nations and documents, with nulls and rows that come twice."""
    given(spark, folder)
    day = dt.datetime(1997, 1, 1)
    orders = [(1, 7, "F", day, "1-URGENT"), (2, 8, "O", None, None), (2, 9, None, day, "5-LOW"), (None, None, "P", day, "x")]
    spark.createDataFrame(
        orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"
    ).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        [(7, "a", "BUILDING"), (8, None, None), (8, None, None)], "c_custkey bigint, c_name string, c_mktsegment string"
    ).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(1, "n")], "n_nationkey bigint, n_name string").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(1, "r")], "r_regionkey bigint, r_name string").write.parquet(f"{folder}/region.parquet")
    spark.createDataFrame([(3, "s\"")], "s_suppkey bigint, s_name string").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame(
        [(1, "one", "en", "s"), (2, None, "fr", None), (9, "x", None, "s")], "doc_id bigint, text string, lang string, source string"
    ).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_bundles_of_some_kinds_read_their_sources_alone(spark, tmp_path):
    folder = clinic(spark, tmp_path)
    every = fx.bundles(spark, folder).collect()
    for kind in fx.BUNDLE_KINDS:
        some = fx.bundles(spark, folder, kind)
        named = [r for r in every if r.name is not None and r.name.startswith(f"{kind}-")]
        assert ("FileScan parquet [l_" in plan(some)) == (kind == "line")
        assert sorted(map(str, some.filter("name IS NOT NULL").collect())) == sorted(map(str, named))
    asked = plan(reports.import_requests(spark, folder))
    assert "FileScan parquet [l_" not in asked and asked.count("FileScan parquet [c_") == 1


def test_records_of_all_types_read_each_source_once(spark, tmp_path):
    folder = clinic(spark, tmp_path)
    together, apart = fx.all_resources(spark, folder), fx.resources(spark, folder)
    assert plan(together).count("FileScan parquet [l_") == 1 and plan(apart).count("FileScan parquet [l_") == 2
    assert together.columns == apart.columns and sorted(map(str, together.collect())) == sorted(map(str, apart.collect()))


def test_last_runs_reads_no_errors_that_nobody_asks_for(spark, tmp_path):
    path, day = str(tmp_path / "runs"), dt.datetime(2024, 1, 1)
    rows = [("a", "import", None, day, None, "{}", ["x"]), ("b", "import", None, day, None, "{}", ["x", "y"]),
            ("b", "import", None, day, None, "{}", ["x", "y"]), ("c", None, None, None, None, "{}", []), ("d", "export", None, day, None, "{}", None)]
    runs.append_runs(spark.createDataFrame(rows, runs.SCHEMA), path)
    last = runs.last_runs(spark.read.parquet(path))
    assert "errors:array" not in plan(last.select("run_type", "run_id", "n_errors"))
    found = sorted((r.run_type or "", r.run_id, r.n_errors, r.errors) for r in last.collect())
    assert found == [("", "c", 0, []), ("export", "d", 0, None), ("import", "b", 2, ["x", "y"])]


def test_packed_lines_are_read_back(spark, tmp_path):
    parts = [("p1", "head", '{"resourceType":"Bundle","type":"transaction","id":"p1","entry":[')] + [
        ("p1", "entry", f'{"," if i else ""}{{"resource":{{"id":"{i}"}}}}') for i in range(50)] + [("p1", "tail", "]}")]
    lines = spark.createDataFrame(parts, "bundle_id string, kind string, value string").coalesce(1)
    bundles.write_bundles(lines.repartitionByRange(3, F.monotonically_increasing_id()), str(tmp_path / "out"), **bundles.PACKED)
    assert all(f.endswith(".txt.gz") for f in glob.glob(f"{tmp_path}/out/part-*"))
    read = bundles.read_bundles(spark, str(tmp_path / "out"))
    assert sorted((r.bundle_id, r.kind, r.value) for r in read.collect()) == sorted((b, k, v.lstrip(",")) for b, k, v in parts)


def codecs(folder):
    files = glob.glob(f"{folder}/**/*.parquet", recursive=True)
    read = [pq.ParquetFile(f).metadata for f in files]
    return {m.row_group(0).column(0).compression for m in read if m.num_row_groups}


def test_stage_and_tables_are_packed(spark, tmp_path):
    rows = spark.createDataFrame([("Patient", '{"resourceType":"Patient","id":"1"}')], "resource_type string, resource string")
    importing.stage_resources(rows, str(tmp_path / "stage"))
    tables.append_table(rows, str(tmp_path), "patient")
    assert codecs(tmp_path / "stage") == codecs(tmp_path / "patient.parquet") == {"ZSTD"}


def test_matches_of_a_stream_are_packed(spark, tmp_path):
    spark.createDataFrame([('{"resourceType":"Patient","id":"1"}',)], "value string").write.options(**bundles.PACKED).text(str(tmp_path / "in"))
    criteria = spark.createDataFrame([("all", "Patient", None, None)], "criterion string, resource_type string, path string, token string")
    stream = arrivals.arriving_resources(spark, str(tmp_path / "in"))
    assert arrivals.stream_subscriptions(stream, criteria, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(300)
    assert codecs(tmp_path / "out") == {"ZSTD"}
    assert [r.criterion for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["all"]


def test_line_items_are_joined_without_sorts(spark, tmp_path):
    lines = fx.lines(spark, given(spark, tmp_path))
    assert "SortMergeJoin" not in plan(lines) and "ShuffledHashJoin" in plan(lines)
    found = sorted((r.l_linenumber, r.o_custkey, r.p_name) for r in lines.collect())
    assert found == [(0, 7, "n"), (1, 8, "n"), (1, 9, "n"), (2, None, "n"), (3, None, "n"), (4, 7, None), (5, 7, None)]


def test_a_record_is_parsed_once_for_all_paths(spark, tmp_path):
    found = exports.set_path(spark, given(spark, tmp_path))
    assert "get_json_object" not in plan(found)
    assert sorted((r.subject_reference, r.code_coding0_code) for r in found.collect() if r.subject_reference)[0] == ("Patient/p7", "5")


def test_an_export_deals_its_records_once_and_sorts_no_json(spark, tmp_path, monkeypatch):
    """Whole bundles in a task need no second exchange to be numbered; large ones are still cut."""
    rows = [("1", "e1", 2, "X", f"{i % 7}", None, f'{{"id":"{i % 7}","n":{i}}}') for i in range(20)] + [("2", "e2", 2, "X", "a", "l", "{}")]
    columns = "patient_id string, stay_id string, ord int, type string, id string, location_id string, resource string"
    records = spark.createDataFrame(rows, columns)
    flat = exports._flat(export.bundle_by_patient(records))
    text = plan(flat)
    assert text.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning(bundle_id#" not in text.split("Exchange rangepartitioning")[0]
    assert "_text" not in "".join(line for line in text.splitlines() if " Sort [" in line)
    found = sorted((r.bundle_id, r.pos, r.url) for r in flat.collect())
    assert found == [("patient-1", i, f"X/{i}") for i in range(7)] + [("patient-2", 0, "Location/l"), ("patient-2", 1, "X/a")]
    lines = sorted((r.bundle_id, r.ord, r.id, r.kind, r.value) for r in export.bundle_by_patient(records).collect())
    monkeypatch.setattr(export, "MANY_COPIES", 1)
    assert lines == sorted((r.bundle_id, r.ord, r.id, r.kind, r.value) for r in export.bundle_by_patient(records).collect())


def test_an_export_has_more_ranges_for_more_records(spark, monkeypatch):
    monkeypatch.setattr(export, "SORTED_ROWS", 10)
    rows = [(str(i), None, 2, "X", str(i), None, "{}") for i in range(200)]
    columns = "patient_id string, stay_id string, ord int, type string, id string, location_id string, resource string"
    assert export.bundle_by_patient(spark.createDataFrame(rows, columns)).rdd.getNumPartitions() == 20


def test_line_items_of_an_export_are_joined_once(spark, tmp_path):
    given(spark, tmp_path)
    items = fx.stored_lines(spark, str(tmp_path))
    assert "Join" not in plan(items)
    assert sorted((r.l_linenumber, r.o_custkey, r.p_name) for r in items.collect()) == [
        (0, 7, "n"), (1, 8, "n"), (1, 9, "n"), (2, None, "n"), (3, None, "n"), (4, 7, None), (5, 7, None)]
