"""Counts, previews, searches and versions."""

import json

import pytest
from pyspark.sql import functions as F

from wardlake.functions import records
from wardlake.operators import browse, extract, numbering, search


def resources(spark, *items):
    rows = [(i.get("resourceType"), json.dumps(i)) for i in items]
    return spark.createDataFrame(rows, "resource_type string, resource string")


def ids(df):
    return sorted(json.loads(r.resource)["id"] for r in df.collect())


def counts(spark, **n):
    return spark.createDataFrame(list(n.items()), "table string, n_rows bigint")


def test_merge_report(spark):
    report = browse.merge_report(counts(spark, b=3, a=1), counts(spark, b=5, a=1, c=2), counts(spark, b=4, d=7))
    assert [tuple(r) for r in report.collect()] == [("a", 1, 0, 1, 0), ("b", 3, 4, 5, 2), ("c", 0, 0, 2, 2), ("d", 0, 7, 0, 0)]


def test_filter_impact_with_empty_tables(spark):
    impact = browse.filter_impact(counts(spark, a=0, b=3, c=8), counts(spark, a=0, b=1))
    assert [tuple(r) for r in impact.orderBy("table").collect()] == [("a", 0, 0, 0, 0.0), ("b", 3, 1, -2, -66.7), ("c", 8, 0, -8, -100.0)]


def test_stats_and_totals(spark):
    data = {"patient": spark.range(3), "mvt": spark.range(2).withColumn("x", F.lit(1))}
    assert [tuple(r) for r in browse.table_stats(data, spark).collect()] == [("mvt", 2, 2)]
    assert tuple(browse.dataset_totals(data, spark).first()) == (2, 5, {"mvt": 2, "patient": 3})


def test_empty_dataset(spark):
    assert browse.table_stats({}, spark).collect() == [] and tuple(browse.dataset_totals({}, spark).first()) == (0, 0, {})


def test_bundle_summary_counts_entries_without_a_resource(spark):
    docs = spark.createDataFrame([('{"entry":[{"resource":{"resourceType":"A"}},{"request":{}}]}',)], "value string")
    found = browse.bundle_summary(extract.bundle_entries(docs, with_empty=True))
    assert {r.resource_type: r.n for r in found.collect()} == {"A": 1, "*": 2}


def test_bundle_summary(spark):
    found = browse.bundle_summary(resources(spark, {"resourceType": "A"}, {"resourceType": "A"}, {"id": "x"}))
    assert {r.resource_type: r.n for r in found.collect()} == {"A": 2, "*": 3}


def test_preview(spark):
    df = spark.createDataFrame([("b", "long text", 1), ("a", None, 2)], "PATID string, t string, n int")
    assert [tuple(r) for r in browse.preview(df, ["PATID"], limit=1).collect()] == [("a", None, 2)]
    assert "Sort" not in browse.preview(df, limit=1)._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in browse.preview_columns(df, ["t"], max_cell=5, order=["PATID"]).collect()] == [("",), ("long…",)]
    assert browse.preview_columns(df, max_cols=2).columns == ["PATID", "t"]
    with pytest.raises(ValueError):
        browse.preview_columns(df, ["nope"])


def test_import_status(spark):
    rows = [("1", "A", True), ("1", "A", True), ("1", None, True), ("2", "B", True), ("2", None, False)]
    status = browse.import_status(spark.createDataFrame(rows, "patient_id string, resource_type string, readable boolean"))
    assert sorted(tuple(r) for r in status.collect()) == [("1", "success", 3, {"A": 2}), ("2", "failed", 2, {"B": 1})]
    assert tuple(browse.import_totals(status).first()) == (2, 1, 1)


@pytest.fixture
def store(spark):
    name = lambda family, *given: [{"family": family, "given": list(given)}]
    return resources(
        spark,
        {"resourceType": "Patient", "id": "1", "name": name("Smith Doe", "Jane")},
        {"resourceType": "Patient", "id": "2", "name": name("Roe", "Smiley")},
        {"resourceType": "Patient", "id": "3"},
        {"resourceType": "Observation", "id": "o1", "status": "final", "subject": {"reference": "Patient/1"}},
        {"resourceType": "Observation", "id": "o2", "status": "draft", "patient": {"reference": "Patient/2"}},
        {"resourceType": "Device", "id": "d"},
    )


def test_searches(spark, store):
    assert ids(search.search_by_id(store, "Patient", ["1", "3", "o1"])) == ["1", "3"]
    assert ids(search.search_by_id(store, "Patient", spark.createDataFrame([("2",), ("2",)], "x string"))) == ["2"]
    assert ids(search.search_by_token(store, "Observation", "status", "final", "other")) == ["o1"]
    assert ids(search.search_by_name(store, "SMI")) == ["1", "2"]
    assert ids(search.search_by_name(store, "smi", family_only=True)) == ["1"]
    assert ids(search.search_by_name(store, "smi", ["2", "3"])) == ["2"]
    assert [r.patient_id for r in browse.patient_ids(store, 2).collect()] == ["1", "2"]
    assert browse.patient_ids(store).count() == 3


def test_everything(spark, store):
    assert ids(search.patient_everything(store, ["1"])) == ["1", "o1"]
    assert ids(search.patient_everything(store, spark.createDataFrame([("2",)], "x string"))) == ["2", "o2"]
    assert ids(search.patient_everything(store)) == ["1", "2", "3", "o1", "o2"]


def test_everything_with_what_the_same_parse_tells(spark):
    texts = [
        '{"resourceType":"Patient","id":"1"}', '{"resourceType":"Patient","id":2,"subject":"x"}',
        '{"resourceType":"Patient","id":"3","subject":"x","subject":["y"]}', '{"id":"o1","subject":{"reference":"Patient/1"}}',
        '{"id":"o2","patient":{"reference":"Patient/2"}', '{"id":"o3","subject":{"reference":"Patient/3"}} tail', "", None,
    ]
    store = spark.createDataFrame([("Patient" if t and "Patient\"," in t else "Other", t) for t in texts], "resource_type string, resource string")
    plain = search.patient_everything(store).select(
        "*", records.json_path(F.col("resource"), "id").alias("id"), records.is_readable(F.col("resource")).alias("readable")
    )
    found = search.patient_everything(store, with_id=True, with_readable=True)
    assert found.columns == plain.columns and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert [r.readable for r in found.collect()] == [True] * 5


def test_everything_of_some_patients_leaves_the_texts_behind(spark, store):
    wanted = spark.createDataFrame([("2",)], "x string").hint("merge")
    found = search.patient_everything(store, wanted, with_id=True).select("patient_id", "id")
    assert sorted(map(tuple, found.collect())) == [("2", "2"), ("2", "o2")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "resource#" not in plan[plan.index("Join"):plan.index("Generate")] and "get_json_object" not in plan


def test_pages(spark):
    df = spark.range(95).select(F.format_string("k%03d", "id").alias("k"))
    found = search.search_pages(df, "k", 10).orderBy("k").collect()
    assert [r.page_no for r in found] == [i // 10 + 1 for i in range(95)] and {r.total for r in found} == {95}
    page, seen = search.search_page(df, "k", 40), []
    while rows := [r.k for r in page.collect()]:
        seen += rows
        page = search.search_page(df, "k", 40, rows[-1])
    assert seen == [r.k for r in found]


def test_lastn(spark):
    df = spark.createDataFrame(
        [("s", "c", "2024-01", "b"), ("s", "c", "2024-02", "z"), ("s", "c", "2024-02", "a"), ("s", "d", "2023", "q"), ("t", "c", None, "n")],
        "subject string, code string, effective string, id string",
    )
    assert sorted(r.id for r in search.lastn(df).collect()) == ["a", "n", "q"]
    assert sorted(r.id for r in search.lastn(df, 2).collect()) == ["a", "n", "q", "z"]


def test_search_lastn(spark):
    def observation(i, subject, code, date, *categories):
        return {
            "resourceType": "Observation", "id": i, "subject": {"reference": f"Patient/{subject}"}, "effectiveDateTime": date,
            "code": code, "category": [{"coding": [{"code": c}]} for c in categories],
        }

    a, b = {"coding": [{"code": "a"}], "text": "x"}, {"text": "b"}
    store = resources(
        spark, observation("1", "p", a, "2024-01", "lab"), observation("2", "p", a, "2024-02", "vital", "lab"),
        observation("3", "p", b, "2024-01", "vital"), observation("4", "q", a, "2023-12"), {"resourceType": "Device", "id": "5"},
    )
    assert ids(search.search_lastn(store)) == ["2", "3", "4"]
    assert ids(search.search_lastn(store, 2, category=["lab"])) == ["1", "2"]
    assert ids(search.search_lastn(store, code=["b"])) == ["3"]
    assert ids(search.search_lastn(store, until="2024-02")) == ["1", "3", "4"]
    assert ids(search.search_lastn(store, since="2024-01", patients=["p"])) == ["2", "3"]
    assert ids(search.search_lastn(store, patients=spark.createDataFrame([("q",)], "x string"))) == ["4"]


@pytest.fixture
def log(spark):
    """One record that holds a third of all writes, all of them at the same moment, and many small ones."""
    hot = spark.range(1000).selectExpr("'T' AS type", "'hot' AS id", "0 AS written_at", "id AS seq", "id = 999 AS deleted")
    cold = spark.range(2000).selectExpr("'T' AS type", "CAST(id % 50 AS STRING) AS id", "id % 7 AS written_at", "id AS seq", "false AS deleted")
    nulls = spark.range(30).selectExpr("'T' AS type", "CAST(null AS STRING) AS id", "0 AS written_at", "id AS seq", "false AS deleted")
    return hot.unionByName(cold).unionByName(nulls)


def brute_versions(log):
    groups = {}
    for r in log.collect():
        groups.setdefault((r.type, r.id), []).append((r.written_at, r.seq))
    return sorted((str(k), at, n) for k, writes in groups.items() for n, at in enumerate(sorted(writes), 1))


@pytest.mark.parametrize("group_rows", [10**9, 100, 1])
def test_version_history_of_small_and_large_groups(log, group_rows):
    found = search.version_history(log, group_rows=group_rows).collect()
    assert sorted((str((r.type, r.id)), (r.written_at, r.seq), r.version) for r in found) == brute_versions(log)


def test_latest_and_deleted(log):
    latest = search.upsert_put(log).collect()
    assert len(latest) == 52 and {r.seq for r in latest if r.id == "hot"} == {999}
    assert "hot" not in {r.id for r in search.delete_resource(log).collect()}


def test_latest_rows_are_found_before_the_shuffle(log):
    for df in (search.upsert_put(log), search.lastn(log, 5, "type", "id", "written_at", "seq")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Partial" in plan and "WindowGroupLimit" in plan


def test_numbering_cuts_a_single_group_into_slices(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    found = numbering.number_rows(df, [F.col("v")], name="n")
    assert found.filter("n <> v + 1").count() == 0 and found.count() == 5000
