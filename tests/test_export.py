"""Records and bundles on hand-written rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wardlake import model
from wardlake.operators import export, extract
from wardlake.plans import exporting
from wardlake.sources import bundles


def table(spark, name, *items):
    columns = list(items[0])
    df = spark.createDataFrame([tuple(i[c] for c in columns) for i in items], ", ".join(f"{c} string" for c in columns))
    return extract.enforce_schema(df, name)


def built(df):
    return [json.loads(r.resource) for r in df.orderBy("id", "ord").collect()]


def test_record_of_a_full_row(spark):
    mvt = table(spark, "mvt", {"PATID": "Patient/1", "EVTID": "urn:uuid:e", "ELTID": "l/1", "DATENT": "2024", "DATSORT": "", "SEJUM": "U", "SEJUF": None})
    assert built(export.rows_to_resources(mvt, "mvt")) == [
        {
            "resourceType": "Encounter", "status": "finished", "id": "e", "subject": {"reference": "Patient/1"},
            "location": [{"location": {"reference": "Location/l/1"}}], "period": {"start": "2024"},
            "serviceProvider": {"display": "U"},
        }
    ]
    row = export.rows_to_resources(mvt, "mvt").first()
    assert (row.patient_id, row.stay_id, row.location_id, row.ord) == ("1", "e", "l", 1)


def test_nulls_create_nothing_and_later_columns_win(spark):
    biol = table(
        spark, "biol",
        {"ELTID": "1", "PNAME": "a", "ANAME": None, "MINREF": None, "MAXREF": "9"},
        {"ELTID": "2", "PNAME": "a", "ANAME": "b", "MINREF": None, "MAXREF": None},
    )
    assert built(export.rows_to_resources(biol, "biol")) == [
        {"resourceType": "Observation", "status": "final", "id": "1", "code": {"text": "a"}, "referenceRange": [{"high": {"value": "9"}}]},
        {"resourceType": "Observation", "status": "final", "id": "2", "code": {"text": "b"}},
    ]


def test_rows_without_an_id_get_a_hash(spark):
    biol = table(spark, "biol", {"ELTID": None, "PNAME": "a"}, {"ELTID": "Location/", "PNAME": "b"})
    text = "Observation|" + "|".join("a" if c == "PNAME" else "" for c in model.TABLES["biol"])
    found = {r.id for r in export.rows_to_resources(biol, "biol").collect()}
    assert found == {hashlib.sha1(text.encode()).hexdigest(), hashlib.sha1(b"Location/").hexdigest()}


def test_every_type_of_a_table(spark):
    pmsi = table(spark, "pmsi", {"PATID": "1", "ELTID": "x", "DALL": "d", "ACTES": "t"})
    assert [(r["resourceType"], r["code"]) for r in built(export.rows_to_resources(pmsi, "pmsi"))] == [
        ("Condition", {"text": "d"}), ("Procedure", {"text": "t"}),
    ]
    only = export.rows_to_resources(pmsi, "pmsi", types=["Procedure"])
    assert [r.type for r in only.collect()] == ["Procedure"]


def test_patient_gender(spark):
    patient = spark.createDataFrame([("1", None, 3, "M"), ("2", "1980", None, None)], model.table_schema("patient"))
    assert built(export.rows_to_resources(patient, "patient")) == [
        {"resourceType": "Patient", "id": "1", "gender": "male"}, {"resourceType": "Patient", "id": "2", "birthDate": "1980"},
    ]


@pytest.mark.parametrize(
    "values,expected",
    [
        ({"a": "1"}, {"x": [{"p": "1"}]}),
        ({"b": "2"}, {"x": [{}, {"q": {"r": "2"}}]}),
        ({"a": "1", "c": "3"}, {"x": [{"p": "1"}], "y": [None, None, "3"]}),
        ({"d": "4"}, {"z": [[], ["4"]]}),
        ({}, {}),
    ],
)
def test_set_paths_with_indexes(spark, values, expected):
    leaves = [("x[0].p", "a"), ("x[1].q.r", "b"), ("y[2]", "c"), ("z[1][0]", "d")]
    row = tuple(values.get(k) for k in "abcd")
    df = spark.createDataFrame([row], "a string, b string, c string, d string")
    text = df.select(F.expr(f"to_json({export.set_paths(leaves, {'k': chr(39)})})").alias("j")).first().j
    assert json.loads(text) == {"k": "'", **expected}


@pytest.fixture
def dataset(spark):
    return {
        "patient": spark.createDataFrame([("1", None, None, "F"), ("2", None, None, "M")], model.table_schema("patient")),
        "mvt": table(
            spark, "mvt", {"PATID": "1", "EVTID": "e1", "ELTID": "l1"}, {"PATID": "1", "EVTID": "e2", "ELTID": "l1"},
            {"PATID": None, "EVTID": "e3", "ELTID": "l9"}, {"PATID": "1", "EVTID": "e1", "ELTID": "l1"},
        ),
        "biol": table(spark, "biol", *[{"PATID": "1", "EVTID": "e1", "ELTID": f"o{i:03d}"} for i in range(120)]),
    }


def documents(lines):
    """The documents that the lines are, put together in their order."""
    found = {}
    for r in lines.orderBy("bundle_id", "ord", "id", F.expr("array_position(array('head', 'entry', 'tail'), kind)")).collect():
        found[r.bundle_id] = found.get(r.bundle_id, "") + r.value
    return {k: json.loads(v) for k, v in found.items()}


def entries(lines):
    return {k: [e["request"]["url"] for e in d["entry"]] for k, d in documents(lines).items()}


def test_bundle_of_a_patient(spark, dataset):
    found = documents(exporting.dataset_bundles(dataset))
    assert set(found) == {"patient-1", "patient-2"}
    one = [e["request"]["url"] for e in found["patient-1"]["entry"]]
    assert one[:4] == ["Location/l1", "Patient/1", "Encounter/e1", "Encounter/e2"] and len(one) == 124
    assert found["patient-2"] == {
        "resourceType": "Bundle", "type": "transaction", "id": "patient-2",
        "entry": [{"resource": {"resourceType": "Patient", "id": "2", "gender": "male"}, "request": {"method": "PUT", "url": "Patient/2"}}],
    }


def test_bundle_of_a_stay(dataset):
    found = entries(exporting.dataset_bundles(dataset, "encounter"))
    assert {k: len(v) for k, v in found.items()} == {"encounter-e1": 122, "encounter-e2": 2, "encounter-e3": 2}
    with pytest.raises(ValueError):
        exporting.dataset_bundles(dataset, "other")


def test_values_and_json_give_the_same_documents(dataset):
    from_json = export.bundle_by_patient(export.dataset_to_resources(dataset))
    assert documents(from_json) == documents(exporting.dataset_bundles(dataset))


@pytest.mark.parametrize("copies", [1, 10**9])
def test_copies_are_one_entry(spark, dataset, monkeypatch, copies):
    monkeypatch.setattr(export, "MANY_COPIES", copies)
    many = dict(dataset, biol=dataset["biol"].filter("ELTID = 'o000'").crossJoin(spark.range(500)).drop("id"))
    assert {k: len(v) for k, v in entries(exporting.dataset_bundles(many)).items()} == {"patient-1": 5, "patient-2": 1}


def test_a_bundle_goes_on_in_the_next_file(spark, dataset, tmp_path):
    """A bundle of a million entries, most of all records, is written by several tasks; files in order are the documents."""
    rows = spark.range(1_000_000).select(F.lit("1").alias("PATID"), F.format_string("o%07d", "id").alias("ELTID"))
    big = dict(dataset, biol=extract.enforce_schema(rows, "biol"))
    out = tmp_path / "out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bundles.write_bundles(exporting.dataset_bundles(big), str(out))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(out.glob("part-*"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) < 2 * sum(f.stat().st_size for f in files) / len(files)
    text = "".join(f.read_text() for f in files)
    one, two = [d for d in text.split("]}\n") if d]
    assert json.loads(two + "]}")["id"] == "patient-2"
    first = json.loads(one + "]}")
    urls = [e["request"]["url"] for e in first["entry"]]
    assert len(urls) == 1_000_004 and urls[4:] == sorted(urls[4:]) and len(set(urls)) == len(urls)
    read = bundles.read_bundles(spark, str(out))
    assert {r.bundle_id: r.n_entries for r in export.entry_counts(read).collect()} == {"patient-1": 1_000_004, "patient-2": 1}


def test_written_lines_are_imported_again(spark, dataset, tmp_path):
    out = str(tmp_path / "out")
    bundles.write_bundles(exporting.dataset_bundles(dataset), out)
    read = bundles.scan_bundles(spark, out, per_line=True, pattern="*.txt")
    assert {r.status for r in bundles.scan_counts(read).collect()} == {"ok"}
    types = extract.bundle_entries(read).groupBy("resource_type").count().collect()
    assert {r.resource_type: r["count"] for r in types} == {"Location": 1, "Patient": 2, "Encounter": 2, "Observation": 120}


def test_a_location_among_the_records_needs_no_stub(spark):
    columns = "patient_id string, stay_id string, ord int, type string, id string, location_id string, resource string"
    rows = spark.createDataFrame([
        ("1", None, 1, "Encounter", "e", "l", '{"id":"e"}'), ("1", None, 7, "Location", "l", None, '{"id":"l"}'),
        ("2", None, 1, "Encounter", "f", "l", '{"id":"f"}'),
    ], columns)
    assert entries(export.bundle_by_patient(rows)) == {"patient-1": ["Encounter/e", "Location/l"], "patient-2": ["Location/l", "Encounter/f"]}


def test_a_real_location_replaces_the_stub(spark):
    rows = spark.createDataFrame(
        [("b", -1, "Location", "l", "stub"), ("b", 5, "Location", "l", "real"), ("b", 2, "X", "l", "1"), ("b", 2, "X", "l", "2"), ("b", 1, "X", "", "3")],
        "bundle_id string, ord int, type string, id string, resource string",
    )
    kept = export.dedupe_resources(export.with_id(rows))
    assert {(r.type, r.resource) for r in kept.collect()} == {("Location", "real"), ("X", "1")}


def test_summary_counts_before_copies_are_dropped(dataset):
    found = {r.item: r.n for r in export.export_summary(export.dataset_to_resources(dataset)).collect()}
    assert found == {"Patient": 2, "Encounter": 4, "Observation": 120, "Bundle": 2}


def test_size_stats(spark):
    sizes = export.bundle_size_stats(spark.createDataFrame([("é",), ("abc",), ("ab",)], "value string")).first()
    assert tuple(sizes) == (3, 7, 2, 2, 3)
    assert tuple(export.bundle_size_stats(spark.createDataFrame([], "value string")).first()) == (0, 0, 0, 0, 0)


def test_first_copy_is_found_before_the_shuffle(dataset):
    members = export.bundle_members(export.dataset_to_resources(dataset))
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") != plan.rindex("WindowGroupLimit")
