"""Extraction, enrichment, merge and filters on small hand-written tables."""

import json

import pytest
from pyspark.sql import functions as F

from wardlake import model
from wardlake.operators import enrich, extract, merge
from wardlake.operators import filters as flt
from wardlake.operators.filters import Propagate, Where


def resources(spark, *items):
    rows = [(i["resourceType"], json.dumps(i)) for i in items]
    return spark.createDataFrame(rows, "resource_type string, resource string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_bundle_entries_skip_what_has_no_resource(spark):
    docs = [
        '{"entry":[{"resource":{"resourceType":"A","x":1.50}},{"request":{}},{"resource":null},{"resource":{"x":1}}]}',
        '{"resourceType":"Bundle"}', '{"entry":[]}', '{"entry":{"resource":1}', "", "[1]",
    ]
    found = extract.bundle_entries(spark.createDataFrame([(d,) for d in docs], "value string"))
    assert rows(found) == [(None, '{"x":1}'), ("A", '{"resourceType":"A","x":1.5}')]


def test_repeated_keys_keep_the_last(spark):
    docs = spark.createDataFrame([('{"entry":[{"resource":{"resourceType":"Patient","id":"1","id":"2"}}]}',)], "value string")
    assert rows(extract.extract_type(extract.bundle_entries(docs), "Patient").select("PATID")) == [("2",)]


def test_extract_handles_wrong_containers(spark):
    found = extract.extract_type(
        resources(
            spark,
            {"resourceType": "Observation", "id": "1", "subject": {"reference": "Patient/9"}, "code": {"coding": []}},
            {"resourceType": "Observation", "id": "2", "subject": "Patient/9", "code": {"coding": {"code": "c"}, "text": "t"}},
            {"resourceType": "Observation", "id": "3", "valueQuantity": {"value": 17.0, "unit": {"a": [1, "Patient/2"]}}},
            {"resourceType": "Observation", "id": "4", "code": {"text": True}, "referenceRange": [{"low": {"value": 3}}]},
            {"resourceType": "Patient", "id": "5"},
        ),
        "Observation",
    ).select("ELTID", "PATID", "LOINC", "PNAME", "RESULT", "UNIT", "MINREF")
    assert rows(found) == [
        ("1", "9", None, None, None, None, None),
        ("2", None, None, "t", None, None, None),
        ("3", None, None, None, "17.0", '{"a":[1,"Patient/2"]}', None),
        ("4", None, None, "true", None, None, "3"),
    ]


def test_tables_have_declared_columns(spark):
    data = resources(spark, {"resourceType": "Condition", "id": "c"}, {"resourceType": "Procedure", "id": "p"})
    table = extract.extract_table(data, "pmsi")
    assert table.schema.simpleString() == model.table_schema("pmsi").simpleString()
    assert rows(table.select("ELTID")) == [("c",), ("p",)]
    assert model.expected_columns(model.MAPPING)["patient"] == ["PATID", "PATBD", "PATSEX"]
    assert model.expected_columns(model.MAPPING, model.TABLES) is model.TABLES
    assert extract.enforce_schema(table, "unknown") is table


def test_custom_mapping_can_add_types_and_indexes(spark):
    mapping = {"Device": {"table": "patient", "columns": {"PATID": "udi[1].code", "PATSEX": ""}}}
    found = extract.extract_table(
        resources(spark, {"resourceType": "Device", "udi": [{}, {"code": "Patient/x"}]}), "patient", mapping
    )
    assert rows(found) == [("x", None, None, "I")]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("1", "1980-01-01", 44, "F"), ("2", None, None, "M")], model.table_schema("patient"))


def stay(spark, *items):
    return extract.enforce_schema(spark.createDataFrame(items, "PATID string, EVTID string, SEJUM string, DATSORT string"), "mvt")


def test_enrichment_order_and_nulls(spark, people):
    mvt = enrich.enrich_patient_mvt(stay(spark, ("1", "e1", "U1", "2024-01-09"), ("2", "e2", "U2", None)), people)
    facts = extract.enforce_schema(
        spark.createDataFrame(
            [("1", "e1", "a", "2024-01-01"), (None, "e1", "b", None), ("9", "e2", "c", "2024-01-01"), (None, None, "d", None), ("2", "e1", "e", None)],
            "PATID string, EVTID string, ELTID string, DATENT string",
        ),
        "pmsi",
    )
    found = enrich.enrich_table(facts, "pmsi", people, mvt)
    assert found.schema.simpleString() == model.table_schema("pmsi").simpleString()
    assert rows(found.select("ELTID", "PATID", "PATBD", "PATAGE", "PATSEX", "SEJUM", "SEJDUR")) == [
        ("a", "1", "1980-01-01", "44", "F", "U1", 8),
        ("b", "1", None, "44", "F", "U1", 0),  # patient, age and sex come with the stay; the birth date does not
        ("c", "9", None, None, "M", "U2", 0),  # unknown patient: existing id stays, the rest comes from the stay
        ("d", None, None, None, None, None, 0),
        ("e", "2", None, "44", "M", "U1", 0),
    ]


def test_repeated_patients_multiply_unless_unique(spark, people):
    twice = people.unionByName(people.withColumn("PATSEX", F.lit("X")))
    mvt = stay(spark, ("1", "e1", "U", None))
    assert enrich.enrich_patient_mvt(mvt, twice).count() == 2
    assert rows(enrich.enrich_patient_mvt(mvt, twice, unique=True).select("EVTID", "PATSEX")) == [("e1", "F")]


def test_coalesce_fill_needs_both(spark):
    df = spark.createDataFrame([(None, "x"), ("a", "y")], "t string, s string")
    assert rows(enrich.coalesce_fill(df, "t", "s")) == [("a",), ("x",)]
    assert enrich.coalesce_fill(df, "t", "none") is df


KEYED = "EVTID string, PNAME string, n int"


def test_merge_keeps_copies_of_a_batch_and_nulls(spark):
    base = spark.createDataFrame([("e1", "a", 1), ("e1", "a", 2), (None, "b", 3)], KEYED)
    incoming = spark.createDataFrame([("e1", "a", 4), ("e2", "a", 5), ("e2", "a", 6), (None, "b", 7), ("", "b", 8), (None, "c", 9)], KEYED)
    merged = merge.merge_insert_only(base, incoming, ["EVTID", "PNAME"])
    assert rows(merged, "n") == [
        ("e1", "a", 1), ("e1", "a", 2), (None, "b", 3), ("e2", "a", 5), ("e2", "a", 6), (None, "c", 9),
    ]
    assert merge.merge_insert_only(None, incoming, ["EVTID"]).count() == 6
    assert merge.merge_insert_only(base, incoming, []).count() == 9
    # the same batch again adds nothing
    assert merge.new_rows(merged, incoming, ["EVTID", "PNAME"]).count() == 0


def test_safe_concat(spark):
    first = spark.createDataFrame([(1, "x")], "a int, b string")
    second = spark.createDataFrame([("y", 2.5)], "b string, c double").withColumn("a", F.lit("z"))
    both = merge.safe_concat(first, second)
    assert both.columns == ["a", "b", "c"]
    assert rows(both) == [("1", "x", None), ("z", "y", 2.5)]
    assert merge.safe_concat(None, first) is first and merge.safe_concat(first, None) is first


def test_delete_by_id(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "id string")
    assert rows(merge.delete_by_id(df, ["1"], "id")) == [(None,), ("2",)]
    assert rows(merge.delete_by_id(df, spark.createDataFrame([("2",), (None,)], "x string"), "id")) == [(None,), ("1",)]


@pytest.fixture
def dataset(spark):
    return {
        "patient": spark.createDataFrame([("1", 60, "F"), ("2", 40, "M"), (None, 70, "F")], "PATID string, PATAGE int, PATSEX string"),
        "mvt": spark.createDataFrame([("1", "e1", "10"), ("2", "e2", "9.5"), (None, "e3", "x"), ("3", None, None)], "PATID string, EVTID string, V string"),
        "note": spark.createDataFrame([("e1", "a.b"), ("e2", "axb"), (None, "c")], "EVTID string, T string"),
    }


@pytest.mark.parametrize(
    "op,value,expected",
    [
        ("==", 10, ["e1"]), ("!=", 10, ["e2"]), ("<", 9.6, ["e2"]), (">=", 9.5, ["e1", "e2"]), ("<=", "10", ["e1"]),
        (">", "10", ["e2", "e3"]), ("in", ("x", 10), ["e1", "e3"]), ("in", "9.5", ["e2"]), ("between", (9, 11), ["e1", "e2"]),
        ("between", ("1", "2"), ["e1"]), ("is_null", None, [None]), ("not_null", None, ["e1", "e2", "e3"]),
        ("contains", ".", ["e2"]), ("regex", "/^[0-9]+$/", ["e1"]), ("regex", ".", ["e1", "e2", "e3"]),
    ],
)
def test_where(spark, dataset, op, value, expected):
    found = flt.where(dataset["mvt"], Where("mvt", "V", op, value))
    assert [r.EVTID for r in found.orderBy("EVTID").collect()] == expected


def test_where_on_numbers_and_absent_columns(dataset):
    patient = dataset["patient"]
    assert flt.where(patient, Where("*", "PATAGE", ">", 50)).count() == 2
    assert flt.where(patient, Where("*", "PATAGE", "==", "60")).count() == 1
    assert flt.where(patient, Where("*", "NONE", "==", 1)) is patient
    with pytest.raises(ValueError):
        flt.where(patient, Where("*", "PATAGE", "like", 1))


def test_where_in_file(spark, dataset, tmp_path):
    listed = tmp_path / "ids.txt"
    listed.write_text(" e1 \n\n\te3\n e1\n")
    found = flt.where(dataset["mvt"], Where("mvt", "EVTID", "in_file", str(listed)))
    assert rows(found.select("EVTID")) == [("e1",), ("e3",)]


def test_patterns(dataset):
    assert list(flt.select_tables(dataset, "/^m|e$/")) == ["mvt", "note"]
    assert list(flt.select_tables(dataset, only=["note", "patient"], exclude=["note"])) == ["patient"]
    assert [flt.table_matches(p, "mvt") for p in ("", None, "*", "mvt", "MVT", "/x/")] == [True, True, True, True, False, False]


def test_propagation(spark, dataset):
    kept = flt.filter_dataset(
        dataset, [Where("patient", "PATAGE", ">", 50)], [Propagate("PATID", "patient"), Propagate("EVTID", "mvt")]
    )
    assert rows(kept["patient"].select("PATID")) == [("1",)]  # the key filter drops the row without a key
    assert rows(kept["mvt"].select("EVTID")) == [("e1",)]
    assert rows(kept["note"].select("EVTID")) == [("e1",), ("e2",)]  # keys of mvt after its own clauses only
    with_nulls = flt.filter_dataset(dataset, [Where("patient", "PATAGE", ">", 50)], [Propagate("PATID", "patient")], keep_nulls=True)
    assert rows(with_nulls["mvt"].select("EVTID")) == [("e1",), ("e3",)]
    nothing = flt.filter_dataset(dataset, [], [Propagate("EVTID", "patient"), Propagate("X")])
    assert {t: df.count() for t, df in nothing.items()} == {"mvt": 4, "note": 3, "patient": 3}


def test_same_key_twice_means_both(dataset):
    kept = flt.filter_dataset(dataset, [Where("patient", "PATSEX", "==", "F")], [Propagate("PATID", "mvt"), Propagate("PATID", "patient")])
    assert rows(kept["mvt"].select("PATID")) == [("1",)]
