"""Scalar rules on hand-written edge cases."""

import base64
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.functions import ids, records, values


def apply(spark, inputs, fn, dtype="string"):
    """Results of a Column function over a list of inputs, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {dtype}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_ids(spark):
    raw = ["urn:uuid:a-1", "urn:oid:1.2", "Patient/7", "é_x/7", "sys|x|y", "a/b/c", "plain", "x-y/7", "", None]
    assert apply(spark, raw, ids.clean_ids) == ["a-1", "1.2", "7", "7", "y", "b/c", "plain", "x-y/7", "", None]


def test_strip_ref_prefix_is_everywhere_and_in_order(spark):
    raw = ["Patient/1", "see Encounter/2 and Location/3", "urn:uuid:Patient/4", "Patiurn:uuid:ent/5", "Observation/6", None]
    assert apply(spark, raw, ids.strip_ref_prefix) == ["1", "see 2 and 3", "4", "5", "Observation/6", None]


def test_clean_id_takes_one_leading_prefix(spark):
    raw = ["Patient/Patient/1", "Observation/2", "Practitioner/3", "urn:uuid:4", "x Patient/5", "", None]
    assert apply(spark, raw, ids.clean_id) == ["Patient/1", "2", "Practitioner/3", "4", "x Patient/5", "", ""]


def test_normalize_fhir_id(spark):
    raw = ["http://s|Patient/9", "Patient?identifier=a|b=c", "q?x", "a=b=c", "x" * 70, None, "Location/"]
    assert apply(spark, raw, ids.normalize_fhir_id) == ["9", "c", "q?x", "c", "x" * 64, "", ""]


def test_stable_and_fallback_id(spark):
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert apply(spark, ["é", None], lambda c: ids.stable_id(F.lit("T"), c)) == [sha("T|é"), sha("T|")]
    got = apply(spark, ["Patient/", "a", None, ""], lambda c: ids.fallback_id(c, F.lit("T"), c))
    assert got == [sha("Patient/"), "a", sha("T|"), sha("")]


def test_patient_of_reference(spark):
    refs = ["Patient/1", "Patient/a/b", "nothing", "", None]
    assert apply(spark, refs, ids.patient_of_reference) == ["1", "a/b", None, None, None]
    assert apply(spark, ["", None, "Patient/1"], lambda c: ids.patient_of_reference(c, F.lit("Patient/2"))) == ["2", "2", "1"]


def test_sex_codes(spark):
    assert apply(spark, ["male", "female", "other", "unknown", "Male", "", None], values.normalize_sex) == list("MFIIIII")
    got = apply(spark, ["M", " f\t", "I", "", None], values.gender_out)
    assert got == ["male", "female", "unknown", "unknown", "unknown"]


def test_compute_age(spark):
    births = ["1980-06-15", "1980-06-16", "1980-06-15T23:00:00+01:00", "1980", "1980-05", "1980-02-30", "2025-01-01", "", None]
    got = apply(spark, births, lambda c: values.compute_age(c, "2024-06-15T10:00:00"))
    assert got == [44, 43, 44, None, None, None, -1, None, None]
    today = dt.date.today()
    assert apply(spark, [f"{today.year - 3}-01-01"], values.compute_age) == [3]


def test_stay_duration(spark):
    start = "2024-01-01T10:00:00+01:00"
    ends = ["2024-01-03T09:59:59-05:00", "2024-01-03T10:00:00Z", "2023-12-31T11:00:00", "2024-01-05", "never", "2024-13-01", None]
    assert apply(spark, ends, lambda c: values.stay_duration(F.lit(start), c)) == [1, 2, 0, 3, 0, 0, 0]


def test_stay_duration_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        got = apply(spark, ["2024-03-31T12:00:00"], lambda c: values.stay_duration(F.lit("2024-03-30T12:00:00"), c))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1]


def test_fhir_date(spark):
    assert apply(spark, ["", "2024", None], values.fhir_date) == [None, "2024", None]
    stamps = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60), None]
    got = apply(spark, stamps, lambda c: values.fhir_date(c, T.TimestampType()), "timestamp")
    assert got == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.000060", None]


def test_encode_base64_has_no_line_breaks(spark):
    text = "é" * 200
    assert apply(spark, [text, "", None], values.encode_base64) == [base64.b64encode(text.encode()).decode(), "", None]


def test_xhtml_div(spark):
    raw = ["  hi\n", "<DIV>x</DIV>", "\t<div class='a'>", None]
    assert apply(spark, raw, values.xhtml_div) == [
        '<div xmlns="http://www.w3.org/1999/xhtml">hi</div>', "<DIV>x</DIV>", "<div class='a'>", None,
    ]


def test_clip_cell(spark):
    assert apply(spark, ["abcdef", "abc", "a\nb\rc", None], lambda c: values.clip_cell(c, 5)) == ["abcd…", "abc", "a b c", ""]
    assert apply(spark, ["a" * 99], lambda c: values.clip_cell(c, 0)) == ["a" * 99]


def test_default_unit(spark):
    assert apply(spark, ["A", None, ""], values.default_unit) == ["A", "Hôpital Indéterminé", ""]


@pytest.mark.parametrize(
    "dtype,target,inputs,expected",
    [
        ("string", "bigint", [" 12 ", "1.5", "x", "", None], [12, None, None, None, None]),
        ("double", "bigint", [1.9, -1.9, None], [1, -1, None]),
        ("string", "double", ["1.5", "x"], [1.5, None]),
        ("string", "boolean", ["false", ""], [True, False]),
        ("array<string>", "string", [["a", "b"], [], None], ["a", None, None]),
        ("struct<k:string>", "string", [("é",), None], ['{"k":"é"}', None]),
        ("array<struct<k:int>>", "string", [[(1,), (2,)]], ['{"k":1}']),
    ],
)
def test_normalize_typed(spark, dtype, target, inputs, expected):
    kind = spark.createDataFrame([], f"v {dtype}").schema["v"].dataType
    assert apply(spark, inputs, lambda c: values.normalize_typed(c, kind, target), dtype) == expected


def test_path_steps_and_schema():
    assert records.path_steps("a.b[0].c") == ["a", "b", 0, "c"]
    schema = records.pruned_schema(["a.b[0].c", "a.b[1].d", "e"])
    assert schema.simpleString() == "struct<a:struct<b:array<struct<c:string,d:string>>>,e:string>"


def test_json_path(spark):
    raw = ['{"a":{"b":[{"c":1},{"c":"x"}]}}', '{"a":[]}', '{"a":{"b":{"c":1}}}', "no json", None]
    assert apply(spark, raw, lambda c: records.json_path(c, "a.b[1].c")) == ["x", None, None, None, None]
    assert apply(spark, raw[:1], lambda c: records.json_path(c, "")) == [None]
    assert apply(spark, ['{"resourceType":"T"}'], lambda c: records.json_path(c, "resourceType")) == ["T"]


def test_coding_by_system(spark):
    codings = [[("s1", "a"), ("s2", "b"), ("s2", "c")], [("s1", "a")], [], None, [("s2", None), ("s2", "d")]]
    got = apply(spark, codings, lambda c: records.coding_by_system(c, "s2"), "array<struct<system:string,code:string>>")
    assert got == ["b", None, None, None, None]


def test_patient_display(spark):
    shape = "struct<id:string,birthDate:string,gender:string,name:array<struct<family:string,given:array<string>>>>"
    df = spark.createDataFrame(
        [(("1", "1980", "male", [("Doe", ["A", "B"])]),), ((None, None, None, [("Roe", None)]),), (("3", None, None, []),)],
        f"p {shape}",
    )
    assert [tuple(r) for r in df.select(*records.patient_display(F.col("p"))).collect()] == [
        ("1", "Doe", "A B", "1980", "male"), ("?", "Roe", "N/A", "N/A", "N/A"), ("3", "N/A", "N/A", "N/A", "N/A"),
    ]
