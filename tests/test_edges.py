"""Cases in which rows or values were once lost, kept or multiplied by mistake."""

import json
import os

from pyspark.sql import functions as F

from wardlake.functions import ids
from wardlake.operators import browse, enrich, export, extract, filters, merge, search
from wardlake.operators.filters import Propagate, Where
from wardlake.plans import filtering, importing
from wardlake.sources import tables as store
from wardlake.streaming import arrivals


def test_keys_come_from_tables_that_are_not_written(spark):
    data = {
        "patient": spark.createDataFrame([("a", 60), ("b", 40)], "PATID string, PATAGE int"),
        "biol": spark.createDataFrame([("a", "x"), ("b", "y")], "PATID string, RESULT string"),
    }
    for options in ({"only": ["biol"]}, {"exclude": ["patient"]}):
        kept = filters.filter_dataset(data, [Where("patient", "PATAGE", ">", 50)], [Propagate("PATID", "patient")], **options)
        assert list(kept) == ["biol"] and [r.PATID for r in kept["biol"].collect()] == ["a"]


def test_text_in_brackets_is_text(spark):
    values = ["[note] see Patient/12", '["Patient/12"]', '{"a":"Patient/1"}', "{x Patient/12", "note see Patient/12"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(extract.extracted_text(F.col("v"))).collect()]
    assert got == ["[note] see 12", '["Patient/12"]', '{"a":"Patient/1"}', "{x 12", "note see 12"]


def test_values_of_another_type_become_null(spark):
    df = spark.createDataFrame([("p", "n/a"), ("q", "7")], "PATID string, PATAGE string")
    got = {r.PATID: r.PATAGE for r in extract.enforce_schema(df, "patient").collect()}
    assert got == {"p": None, "q": 7}


def test_the_fullest_copy_of_a_patient_counts(spark):
    facts = spark.createDataFrame([("p", None, None, None)], "PATID string, PATAGE int, PATSEX string, PATBD string")
    copies = spark.createDataFrame(
        [("p", None, "I", None), ("p", 44, "F", "1980-01-01")], "PATID string, PATAGE int, PATSEX string, PATBD string"
    )
    got = enrich.enrich_patient(facts, copies, unique=True).collect()
    assert [tuple(r) for r in got] == [("p", 44, "F", "1980-01-01")]


def test_a_missing_tombstone_flag_hides_nothing(spark):
    log = spark.createDataFrame([("t", "1", 1, None), ("t", "2", 1, True), ("t", "3", 1, False)], "type string, id string, n int, deleted boolean")
    got = search.delete_resource(log, order=["n"]).collect()
    assert sorted(r.id for r in got) == ["1", "3"]


def test_long_ids_stay_apart_in_the_export(spark):
    long = ["x" * 64 + end for end in ("", "a", "b")]
    df = spark.createDataFrame([(i, "p") for i in long], "ELTID string, PATID string")
    got = [r[0] for r in df.select(ids.record_id(F.col("ELTID"))).collect()]
    assert len(set(got)) == 3 and got[0] == long[0] and max(map(len, got)) == 64
    mapping = {"Observation": {"table": "biol", "columns": {"ELTID": "id", "PATID": "subject.reference"}}}
    members = export.bundle_members(export.rows_to_resources(df, "biol", mapping))
    assert members.count() == 3


def test_a_dry_run_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "data")
    store.write_table(spark.createDataFrame([("a", 1)], "PATID string, PATAGE int"), folder, "patient")
    monkeypatch.setattr(filtering, "scratch", lambda _, name: str(tmp_path / "shared" / name))
    report = filtering.filter_folder(spark, folder, None, [Where("patient", "PATAGE", ">", 5)], [Propagate("PATID", "patient")])
    assert [(r.table, r.input_rows, r.output_rows) for r in report.collect()] == [("patient", 1, 0)]
    assert not (tmp_path / "shared" / "filter").exists()


def test_a_replaced_table_leaves_no_folders(spark, tmp_path):
    folder = str(tmp_path)
    for n in (1, 2):
        store.write_table(spark.range(n), folder, "t")
    assert os.listdir(folder) == ["t.parquet"] and store.scan_table(spark, folder, "t").count() == 2


def test_merges_meet_by_digest(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.createDataFrame([("a", "text"), (None, None)], "k string, RECTXT string")
        rows = [("a", "text"), ("at", "ext"), ("a", None), (None, None), ("", ""), ("b", "text")]
        new = merge.new_rows(base, spark.createDataFrame(rows, "k string, RECTXT string"), ["k", "RECTXT"])
        plan = new._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanges and not any("RECTXT" in line for line in exchanges)
        assert sorted(map(str, (tuple(r) for r in new.collect()))) == ["('a', None)", "('at', 'ext')", "('b', 'text')"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_a_key_are_spread(spark):
    df = spark.range(20_000).select(F.lit(None).cast("string").alias("k"), F.col("id").cast("string").alias("v"))
    salt = merge.spread_salt(F.col("k").isNull(), ["k", "v"])
    sizes = [r["count"] for r in df.groupBy(salt.alias("s")).count().collect()]
    assert len(sizes) == merge.SALTS and max(sizes) < 3 * 20_000 / merge.SALTS
    known = spark.createDataFrame([(None,), ("a",)], "k string")
    assert filters.propagate_semi(df, known, "k", keep_nulls=True).count() == 20_000
    assert filters.propagate_semi(df, known.filter("k = 'a'"), "k", keep_nulls=True).count() == 0
    assert merge.delete_by_id(df, known, "k").count() == 20_000
    assert merge.new_rows(df.limit(1), df, ["k"]).count() == 0 and merge.new_rows(known.filter("k = 'a'"), df, ["k"]).count() == 20_000


def documents():
    patient = {"resourceType": "Patient", "id": "p1", "gender": "female", "birthDate": "1980-01-01"}
    stay = {"resourceType": "Encounter", "id": "e1", "subject": {"reference": "Patient/p1"},
            "period": {"start": "2024-01-01T00:00:00", "end": "2024-01-05T00:00:00"}}
    condition = {"resourceType": "Condition", "id": "c1", "subject": {"reference": "Patient/p1"},
                 "encounter": {"reference": "Encounter/e1"}, "code": {"text": "x"}}
    return [json.dumps({"resourceType": "Bundle", "entry": [{"resource": r}]}) for r in (patient, stay, condition)]


def test_a_stream_of_many_batches_equals_one_batch(spark, tmp_path):
    out = {}
    for name, per_batch in (("one", 1000), ("many", 1)):
        arrival = tmp_path / name / "in"
        arrival.mkdir(parents=True)
        for i, text in enumerate(documents()):
            (arrival / f"{i}.json").write_text(text)
            os.utime(arrival / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        stream = arrivals.arriving_bundles(spark, str(arrival), files_per_batch=per_batch)
        folder, reports = str(tmp_path / name / "data"), str(tmp_path / name / "reports")
        arrivals.stream_import(stream, folder, str(tmp_path / name / "checkpoint"), as_of="2024-06-15", reports=reports).awaitTermination()
        out[name] = {t: [tuple(r) for r in df.collect()] for t, df in store.scan_dataset(spark, folder).items()}
        batches = spark.read.parquet(reports)
        assert batches.select("batch_id").distinct().count() == (1 if name == "one" else 3)
        totals = {r["table"]: r.n_rows for r in browse.incoming_accumulate(batches).collect()}
        assert totals["patient"] == totals["mvt"] == totals["pmsi"] == 1
    assert out["one"] == out["many"]
    [claim] = out["many"]["pmsi"]
    assert {"p1", "e1", "c1", "2024-01-01T00:00:00", "2024-01-05T00:00:00", 4} <= set(claim)


def test_stored_rows_fill_in_where_the_batch_has_none(spark, tmp_path):
    store.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "PATID string, n int"), str(tmp_path), "patient")
    batch = spark.createDataFrame([("a", 9)], "PATID string, n int")
    got = importing.with_stored(batch, str(tmp_path), "patient", "PATID").collect()
    assert sorted(tuple(r) for r in got) == [("a", 9), ("b", 2)]
    assert importing.with_stored(batch, str(tmp_path), "absent", "PATID") is batch


def test_a_first_load_writes_no_second_copy(spark, tmp_path, monkeypatch):
    entry = spark.createDataFrame([("Patient", '{"resourceType":"Patient","id":"p1"}')], "resource_type string, resource string")
    real = store.append_table
    monkeypatch.setattr(store, "append_table", lambda *_: (_ for _ in ()).throw(AssertionError("a copy")))
    first = importing.import_resources(entry, str(tmp_path / "data"), as_of="2024-06-15")
    assert [tuple(r) for r in first.filter("table = 'patient'").collect()] == [("patient", 0, 1, 1, 1)]
    monkeypatch.setattr(store, "append_table", real)
    again = importing.import_resources(entry, str(tmp_path / "data"), as_of="2024-06-15")
    assert [tuple(r) for r in again.filter("table = 'patient'").collect()] == [("patient", 1, 1, 1, 0)]
