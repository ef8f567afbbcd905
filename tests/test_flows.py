"""Sources, whole flows, run log and streams on files."""

import datetime as dt
import json

import pytest

from wardlake import model
from wardlake.operators.filters import Propagate, Where
from wardlake.plans import exporting, filtering, importing, reporting
from wardlake.sources import bundles as docs
from wardlake.sources import runs
from wardlake.sources import tables as store
from wardlake.streaming import arrivals


def bundle(*resources):
    return json.dumps({"resourceType": "Bundle", "entry": [{"resource": r} for r in resources]}, indent=1)


def patient(i, gender="male"):
    return {"resourceType": "Patient", "id": f"p{i}", "gender": gender, "birthDate": "1980-01-01"}


def encounter(i, p):
    return {"resourceType": "Encounter", "id": f"urn:uuid:e{i}", "subject": {"reference": f"Patient/p{p}"}, "period": {"start": "2024-01-01", "end": "2024-01-05"}}


def condition(i, e):
    return {"resourceType": "Condition", "id": f"c{i}", "encounter": {"reference": f"Encounter/e{e}"}, "code": {"text": "flu"}}


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(bundle(patient(1), encounter(1, 1), condition(1, 1), {"resourceType": "Device", "id": "d"}))
    (folder / "b.json").write_text('{"resourceType": "Bundle"}')
    (folder / "c.json").write_text("{broken")
    (folder / "d.json").write_text('{"resourceType":"Bundle","resourceType":"Bundle","entry":[]}')
    (folder / "e.txt").write_text(bundle(patient(8)))
    (folder / "sub").mkdir()
    (folder / "sub" / "f.json").write_text(bundle(patient(9)))
    return folder


def test_scan_and_warnings(spark, landing):
    found = docs.scan_bundles(spark, str(landing))
    assert {r.file: r.status for r in docs.scan_warnings(found).collect()} == {
        "a.json": "ok", "b.json": "no_entry", "c.json": "malformed", "d.json": "ok",
    }
    assert {r.status: r.documents for r in docs.scan_counts(found).collect()} == {"ok": 2, "no_entry": 1, "malformed": 1}


def test_import_then_again(spark, landing, tmp_path):
    out = str(tmp_path / "data")
    report = importing.import_bundles(docs.scan_bundles(spark, str(landing)), out, as_of="2024-06-15")
    assert [tuple(r) for r in report.collect()] == [
        ("biol", 0, 0, 0, 0), ("doceds", 0, 0, 0, 0), ("mvt", 0, 1, 1, 1), ("patient", 0, 1, 1, 1), ("pharma", 0, 0, 0, 0), ("pmsi", 0, 1, 1, 1),
    ]
    assert store.list_tables(spark, out) == ["mvt", "patient", "pmsi"]
    assert store.scan_table(spark, out, "biol") is None
    row = store.scan_table(spark, out, "pmsi").first()
    assert (row.PATID, row.EVTID, row.PATAGE, row.PATSEX, row.SEJDUR, row.DATSORT) == ("p1", "e1", "44", "M", 4, "2024-01-05")
    (landing / "g.json").write_text(bundle(patient(2, "female"), encounter(1, 2), condition(2, 1)))
    report = importing.import_bundles(docs.scan_bundles(spark, str(landing)), out)
    assert {r.table: (r.before_rows, r.incoming_rows, r.added_rows) for r in report.collect() if r.incoming_rows} == {
        "mvt": (1, 2, 0), "patient": (1, 2, 1), "pmsi": (1, 4, 2),
    }
    report = importing.import_bundles(docs.scan_bundles(spark, str(landing)), out, reset=True)
    assert {r.table: r.after_rows for r in report.collect() if r.incoming_rows} == {"mvt": 2, "patient": 2, "pmsi": 4}


def test_write_table_replaces_and_copies(spark, tmp_path):
    out, copy = str(tmp_path / "d"), str(tmp_path / "copy")
    assert store.write_table(spark.range(5), out, "t", copy)
    again = store.scan_table(spark, out, "t").filter("id > 2")
    assert store.write_table(again, out, "t.parquet")
    assert sorted(r.id for r in store.scan_table(spark, out, "t").collect()) == [3, 4]
    assert store.scan_table(spark, copy, "t").count() == 5
    assert not store.write_table(spark.range(0), out, "empty")
    assert store.list_tables(spark, out) == ["t"] and store.list_tables(spark, out, hidden=("t",)) == []


def test_filter_folder(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    store.write_table(spark.createDataFrame([("1", 60), ("2", 40)], "PATID string, PATAGE int"), source, "patient")
    store.write_table(spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c")], "PATID string, EVTID string"), source, "mvt")
    rules = dict(clauses=[Where("patient", "PATAGE", ">", 50)], propagate=[Propagate("PATID", "patient")])
    want = [("mvt", 3, 1, -2, -66.7), ("patient", 2, 1, -1, -50.0)]
    assert [tuple(r) for r in filtering.filter_folder(spark, source, None, **rules).collect()] == want
    assert store.list_tables(spark, out) == []
    assert [tuple(r) for r in filtering.filter_folder(spark, source, out, **rules).collect()] == want
    none = filtering.filter_folder(spark, source, str(tmp_path / "n"), [Where("*", "PATID", "==", "x")])
    assert [r.delta_pct for r in none.collect()] == [-100.0, -100.0]


def test_export_folder(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    store.write_table(spark.createDataFrame([("1", None, 3, "F"), ("2", None, 3, "F")], model.table_schema("patient")), source, "patient")
    summary = exporting.export_folder(spark, source, out)
    assert {r.item: r.n for r in summary.collect()} == {"Patient": 2, "Bundle": 2}
    written = docs.read_bundles(spark, out)
    assert sorted(r.bundle_id for r in written.filter("kind = 'entry'").collect()) == ["patient-1", "patient-2"]


def test_export_summary_lists_empty_tables(spark, tmp_path):
    source = str(tmp_path / "s")
    store.write_table(spark.createDataFrame([("1", None, 3, "F")], model.table_schema("patient")), source, "patient")
    store.write_table(spark.createDataFrame([], model.table_schema("mvt")), source, "mvt", keep_empty=True)
    summary = exporting.export_folder(spark, source, str(tmp_path / "o"))
    assert {r.item: r.n for r in summary.collect()} == {"Patient": 1, "Encounter": 0, "Bundle": 1}


def test_delete_rows(spark, tmp_path):
    folder = str(tmp_path)
    store.write_table(spark.createDataFrame([("e1",), ("e2",), (None,)], "EVTID string"), folder, "mvt")
    assert filtering.delete_rows(spark, folder, "mvt", ["e1", "e9"]) == 2
    assert filtering.delete_rows(spark, folder, "mvt", ["e2"]) == 1
    with pytest.raises(ValueError):
        filtering.delete_rows(spark, folder, "none", ["e1"])


def test_run_logged(spark, tmp_path):
    log = str(tmp_path / "log")
    reporting.run_logged(spark, log, "import", lambda: spark.createDataFrame([("mvt", 3)], "table string, n int"), "r1")
    with pytest.raises(ZeroDivisionError):
        reporting.run_logged(spark, log, "import", lambda: 1 / 0, "r2")
    found = {r.run_id: r for r in spark.read.parquet(log).collect()}
    assert (found["r1"].status, json.loads(found["r1"].summary)) == ("success", [{"table": "mvt", "n": 3}])
    assert (found["r2"].status, found["r2"].errors) == ("failed", ["division by zero"])


def test_paged_bundles_keep_the_order(spark):
    page = lambda *names: bundle(*[{"resourceType": n} for n in names])
    pages = spark.createDataFrame([("r", 2, page("C")), ("r", 1, page("A", "B")), ("q", 1, '{"entry":[{}]}'), ("s", 1, "{}")], "request_id string, page_no int, value string")
    found = docs.paged_bundles(pages).orderBy("request_id", "page_no", "pos").collect()
    assert [(r.request_id, r.page_no, r.pos, r.resource_type) for r in found] == [("r", 1, 0, "A"), ("r", 1, 1, "B"), ("r", 2, 0, "C")]


def test_run_log(spark, tmp_path):
    path, day = str(tmp_path / "runs"), dt.datetime(2024, 1, 1)
    runs.log_run(spark, path, "r1", "import", day, day, "{}")
    runs.log_run(spark, path, "r2", "import", day + dt.timedelta(1), day, "{}", ["e"] * 150)
    runs.log_run(spark, path, "r3", "export", day, day, "{}", status="failed")
    log = spark.read.parquet(path)
    assert [r.run_id for r in runs.run_history(log).collect()] == ["r2", "r3", "r1"]
    last = {r.run_type: r for r in runs.last_runs(log).collect()}
    assert (last["import"].run_id, last["import"].status, len(last["import"].errors), last["import"].n_errors) == ("r2", "partial_success", 150, 150)
    assert last["export"].status == "failed"


def test_stream_import_is_incremental_and_replay_safe(spark, landing, tmp_path):
    out, check = str(tmp_path / "data"), str(tmp_path / "check")

    def run(checkpoint):
        stream = arrivals.stream_import(arrivals.arriving_bundles(spark, str(landing)), out, checkpoint, as_of="2024-06-15")
        assert stream.awaitTermination(300)
        return {t: store.scan_table(spark, out, t).count() for t in store.list_tables(spark, out)}

    assert run(check) == {"mvt": 1, "patient": 1, "pmsi": 1}
    (landing / "h.json").write_text(bundle(patient(3), encounter(3, 3)))
    assert run(check) == {"mvt": 2, "patient": 2, "pmsi": 1}
    assert run(str(tmp_path / "fresh")) == {"mvt": 2, "patient": 2, "pmsi": 1}


def rows_of(spark, out):
    return {t: sorted(map(str, store.scan_table(spark, out, t).collect())) for t in store.list_tables(spark, out)}


@pytest.mark.parametrize("order", [(3, 2, 1, 0), (2, 0, 3, 1)])
def test_the_cut_of_the_arrivals_does_not_matter(spark, tmp_path, order):
    """One file per batch in any order gives the tables of a single import; rows wait for their patient and stay."""
    owned = dict(condition(2, 2), subject={"reference": "Patient/p2"})
    files = [bundle(patient(1), patient(2, "female")), bundle(encounter(1, 1), encounter(2, 2)), bundle(condition(1, 1)), bundle(owned)]
    folder, out, whole = tmp_path / "in", str(tmp_path / "data"), str(tmp_path / "whole")
    folder.mkdir()
    for n in order:
        (folder / f"{n}.json").write_text(files[n])
        stream = arrivals.stream_import(arrivals.arriving_bundles(spark, str(folder)), out, str(tmp_path / "check"), as_of="2024-06-15")
        assert stream.awaitTermination(300)
    importing.import_bundles(docs.scan_bundles(spark, str(folder)), whole, as_of="2024-06-15")
    assert rows_of(spark, out) == rows_of(spark, whole)


def test_rows_that_wait_are_released(spark, tmp_path):
    """What never finds its patient or stay is kept beside the dataset until it is released, then stored as it is."""
    folder, out = tmp_path / "in", str(tmp_path / "data")
    folder.mkdir()

    def run(checkpoint="check", **options):
        stream = arrivals.stream_import(arrivals.arriving_bundles(spark, str(folder)), out, str(tmp_path / checkpoint), as_of="2024-06-15", **options)
        assert stream.awaitTermination(300)

    (folder / "a.json").write_text(bundle(encounter(1, 1), condition(1, 1), condition(9, 9)))
    run()
    assert store.list_tables(spark, out) == []
    (folder / "b.json").write_text(bundle(patient(1)))
    run()
    assert {t: len(r) for t, r in rows_of(spark, out).items()} == {"mvt": 1, "patient": 1, "pmsi": 1}
    assert store.scan_table(spark, out, "pmsi").first().PATAGE == "44"
    report = arrivals.release_waiting(spark, out, as_of="2024-06-15")
    assert {r.table: r.added_rows for r in report.collect() if r.added_rows} == {"pmsi": 1}
    assert {r.EVTID: r.PATAGE for r in store.scan_table(spark, out, "pmsi").collect()} == {"e1": "44", "e9": None}
    (folder / "c.json").write_text(bundle(condition(7, 7)))
    run("other", wait=dt.timedelta(0))  # nobody waits
    assert store.scan_table(spark, out, "pmsi").filter("EVTID = 'e7'").count() == 1


def test_stream_subscription(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    lines = [{"resourceType": "Observation", "id": str(i), "status": s} for i, s in enumerate(["final", "draft", "final"])]
    (folder / "x.txt").write_text("\n".join(json.dumps(x) for x in lines + [{"resourceType": "Task", "status": "final"}]) + "\nnoise")
    out = str(tmp_path / "out")
    stream = arrivals.stream_subscription(
        arrivals.arriving_resources(spark, str(folder)), out, str(tmp_path / "check"), "Observation", "status", "final"
    )
    assert stream.awaitTermination(300)
    assert sorted(json.loads(r.resource)["id"] for r in spark.read.parquet(out).collect()) == ["0", "2"]
    batch = spark.createDataFrame([("Task", "{}"), ("Observation", "{}")], "resource_type string, resource string")
    assert arrivals.matching(batch, "Task").count() == 1
