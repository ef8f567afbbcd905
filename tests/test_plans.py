"""What the plans of the operators must and must not contain."""

import pytest

from wardlake.operators import export, extract
from wardlake.operators import filters as flt
from wardlake.operators.filters import Where
from wardlake.plans import exporting, importing
from wardlake.sources import tables as store
from wardlake.workload import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    for name, df in fx.dataset(spark, SMALL, "mvt", "pmsi").items():
        store.write_table(df, folder, name)
    return store.scan_dataset(spark, folder)


def test_clauses_reach_the_scan_and_columns_are_pruned(stored):
    kept = flt.where_all(stored["mvt"], "mvt", [Where("mvt", "SEJUM", "==", "5-LOW"), Where("mvt", "DATSORT", "not_null")])
    plan = physical(kept.select("EVTID"))
    assert "EqualTo(SEJUM,5-LOW)" in plan and "IsNotNull(DATSORT)" in plan
    assert "ReadSchema: struct<EVTID:string,DATSORT:string,SEJUM:string>" in plan


def test_ids_of_records_do_not_need_the_records(stored):
    resources = export.rows_to_resources(stored["pmsi"], "pmsi")
    plan = optimized(resources.groupBy("patient_id").count())
    assert "to_json" not in plan.lower() and "StructsToJson" not in plan
    assert optimized(resources).count("Relation") == 1


def test_the_records_of_bundles_are_shuffled_once(stored):
    """By ranges that the windows behind them need no other exchange for; no group is collected."""
    plan = physical(exporting.dataset_bundles({"pmsi": stored["pmsi"]}))
    assert plan.count("Exchange rangepartitioning") == 1
    assert "collect_list" not in plan
    below = plan[plan.index("Exchange rangepartitioning"):]
    above = plan[: plan.index("Exchange rangepartitioning")]
    assert "Exchange" not in above and "to_json" not in below.replace("to_json(struct(resourceType, Location", "")


def test_staged_types_are_partitions(spark, tmp_path):
    staged = importing.stage_resources(fx.resources(spark, SMALL, "Condition", "Procedure"), str(tmp_path / "s"))
    plan = physical(extract.extract_type(staged, "Condition"))
    assert "PartitionFilters: [isnotnull(resource_type" in plan


def test_each_record_is_parsed_once(stored, spark, tmp_path):
    staged = importing.stage_resources(fx.resources(spark, SMALL, "Condition"), str(tmp_path / "s"))
    rows = extract.extract_table(staged, "pmsi").filter("PATID IS NOT NULL AND EVTID = 'e1'")
    assert optimized(rows).count("from_json") == 1 + optimized(extract.extract_type(staged, "Procedure")).count("from_json")
