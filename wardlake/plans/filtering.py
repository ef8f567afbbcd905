"""Filter a stored dataset into another folder."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.operators import browse, merge
from wardlake.operators.filters import Propagate, Where, filter_dataset
from wardlake.plans.reporting import run_logged
from wardlake.session import scratch, side_by_side, stored
from wardlake.sources import tables as store


def filter_folder(
    spark: SparkSession, input_folder: str, output_folder: str | None, clauses: Iterable[Where] = (),
    propagate: Iterable[Propagate] = (), only: Iterable[str] = (), exclude: Iterable[str] = (),
    keep_nulls: bool = False, copy_to: str | None = None, log: str | None = None, run_id: str | None = None,
) -> DataFrame:
    """Write the filtered tables; returns the impact per table. Without an output folder: a dry run, nothing is kept.

    Key sets are stored once, since every table that is written needs them again, and deleted in the end. The tables
    are written side by side. The report has a few rows and is complete when the flow returns; with ``log`` it goes into the
    run log. Tables that ``only`` and ``exclude`` leave out are in it too: nothing of them is in the output.
    """
    clauses, propagate = list(clauses), list(propagate)

    def flow() -> DataFrame:
        return _filtered(spark, input_folder, output_folder, clauses, propagate, tuple(only), tuple(exclude), keep_nulls, copy_to)

    def details() -> tuple[dict, list[str]]:
        return {"input": input_folder, "output": output_folder, "clauses": [str(c) for c in [*clauses, *propagate]]}, []

    return run_logged(spark, log, "filter", flow, run_id, details)


def _filtered(spark, input_folder, output_folder, clauses, propagate, only, exclude, keep_nulls, copy_to) -> DataFrame:
    source = store.scan_dataset(spark, input_folder)
    work = scratch(spark, "filter")
    number = count()
    try:
        kept = filter_dataset(
            source, clauses, propagate, only, exclude, keep_nulls,
            lambda keys: stored(keys, "keys", f"{work}/keys-{next(number)}"),
        )
        before = {t: source[t] for t in kept}
        after = kept
        if output_folder is not None:
            side_by_side(lambda t: store.write_table(kept[t], output_folder, t, copy_to, keep_empty=True), kept)
            after = {t: df for t in kept if (df := store.scan_table(spark, output_folder, t)) is not None}
        counted = browse.snapshot_counts(before, spark)
        impact = browse.filter_impact(counted, browse.snapshot_counts(after, spark, list(kept)))
        left_out = browse.snapshot_counts({t: df for t, df in source.items() if t not in kept}, spark)
        impact = impact.unionByName(browse.filter_impact(left_out, left_out.withColumn("n_rows", F.lit(0).cast("bigint")))).orderBy("table")
        return spark.createDataFrame(impact.collect(), impact.schema)  # one row per table
    finally:
        store.remove(spark, work)


# Column that identifies a row to delete; ELTID in all other tables.
ID_OF_TABLE = {"patient": "PATID", "mvt": "EVTID"}


def delete_rows(
    spark: SparkSession, folder: str, table: str, ids: DataFrame | Sequence[str], column: str | None = None
) -> int:
    """Write a table anew without the listed ids; returns the number of rows left."""
    rows = store.scan_table(spark, folder, table)
    if rows is None:
        raise ValueError(f"no such table: {table}")
    kept = merge.delete_by_id(rows, ids, column or ID_OF_TABLE.get(table, "ELTID"))
    store.write_table(kept, folder, table, keep_empty=True)
    return store.scan_table(spark, folder, table).count()
