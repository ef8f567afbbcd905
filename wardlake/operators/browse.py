"""Counts, previews and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import model
from wardlake.functions import records, values
from wardlake.operators.extract import ENTRY_SCHEMA
from wardlake.sources.bundles import read_status

# Fixed value: tables that statistics do not show.
INTERNAL_TABLES = ("patient",)
PREVIEW_ROWS = 50
PREVIEW_COLUMNS = 8


def bundle_summary(resources: DataFrame) -> DataFrame:
    """(resource_type, n): records per type, and all entries under ``*``; entries without a type count there only.

    To count entries without a resource too, read the entries with ``with_empty``.
    """
    typed = resources.filter(F.col("resource_type").isNotNull())
    per_type = typed.groupBy("resource_type").agg(F.count("*").alias("n"))
    return per_type.unionByName(resources.agg(F.count("*").alias("n")).select(F.lit("*").alias("resource_type"), "n"))


def table_row_count(df: DataFrame | None, table: str, spark: SparkSession) -> DataFrame:
    """(table, n_rows); 0 for an absent table."""
    if df is None:
        return spark.range(1).select(F.lit(table).alias("table"), F.lit(0).cast("bigint").alias("n_rows"))
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(table).alias("table"), "n_rows")


def snapshot_counts(
    dataset: Mapping[str, DataFrame], spark: SparkSession, tables: Sequence[str] | None = None
) -> DataFrame:
    """(table, n_rows) for the named tables (default: all of the dataset), 0 for absent ones.

    All tables are counted in one pass with one exchange of a row per task and table. No column is read: of a stored table
    Spark takes the row counts from the file footers.
    """
    names = sorted(dataset) if tables is None else tables
    listed = spark.createDataFrame([(t, 0) for t in names], "table string, n bigint")
    rows = [dataset[t].select(F.lit(t).alias("table"), F.lit(1).cast("bigint").alias("n")) for t in names if t in dataset]
    return reduce(DataFrame.unionByName, [listed, *rows]).groupBy("table").agg(F.sum("n").alias("n_rows"))


def merge_report(before: DataFrame, after: DataFrame, incoming: DataFrame) -> DataFrame:
    """(table, before_rows, incoming_rows, after_rows, added_rows) by table, from three (table, n_rows)."""
    sides = [
        df.select("table", F.lit(i).alias("side"), "n_rows") for i, df in enumerate((before, incoming, after))
    ]
    rows = reduce(DataFrame.unionByName, sides)

    def total(side: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n_rows"))), F.lit(0)).cast("bigint")

    report = rows.groupBy("table").agg(
        total(0).alias("before_rows"), total(1).alias("incoming_rows"), total(2).alias("after_rows")
    )
    return report.withColumn("added_rows", F.col("after_rows") - F.col("before_rows")).orderBy("table")


def incoming_accumulate(merges: DataFrame) -> DataFrame:
    """(table, n_rows): incoming rows of many merges (table, incoming_rows) summed."""
    return merges.groupBy("table").agg(F.sum("incoming_rows").cast("bigint").alias("n_rows"))


def filter_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, input_rows, output_rows, delta_rows, delta_pct) from two (table, n_rows)."""
    left = before.select("table", F.col("n_rows").alias("input_rows"))
    right = after.select("table", F.col("n_rows").alias("output_rows"))
    counts = left.join(right, "table", "full").fillna(0, ["input_rows", "output_rows"])
    delta = F.col("output_rows") - F.col("input_rows")
    share = F.when(F.col("input_rows") == 0, F.lit(0.0)).otherwise(F.round(delta / F.nullif("input_rows", F.lit(0)) * 100, 1))
    return counts.withColumns({"delta_rows": delta, "delta_pct": share})


def table_stats(
    dataset: Mapping[str, DataFrame], spark: SparkSession, hidden: Sequence[str] = INTERNAL_TABLES
) -> DataFrame:
    """(table, n_rows, n_cols) of the visible tables, by name."""
    shown = {t: df for t, df in dataset.items() if t not in hidden}
    widths = spark.createDataFrame([(t, len(df.columns)) for t, df in shown.items()], "table string, n_cols bigint")
    return snapshot_counts(shown, spark).join(widths, "table").orderBy("table")


def dataset_totals(dataset: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Number of tables, rows in all, and rows per table as a map."""
    return snapshot_counts(dataset, spark).agg(
        F.count("*").alias("n_tables"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n_rows")))).alias("detail"),
    )


def preview(df: DataFrame, order: Sequence[str] = (), limit: int = PREVIEW_ROWS) -> DataFrame:
    """First rows, in the order of the given columns (a top-n per task); without an order the head of the table as it lies."""
    return (df.orderBy(*order) if order else df).limit(limit)


def preview_columns(
    df: DataFrame, columns: Sequence[str] = (), limit: int = 5, max_cols: int = PREVIEW_COLUMNS, max_cell: int = 0,
    order: Sequence[str] = (),
) -> DataFrame:
    """Named columns, else the first ``max_cols``; cells clipped if ``max_cell`` is set. Unknown names fail."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    head = preview(df, order, limit).select(*(list(columns) or df.columns[:max_cols]))
    return head.select(*[values.clip_cell(F.col(c), max_cell).alias(c) for c in head.columns]) if max_cell else head


def patient_ids(resources: DataFrame, limit: int = 0) -> DataFrame:
    """Ids of the Patient records in order; 0 means all."""
    patients = resources.filter(F.col("resource_type") == "Patient")
    found = patients.select(records.json_path(F.col("resource"), "id").alias("patient_id"))
    found = found.filter(F.col("patient_id").isNotNull() & (F.col("patient_id") != ""))
    return found.orderBy("patient_id").limit(limit) if limit > 0 else found


def import_status(resources: DataFrame) -> DataFrame:
    """Per patient (patient_id, resource_type, readable): status, entries and records per type.

    ``readable`` false marks a record that cannot be parsed: the patient counts as failed, the run goes on.
    Types are counted before they are put into the map, so the map never holds more than the types.
    """
    per_type = resources.groupBy("patient_id", "resource_type").agg(
        F.count("*").alias("n"), F.count_if(~F.col("readable")).alias("bad")
    )
    counted = F.when(F.col("resource_type").isNotNull(), F.struct("resource_type", "n"))
    return per_type.groupBy("patient_id").agg(
        F.when(F.sum("bad") > 0, "failed").otherwise("success").alias("status"),
        F.sum("n").cast("bigint").alias("entries_total"),
        F.map_from_entries(F.array_sort(F.collect_list(counted))).alias("resources_per_type"),
    )


def judge_requests(requests: DataFrame, value: str = "value") -> DataFrame:
    """The documents without their text: ``_bad`` (no JSON at all) and ``_types`` (of their records, null for none) instead.

    What is left is small, so join and shuffle it rather than the documents.
    """
    read = records.parsed(requests, f"{ENTRY_SCHEMA}, {records.CORRUPT} string", "_read", value, records.KEEP_CORRUPT)
    # An entry of another type is kept as corrupt too, so the plain check decides on what was not read smoothly.
    smooth = F.col(f"_read.{records.CORRUPT}").isNull()
    bad = F.when(smooth, F.lit(False)).otherwise(read_status(F.col(value)) == "malformed")
    full = F.filter(F.col("_read.entry"), lambda e: e["resource"].isNotNull())
    types = F.transform(full, lambda e: records.json_path(e["resource"], "resourceType"))
    others = [c for c in requests.columns if c != value]
    return read.select(*others, bad.alias("_bad"), F.coalesce(types, F.array().cast("array<string>")).alias("_types"))


def request_status(requests: DataFrame) -> DataFrame:
    """Per requested patient (patient_id, value: the documents that came back): as ``import_status``, with ``error``.

    A patient of whom a document cannot be read has failed, with the text of the first error; what else came of the same
    patient is counted all the same. Documents that ``judge_requests`` has read already are taken as they are. Each document
    is read once, and documents and their records are counted together. Documents that name no patient are not counted.
    """
    judged = requests if "_types" in requests.columns else judge_requests(requests)
    row = "struct<entry:boolean,resource_type:string,bad:boolean>"
    document = F.array(F.struct(F.lit(False).alias("entry"), F.lit(None).cast("string").alias("resource_type"), F.col("_bad").alias("bad")))
    entries = F.transform("_types", lambda t: F.struct(F.lit(True).alias("entry"), t.alias("resource_type"), F.lit(False).alias("bad")))
    rows = judged.select("patient_id", F.inline(F.concat(document.cast(f"array<{row}>"), entries.cast(f"array<{row}>"))))
    per_type = rows.groupBy("patient_id", "entry", "resource_type").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    typed = F.when(F.col("entry") & F.col("resource_type").isNotNull(), F.struct("resource_type", "n"))
    counted = per_type.groupBy("patient_id").agg(
        F.sum("bad").alias("_bad"), F.sum(F.when(F.col("entry"), F.col("n"))).alias("entries_total"),
        F.map_from_entries(F.array_sort(F.collect_list(typed))).alias("resources_per_type"),
    )
    known = F.col("patient_id").isNotNull()
    bad = known & (F.col("_bad") > 0)
    return counted.select(
        "patient_id", F.when(bad, "failed").otherwise("success").alias("status"),
        F.when(bad, F.concat(F.col("_bad").cast("string"), F.lit(" unreadable documents"))).alias("error"),
        F.coalesce(F.when(known, F.col("entries_total")), F.lit(0)).cast("bigint").alias("entries_total"),
        F.when(known, F.col("resources_per_type")).otherwise(
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
        ).alias("resources_per_type"),
    )


def import_totals(status: DataFrame) -> DataFrame:
    """Patients in all, successful and failed."""
    return status.agg(
        F.count("*").alias("patients_total"),
        F.count_if(F.col("status") == "success").alias("patients_success"),
        F.count_if(F.col("status") == "failed").alias("patients_failed"),
    )
