"""From bundles to typed rows: entries, routing, extraction, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import model
from wardlake.functions import ids, records, values

ENTRY_SCHEMA = "entry array<struct<resource:string>>"


def bundle_entries(
    bundles: DataFrame, value: str = "value", keep: tuple[str, ...] = (), with_empty: bool = False
) -> DataFrame:
    """One row (resource_type, resource) per entry that has a resource; ``keep`` carries bundle columns along.

    The text leaf in the schema leaves each resource as raw JSON: the bundle is parsed once, and
    each resource once more by the extraction of its own type.
    """
    typed = F.transform(
        F.from_json(value, ENTRY_SCHEMA)["entry"],
        lambda e: F.struct(records.json_path(e["resource"], "resourceType").alias("resource_type"), e["resource"].alias("resource")),
    )
    entries = bundles.select(*keep, F.inline(typed))
    return entries if with_empty else entries.filter("resource is not null")


def route_resources(resources: DataFrame, mapping: dict = model.MAPPING) -> DataFrame:
    """Keep mapped record types and add the name of their target table."""
    kept = resources.filter(F.col("resource_type").isin(list(mapping)))
    table = None
    for record_type, rule in mapping.items():
        table = (F if table is None else table).when(F.col("resource_type") == record_type, rule["table"])
    return kept.withColumn("table", table)


def extract_type(resources: DataFrame, record_type: str, mapping: dict = model.MAPPING) -> DataFrame:
    """Mapped columns of one record type, all text: one pruned parse per record, then field access."""
    paths = {c: p for c, p in mapping[record_type]["columns"].items() if p}
    own = resources.filter(F.col("resource_type") == record_type).select("resource")
    return records.parsed(own, records.pruned_schema(paths.values())).select(
        *[extracted_text(records.at_path(F.col("record"), p)).alias(c) for c, p in paths.items()]
    )


def extracted_text(value: Column) -> Column:
    """Reference prefixes come off strings only; JSON text of nested values stays as it is.

    A string may start with a bracket as well, so such values count as nested only if they are JSON. Most values hold no mark
    of a prefix and are left alone; the rare ones behind a bracket are looked at in a lambda. The rules of all columns in one
    generated method would be more than the JVM compiles; next to a lambda, Spark writes methods per column.
    """
    plain = ids.strip_ref_prefix(value)
    bracket = value.startswith("{") | value.startswith("[")
    judged = F.transform(F.array(value), lambda v: F.when(F.try_parse_json(v).isNotNull(), v).otherwise(ids.strip_ref_prefix(v)))
    return F.when(~ids.may_hold_prefix(value), value).when(bracket, F.get(judged, F.lit(0))).otherwise(plain)


def union_resource_types(resources: DataFrame, table: str, mapping: dict = model.MAPPING) -> DataFrame:
    """All record types of a table, each with its own columns, appended by name."""
    parts = [extract_type(resources, t, mapping) for t in model.types_of_table(table, mapping)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def enforce_schema(df: DataFrame, table: str, tables: dict[str, list[str]] = model.TABLES) -> DataFrame:
    """Exactly the declared columns in the declared order: missing ones, and values of another type, null; others dropped."""
    if table not in tables:
        return df
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"TRY_CAST({f'`{c}`' if c in have else 'null'} AS {model.column_type(table, c).simpleString()}) AS `{c}`"
            for c in tables[table]
        ]
    )


def clean_table(df: DataFrame, table: str, as_of: Column | str | None = None) -> DataFrame:
    """Cleaning rules of a table: id columns everywhere, sex and age of patients, unit of stays."""
    changes = {c: ids.clean_ids(F.col(c)) for c in model.ID_COLUMNS if c in df.columns}
    if table == "patient":
        changes["PATSEX"] = values.normalize_sex(F.col("PATSEX"))
        changes["PATAGE"] = values.compute_age(F.col("PATBD"), as_of)
    elif table == "mvt":
        changes["SEJUM"] = values.default_unit(F.col("SEJUM"))
    return df.withColumns(changes)


def extract_table(
    resources: DataFrame,
    table: str,
    mapping: dict = model.MAPPING,
    tables: dict[str, list[str]] = model.TABLES,
    as_of: Column | str | None = None,
) -> DataFrame:
    """Rows of one table before enrichment: extract, shape, clean."""
    return clean_table(enforce_schema(union_resource_types(resources, table, mapping), table, tables), table, as_of)
