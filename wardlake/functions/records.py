"""Paths into nested JSON records: one pruned parse, then plain field access."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CORRUPT = "_corrupt"
KEEP_CORRUPT = {"columnNameOfCorruptRecord": CORRUPT}


def path_steps(path: str) -> list[str | int]:
    """``a.b[0].c`` -> ['a', 'b', 0, 'c']."""
    return [int(s) if s.isdigit() else s for s in re.findall(r"[^.\[\]]+", path)]


def pruned_schema(paths) -> T.StructType:
    """Smallest schema that holds all paths; every leaf is text, so nothing is lost to typing."""
    tree: dict = {}
    for path in paths:
        node = tree
        steps = path_steps(path)
        for step in steps[:-1]:
            node = node.setdefault("[]" if isinstance(step, int) else step, {})
        node.setdefault("[]" if isinstance(steps[-1], int) else steps[-1], {})
    return _as_type(tree)


def _as_type(tree: dict) -> T.DataType:
    if not tree:
        return T.StringType()
    if "[]" in tree:
        return T.ArrayType(_as_type(tree["[]"]))
    return T.StructType([T.StructField(k, _as_type(v)) for k, v in tree.items()])


def at_path(parsed: Column, path: str) -> Column:
    """Value at a path of a parsed record; a missing key or index gives null."""
    for step in path_steps(path):
        parsed = F.get(parsed, F.lit(step)) if isinstance(step, int) else parsed.getField(step)
    return parsed


def parsed(
    df: DataFrame, schema: str | T.StructType, name: str = "record", column: str = "resource", options: dict[str, str] | None = None
) -> DataFrame:
    """Add the parsed record as a struct column.

    A plain ``from_json`` column is parsed again for every filter on one of its fields, because Spark moves such
    filters below the projection. Taking the struct out of a one-item array stops that: each record is parsed once.
    """
    return df.select("*", F.explode(F.array(F.from_json(column, schema, options))).alias(name))


def json_path(record: Column, path: str) -> Column:
    """Ad-hoc access on raw JSON text. For several paths of one record use ``pruned_schema`` and ``at_path``."""
    if not path:
        return F.lit(None).cast("string")
    steps = "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in path_steps(path))
    return F.get_json_object(record, "$" + steps)


def is_readable(record: Column, schema: str = "resourceType string") -> Column:
    """False for text that is no JSON. The strict parser runs only for what the lenient one refuses."""
    return ~corrupt(record, F.from_json(record, f"{schema}, {CORRUPT} string", KEEP_CORRUPT))


def corrupt(record: Column, read: Column) -> Column:
    """True where the record could not be read; ``read`` was parsed with the ``CORRUPT`` field."""
    return read[CORRUPT].isNotNull() & F.try_parse_json(record).isNull()


def stringify_nested(value: Column) -> Column:
    """Compact JSON text of an array or struct column."""
    return F.to_json(value)


def coding_by_system(codings: Column, system: str) -> Column:
    """Code of the first coding whose system is the given one."""
    return F.get(F.filter(codings, lambda c: c["system"] == system), F.lit(0)).getField("code")


def patient_display(patient: Column) -> list[Column]:
    """id, family, given, birth date and gender of a parsed Patient, ready to show."""
    name = F.get(patient["name"], F.lit(0))
    given = F.when(F.size(name["given"]) > 0, F.array_join(name["given"], " "))
    missing = F.lit("N/A")
    return [
        F.coalesce(patient["id"], F.lit("?")).alias("id"),
        F.coalesce(name["family"], missing).alias("family"),
        F.coalesce(given, missing).alias("given"),
        F.coalesce(patient["birthDate"], missing).alias("birth"),
        F.coalesce(patient["gender"], missing).alias("gender"),
    ]
