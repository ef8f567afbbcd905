"""Inverted index of records: (resource_type, path, token) -> ids, made once, searched without reading a record.

The rows are sorted by ranges of (resource_type, path, token, id) and written so. A search is a filter on the first three:
the statistics of the files and of their row groups leave the few that hold the token, for whole tokens as for beginnings of
names. The id is part of the order, so a token that a third of all records have is spread over many files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlake.functions import records
from wardlake.operators.search import NAME_SCHEMA
from wardlake.session import stored
from wardlake.sources.tables import CODEC

#: Path under which the parts of names stand, in lower case.
NAME, FAMILY = "name", "name.family"
SCHEMA = "resource_type string, path string, token string, id string"


def _entry(path: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lit(path).alias("path"), t.alias("token")))


def _name_entries() -> list[Column]:
    names = F.from_json("resource", NAME_SCHEMA)["name"]
    family = F.transform(names, lambda n: F.lower(n["family"]))
    given = F.flatten(F.transform(names, lambda n: F.coalesce(n["given"], F.array())))
    parts = F.concat(F.transform(given, F.lower), F.transform(names, lambda n: F.lower(n["text"])), family)
    return [_entry(FAMILY, family), _entry(NAME, F.array_distinct(parts))]


def token_rows(resources: DataFrame, paths: Mapping[str, Sequence[str]], names: bool = True) -> DataFrame:
    """(resource_type, path, token, id) of the values at the paths of each type, and of the names of patients.

    Each record is parsed once for all of its paths. Records without an id cannot be found.
    """
    parts = []
    for record_type, wanted in paths.items():
        own = resources.filter(F.col("resource_type") == record_type)
        read = records.parsed(own, records.pruned_schema([*wanted, "id"]), "_r")
        values = [F.struct(F.lit(p).alias("path"), records.at_path(F.col("_r"), p).alias("token")) for p in wanted]
        parts.append(read.select("resource_type", F.col("_r.id").alias("id"), F.inline(F.array(*values))))
    if names:
        patients = resources.filter("resource_type = 'Patient'")
        own = records.json_path(F.col("resource"), "id").alias("id")
        entries = F.concat(*[F.coalesce(e, F.array().cast("array<struct<path:string,token:string>>")) for e in _name_entries()])
        parts.append(patients.select("resource_type", own, F.inline(entries)))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.filter("token IS NOT NULL AND id IS NOT NULL").select("resource_type", "path", "token", "id")


def write_index(rows: DataFrame, folder: str) -> None:
    """Rows that come twice meet in their range and leave one. The ranges are drawn from stored rows, which are made once."""
    order = ["resource_type", "path", "token", "id"]
    ranged = stored(rows.select(*order), "tokens", compression=CODEC).repartitionByRange(*order)
    first = F.row_number().over(W.partitionBy(*order).orderBy("id")) == 1  # by the order of the index: one sort for both
    once = ranged.withColumn("_first", first).filter("_first").select(*order)
    once.sortWithinPartitions(*order).write.mode("overwrite").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def find(index: DataFrame, record_type: str, path: str, *tokens: str) -> DataFrame:
    """Ids of the records of a type with one of the tokens at the path."""
    at = (F.col("resource_type") == record_type) & (F.col("path") == path) & F.col("token").isin(list(tokens))
    found = index.filter(at)
    return found.select("id") if len(tokens) == 1 else found.select("id").distinct()


def find_name(index: DataFrame, name: str, family_only: bool = False) -> DataFrame:
    """Ids of the patients with a part of the name that starts with the text, in any case."""
    at = (F.col("resource_type") == "Patient") & (F.col("path") == (FAMILY if family_only else NAME))
    return index.filter(at & F.col("token").startswith(name.lower())).select("id").distinct()
