"""Enrichment, merge, set operations and the whole import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake import model
from wardlake.operators import enrich, extract, merge
from wardlake.operators import filters as flt
from wardlake.plans import importing
from wardlake.session import scratch
from wardlake.sources import tables as store
from wardlake.sources.keyindex import KeyIndex
from wardlake.workload import fixtures as fx
from wardlake.workload.expected import HAVE, columns, tables, whole
from wardlake.workload.registry import query

ALL_IDS = """
    SELECT 'patient' AS "table", PATID, CAST(NULL AS VARCHAR) AS EVTID, CAST(NULL AS VARCHAR) AS ELTID,
           CAST(PATAGE AS VARCHAR) AS PATAGE, PATSEX FROM patient
    UNION ALL SELECT 'mvt', PATID, EVTID, ELTID, PATAGE, PATSEX FROM mvt
    UNION ALL SELECT 'biol', PATID, EVTID, ELTID, PATAGE, PATSEX FROM biol
    UNION ALL SELECT 'pharma', PATID, EVTID, ELTID, PATAGE, PATSEX FROM pharma
    UNION ALL SELECT 'doceds', PATID, EVTID, ELTID, PATAGE, PATSEX FROM doceds
    UNION ALL SELECT 'pmsi', PATID, EVTID, ELTID, PATAGE, PATSEX FROM pmsi"""


def id_rows(dataset: dict[str, DataFrame], *more: str) -> DataFrame:
    """Table name, ids and some more columns of every table of a dataset."""

    def of(name: str, df: DataFrame) -> DataFrame:
        wanted = ["PATID", "EVTID", "ELTID", *more]
        have = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in wanted]
        return df.select(F.lit(name).alias("table"), *have)

    return reduce(DataFrame.unionByName, [of(n, df) for n, df in dataset.items()])


def whole_rows(dataset: dict[str, DataFrame]) -> DataFrame:
    """Table name, PATID, EVTID, and a digest over all columns of every row of a dataset."""

    def of(name: str, df: DataFrame) -> DataFrame:
        text = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in model.TABLES[name]]
        stay = F.col("EVTID") if "EVTID" in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(name).alias("table"), "PATID", stay.alias("EVTID"), F.md5(F.concat_ws("|", *text)).alias("digest"))

    return reduce(DataFrame.unionByName, [of(n, df) for n, df in dataset.items()])


def whole_rows_sql() -> str:
    def of(name: str, listed: list[str]) -> str:
        text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in listed)
        stay = "EVTID" if "EVTID" in listed else "CAST(NULL AS VARCHAR)"
        return f"""SELECT '{name}' AS "table", PATID, {stay} AS EVTID, md5(concat_ws('|', {text})) AS digest FROM (SELECT {columns(name, HAVE[name])} FROM {name})"""

    return tables(" UNION ALL ".join(of(n, c) for n, c in model.TABLES.items()))


@query("enrich_patient_mvt", whole("mvt"))
def enrich_patient_mvt(spark, sf_dir):
    mvt, patient = fx.extracted(spark, sf_dir, "mvt"), fx.extracted(spark, sf_dir, "patient")
    return enrich.enrich_patient_mvt(mvt, patient)


@query(
    "enrich_patient",
    tables(
        """SELECT f.ELTID, f.PATID, p.PATBD, CAST(p.PATAGE AS VARCHAR) AS PATAGE, p.PATSEX
           FROM pharma0 f LEFT JOIN patient p ON f.PATID = p.PATID"""
    ),
)
def enrich_patient(spark, sf_dir):
    data = fx.dataset(spark, sf_dir, "pharma", "patient")
    return enrich.enrich_patient(data["pharma"], data["patient"]).select("ELTID", "PATID", "PATBD", "PATAGE", "PATSEX")


@query(
    "enrich_stay",
    tables(
        """SELECT f.ELTID, coalesce(f.PATID, m.PATID) AS PATID, m.SEJUM, m.SEJUF, m.PATAGE, m.PATSEX
           FROM biol0 f LEFT JOIN mvt m ON f.EVTID = m.EVTID"""
    ),
)
def enrich_stay(spark, sf_dir):
    data = fx.dataset(spark, sf_dir, "biol", "mvt", "patient")
    mvt = enrich.enrich_patient_mvt(data["mvt"], data["patient"])
    return enrich.enrich_stay(data["biol"], mvt).select("ELTID", "PATID", "SEJUM", "SEJUF", "PATAGE", "PATSEX")


def _enriched(table: str):
    return lambda spark, sf_dir: fx.imported(spark, sf_dir, table)[table]


query("enrich_table", whole("biol"))(_enriched("biol"))
query("enrich_table_pharma", whole("pharma"))(_enriched("pharma"))
query("enrich_table_doceds", whole("doceds"))(_enriched("doceds"))
query("enrich_table_pmsi", whole("pmsi"))(_enriched("pmsi"))


_BASE = "PRLVTDATE < '1998-01-01'"
_INCOMING = "PRLVTDATE >= '1997-01-01'"


@query(
    "merge_insert_only",
    tables(
        f"""SELECT 'base' AS origin, ELTID, EVTID, PNAME, PRLVTDATE, RESULT FROM biol0 WHERE {_BASE}
            UNION ALL
            SELECT 'new', ELTID, EVTID, PNAME, PRLVTDATE, RESULT FROM biol0 i WHERE {_INCOMING} AND NOT EXISTS (
                SELECT 1 FROM biol0 b WHERE b.{_BASE} AND b.EVTID = i.EVTID AND b.PNAME = i.PNAME AND b.PRLVTDATE = i.PRLVTDATE)"""
    ),
)
def merge_insert_only(spark, sf_dir):
    biol = fx.dataset(spark, sf_dir, "biol")["biol"]
    base = biol.filter(_BASE).withColumn("origin", F.lit("base"))
    incoming = biol.filter(_INCOMING).withColumn("origin", F.lit("new"))
    merged = merge.merge_insert_only(base, incoming, model.MERGE_KEYS["biol"])
    return merged.select("origin", "ELTID", "EVTID", "PNAME", "PRLVTDATE", "RESULT")


_BATCHES = ["PRLVTDATE < '1996'", "PRLVTDATE >= '1995' AND PRLVTDATE < '1998'", "PRLVTDATE >= '1997'"]
_SAME = "b.EVTID = i.EVTID AND b.PNAME = i.PNAME AND b.PRLVTDATE = i.PRLVTDATE"


@query(
    "merge_indexed",
    tables(
        f"""SELECT '0' AS batch, * FROM biol0 WHERE {_BATCHES[0]}
            UNION ALL SELECT '1', * FROM biol0 i WHERE {_BATCHES[1]} AND NOT EXISTS (
                SELECT 1 FROM biol0 b WHERE {_BATCHES[0]} AND {_SAME})
            UNION ALL SELECT '2', * FROM biol0 i WHERE {_BATCHES[2]} AND NOT EXISTS (
                SELECT 1 FROM biol0 b WHERE ({_BATCHES[0]} OR {_BATCHES[1]}) AND {_SAME})"""
    ),
)
def merge_indexed(spark, sf_dir):
    """Three batches that overlap, merged one after another into a stored table by the index of its keys."""
    biol, folder = fx.dataset(spark, sf_dir, "biol")["biol"], scratch(spark, "merge")
    for number, part in enumerate(_BATCHES):
        rows = biol.filter(part).withColumn("batch", F.lit(str(number)))
        store.append_table(KeyIndex(spark, folder, "biol", model.MERGE_KEYS["biol"]).new_rows(rows), folder, "biol")
    return store.scan_table(spark, folder, "biol").drop("SEJUM", "SEJUF", "VALIDADATE", "PATAGE", "PATSEX")


@query(
    "null_safe_keys",
    tables(
        f"""WITH keyed AS (SELECT ELTID, EVTID, CASE WHEN RNAME <> 'AF' THEN PNAME END AS PNAME, PRLVTDATE FROM biol0)
            SELECT ELTID, EVTID, PNAME FROM keyed i WHERE {_INCOMING} AND NOT EXISTS (
                SELECT 1 FROM keyed b WHERE b.{_BASE} AND b.EVTID = i.EVTID AND b.PNAME IS NOT DISTINCT FROM i.PNAME)"""
    ),
)
def null_safe_keys(spark, sf_dir):
    biol = fx.dataset(spark, sf_dir, "biol")["biol"]
    keyed = biol.withColumn("PNAME", F.when(F.col("RNAME") != "AF", F.col("PNAME")))
    fresh = merge.new_rows(keyed.filter(_BASE), keyed.filter(_INCOMING), ["EVTID", "PNAME"])
    return fresh.select("ELTID", "EVTID", "PNAME")


@query(
    "propagate_semi",
    tables("SELECT ELTID, PATID FROM pharma0 WHERE PATID IN (SELECT PATID FROM patient WHERE PATSEX = 'F')"),
)
def propagate_semi(spark, sf_dir):
    data = fx.dataset(spark, sf_dir, "pharma", "patient")
    keys = data["patient"].filter("PATSEX = 'F'").select("PATID")
    return flt.propagate_semi(data["pharma"], keys, "PATID").select("ELTID", "PATID")


@query(
    "delete_by_id",
    tables("SELECT EVTID, PATID FROM mvt0 WHERE EVTID NOT IN (SELECT 'e' || o_orderkey FROM orders WHERE o_orderstatus = 'P')"),
)
def delete_by_id(spark, sf_dir):
    mvt = fx.dataset(spark, sf_dir, "mvt")["mvt"]
    gone = fx.orders(spark, sf_dir).filter("o_orderstatus = 'P'").select(fx.text("e", "o_orderkey"))
    return merge.delete_by_id(mvt, gone, "EVTID").select("EVTID", "PATID")


@query("union_resource_types", tables("SELECT PATID, EVTID, ELTID, RECTXT, RECFAMTXT, RECDATE, RECTYPE, SEJUM FROM doceds0"))
def union_resource_types(spark, sf_dir):
    rows = extract.union_resource_types(fx.resources(spark, sf_dir, *model.types_of_table("doceds")), "doceds")
    return rows.select("PATID", extract.ids.clean_ids(F.col("EVTID")).alias("EVTID"), "ELTID", "RECTXT", "RECFAMTXT", "RECDATE", "RECTYPE", "SEJUM")


@query(
    "safe_concat",
    tables(
        """SELECT PATID, PATBD, CAST(PATAGE AS VARCHAR) AS PATAGE, PATSEX, CAST(NULL AS VARCHAR) AS EVTID FROM patient
           UNION ALL SELECT PATID, NULL, NULL, NULL, EVTID FROM mvt0"""
    ),
)
def safe_concat(spark, sf_dir):
    data = fx.dataset(spark, sf_dir, "patient", "mvt")
    return merge.safe_concat(data["patient"], data["mvt"].select("PATID", "PATAGE", "EVTID"))


@query(
    "append_no_key",
    tables("SELECT EVTID, SEJUM FROM mvt0 WHERE DATENT < '1998' UNION ALL SELECT EVTID, SEJUM FROM mvt0 WHERE DATENT > '1997'"),
)
def append_no_key(spark, sf_dir):
    mvt = fx.dataset(spark, sf_dir, "mvt")["mvt"].select("EVTID", "SEJUM", "DATENT")
    return merge.append_no_key(mvt.filter("DATENT < '1998'"), mvt.filter("DATENT > '1997'")).select("EVTID", "SEJUM")


@query("distinct_keys", tables("SELECT DISTINCT coalesce(PATID, '') AS PATID, PNAME FROM biol0"))
def distinct_keys(spark, sf_dir):
    return merge.distinct_keys(fx.dataset(spark, sf_dir, "biol")["biol"], ["PATID", "PNAME"])


@query("import_dataset", tables(ALL_IDS))
def import_dataset(spark, sf_dir):
    folder = scratch(spark, "dataset")
    importing.import_bundles(fx.bundles(spark, sf_dir), folder, as_of=fx.AS_OF)
    return id_rows(store.scan_dataset(spark, folder), "PATAGE", "PATSEX")


@query("import_in_batches", whole_rows_sql())
def import_in_batches(spark, sf_dir):
    """The whole import in two batches, the second with bundles of the first again; every column of every table."""
    folder, bundles = scratch(spark, "dataset"), fx.bundles(spark, sf_dir)
    for part in ("name NOT LIKE 'line-%'", "name NOT LIKE 'document-%'"):
        importing.import_bundles(bundles.filter(part), folder, as_of=fx.AS_OF)
    return whole_rows(store.scan_dataset(spark, folder))
