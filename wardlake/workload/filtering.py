"""Clauses, propagation and dataset filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake.operators import browse
from wardlake.operators import filters as flt
from wardlake.operators.filters import Propagate, Where
from wardlake.session import scratch
from wardlake.workload import fixtures as fx
from wardlake.workload.expected import ALL_IDS0, tables
from wardlake.workload.joins import id_rows
from wardlake.workload.registry import query


def _filtered(spark, sf_dir, table, *clauses):
    return flt.where_all(fx.dataset(spark, sf_dir, table)[table], table, clauses)


@query(
    "where_cmp",
    tables(
        """SELECT ELTID, RESULT, RNAME FROM biol0 WHERE CAST(RESULT AS DOUBLE) >= 10 AND CAST(RESULT AS DOUBLE) < 40
           AND CAST(RESULT AS DOUBLE) <> 25 AND RNAME = 'NO' AND PRLVTDATE > '1996-06' AND PRLVTDATE <= '2001-01'"""
    ),
)
def where_cmp(spark, sf_dir):
    rows = _filtered(
        spark, sf_dir, "biol",
        Where("biol", "RESULT", ">=", 10), Where("biol", "RESULT", "<", 40), Where("biol", "RESULT", "!=", 25),
        Where("biol", "RNAME", "==", "NO"), Where("biol", "PRLVTDATE", ">", "1996-06"),
        Where("biol", "PRLVTDATE", "<=", "2001-01"), Where("biol", "RESULT", "!=", 25.0),
    )
    return rows.select("ELTID", "RESULT", "RNAME")


@query("where_contains", tables("SELECT ELTID, RECTYPE FROM doceds0 WHERE contains(RECTXT, 'the.')", False))
def where_contains(spark, sf_dir):
    return _filtered(spark, sf_dir, "doceds", Where("*", "RECTXT", "contains", "the.")).select("ELTID", "RECTYPE")


@query("where_regex", tables("SELECT ELTID, RECTYPE FROM doceds0 WHERE regexp_matches(RECTXT, '[a-z]+[0-9]{2,}|the [ou]n')", False))
def where_regex(spark, sf_dir):
    clause = Where("doceds", "RECTXT", "regex", "/[a-z]+[0-9]{2,}|the [ou]n/")
    return _filtered(spark, sf_dir, "doceds", clause).select("ELTID", "RECTYPE")


@query("where_in", tables("SELECT EVTID, SEJUF FROM mvt0 WHERE SEJUF IN ('UF3', 'UF14', 'UF15') AND ELTID = 'l14'"))
def where_in(spark, sf_dir):
    clauses = [Where("mvt", "SEJUF", "in", ("UF3", "UF14", "UF15")), Where("mvt", "ELTID", "in", "l14")]
    return _filtered(spark, sf_dir, "mvt", *clauses).select("EVTID", "SEJUF")


@query(
    "where_in_file",
    tables("SELECT EVTID, PATID FROM mvt0 WHERE PATID IN (SELECT 'p' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
)
def where_in_file(spark, sf_dir):
    path = scratch(spark, "list")
    wanted = fx.customers(spark, sf_dir).filter("c_mktsegment = 'BUILDING'")
    wanted.select(F.concat(F.lit("  "), fx.text("p", "c_custkey"), F.lit(" \n"))).write.text(path)
    return _filtered(spark, sf_dir, "mvt", Where("mvt", "PATID", "in_file", path)).select("EVTID", "PATID")


@query(
    "where_between",
    tables(
        """SELECT ELTID, RESULT FROM biol0 WHERE CAST(RESULT AS DOUBLE) BETWEEN 5 AND 12
           AND PRLVTDATE BETWEEN '1996' AND '1999'"""
    ),
)
def where_between(spark, sf_dir):
    clauses = [Where("biol", "RESULT", "between", (5, 12)), Where("biol", "PRLVTDATE", "between", ("1996", "1999"))]
    return _filtered(spark, sf_dir, "biol", *clauses).select("ELTID", "RESULT")


@query("where_null", tables("SELECT ELTID FROM biol0 WHERE PATID IS NULL AND MINREF IS NOT NULL"))
def where_null(spark, sf_dir):
    clauses = [Where("biol", "PATID", "is_null"), Where("biol", "MINREF", "not_null")]
    return _filtered(spark, sf_dir, "biol", *clauses).select("ELTID")


@query("where_conjunction", tables("SELECT PATID, PATAGE FROM patient WHERE PATAGE > 50 AND PATSEX <> 'I' AND PATBD < '1960'"))
def where_conjunction(spark, sf_dir):
    return _filtered(
        spark, sf_dir, "patient",
        Where("patient", "PATAGE", ">", 50), Where("/^pat/", "PATSEX", "!=", "I"), Where("*", "PATBD", "<", "1960"),
        Where("patient", "ABSENT", "==", 1), Where("mvt", "PATAGE", ">", 90),
    ).select("PATID", "PATAGE")


_FILTER = dict(
    clauses=[Where("patient", "PATAGE", ">", 50), Where("mvt", "DATENT", "<", "1998")],
    propagate=[Propagate("PATID", "patient"), Propagate("EVTID", "mvt")],
)
# The stays that are left are not filtered by patient when their keys are drawn: each spec stands for itself.
_FILTER_SQL = f"""
    WITH p AS (SELECT PATID FROM patient WHERE PATAGE > 50), e AS (SELECT EVTID FROM mvt0 WHERE DATENT < '1998'),
    kept AS (
        SELECT * FROM ({ALL_IDS0}) WHERE PATID IN (SELECT PATID FROM p)
        AND ("table" = 'patient' OR EVTID IN (SELECT EVTID FROM e)))"""


@query("propagate_keys", tables(
    """SELECT DISTINCT PATID FROM (
           SELECT PATID FROM mvt0 WHERE DATENT < '1996' UNION ALL SELECT PATID FROM biol0 WHERE RNAME = 'AF'
           UNION ALL SELECT PATID FROM patient WHERE PATAGE > 80 UNION ALL SELECT PATID FROM pmsi0 WHERE DATENT < '1993'
           UNION ALL SELECT PATID FROM pharma0 WHERE PATID = 'p7' UNION ALL SELECT PATID FROM doceds0 WHERE PATID = 'p8')
       WHERE PATID IS NOT NULL"""))
def propagate_keys(spark, sf_dir):
    clauses = [
        Where("mvt", "DATENT", "<", "1996"), Where("biol", "RNAME", "==", "AF"), Where("patient", "PATAGE", ">", 80),
        Where("pmsi", "DATENT", "<", "1993"), Where("pharma", "PATID", "==", "p7"), Where("doceds", "PATID", "==", "p8"),
    ]
    return flt.propagate_keys(fx.dataset(spark, sf_dir), Propagate("PATID", "*"), clauses)


@query("filter_dataset", tables(_FILTER_SQL + ' SELECT "table", PATID, EVTID, ELTID FROM kept'))
def filter_dataset(spark, sf_dir):
    return id_rows(flt.filter_dataset(fx.dataset(spark, sf_dir), **_FILTER))


@query(
    "select_tables",
    tables(
        """SELECT 'biol' AS "table", PATID, EVTID, ELTID FROM biol0 UNION ALL SELECT 'mvt', PATID, EVTID, ELTID FROM mvt0
           UNION ALL SELECT 'pmsi', PATID, EVTID, ELTID FROM pmsi0"""
    ),
)
def select_tables(spark, sf_dir):
    data = fx.dataset(spark, sf_dir)
    return id_rows(flt.select_tables(data, "/[bmp]/", only=["biol", "mvt", "pmsi", "pharma"], exclude=["pharma"]))


@query(
    "propagate_nulls",
    tables(
        """WITH k AS (SELECT DISTINCT PATID FROM biol0 WHERE RNAME = 'AF')
           SELECT ELTID, PATID FROM biol0 WHERE PATID IS NULL OR PATID IN (SELECT PATID FROM k WHERE PATID IS NOT NULL)"""
    ),
)
def propagate_nulls(spark, sf_dir):
    biol = fx.dataset(spark, sf_dir, "biol")
    source = {"source": biol["biol"].filter("RNAME = 'AF'")}
    keys = flt.propagate_keys(source, Propagate("PATID"), keep_nulls=True)
    return flt.propagate_semi(biol["biol"], keys, "PATID", keep_nulls=True).select("ELTID", "PATID")


@query(
    "filter_impact",
    tables(
        _FILTER_SQL
        + f""", a AS (SELECT "table", count(*) AS input_rows FROM ({ALL_IDS0}) GROUP BY 1),
              b AS (SELECT "table", count(*) AS output_rows FROM kept GROUP BY 1)
            SELECT a."table", input_rows, coalesce(output_rows, 0) AS output_rows,
                   coalesce(output_rows, 0) - input_rows AS delta_rows,
                   CAST(printf('%.1f', (coalesce(output_rows, 0) - input_rows) / input_rows * 100) AS DOUBLE) AS delta_pct
            FROM a LEFT JOIN b ON a."table" = b."table\""""
    ),
)
def filter_impact(spark, sf_dir):
    data = fx.dataset(spark, sf_dir)
    kept = flt.filter_dataset(data, **_FILTER)
    return browse.filter_impact(browse.snapshot_counts(data, spark), browse.snapshot_counts(kept, spark))
