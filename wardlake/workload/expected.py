"""SQL for the expected tables, straight from the given tables: no JSON, no records."""

from __future__ import annotations

import re

from wardlake import model


def iso(ts: str) -> str:
    return f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+01:00')"


LINE_ID = "(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d'))"
STAY_END = f"CASE WHEN o_orderkey % 13 <> 0 THEN {iso('(o_orderdate + to_days(CAST(o_orderkey % 12 AS INTEGER)))')} END"

_PARTS: dict[str, str] = {
    "people": "SELECT *, DATE '1930-01-01' + CAST(c_custkey * 37 % 30000 AS INTEGER) AS born FROM customer",
    "patient": """
        SELECT 'p' || c_custkey AS PATID,
               CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN strftime(born, '%Y')
                    ELSE strftime(born, '%Y-%m-%d') END AS PATBD,
               CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 19 <> 0
                    THEN CAST(2024 - year(born) - CASE WHEN month(born) * 100 + day(born) > 615 THEN 1 ELSE 0 END AS INTEGER)
                    END AS PATAGE,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'M' WHEN 'BUILDING' THEN 'F' ELSE 'I' END AS PATSEX
        FROM people""",
    "mvt0": f"""
        SELECT 'p' || o_custkey AS PATID, 'e' || o_orderkey AS EVTID, 'l' || (o_orderkey % 50) AS ELTID,
               {iso('o_orderdate')} AS DATENT, {STAY_END} AS DATSORT, 'UF' || (o_orderkey % 50) AS SEJUF,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority ELSE 'Hôpital Indéterminé' END AS SEJUM
        FROM orders""",
    "item": """
        SELECT * FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""",
    "biol0": f"""
        SELECT CASE WHEN l_partkey % 11 <> 0 THEN 'p' || o_custkey END AS PATID, 'e' || l_orderkey AS EVTID,
               'o' || {LINE_ID} AS ELTID, {iso('l_shipdate')} AS PRLVTDATE, 'test-' || l_returnflag AS PNAME,
               'test-' || l_returnflag AS ANAME, l_returnflag || l_linestatus AS RNAME,
               CAST(l_partkey AS VARCHAR) AS LOINC, CAST(l_quantity AS VARCHAR) AS RESULT, 'g' AS UNIT,
               CASE WHEN l_linenumber <> 7 THEN '10' END AS MINREF, CASE WHEN l_linenumber <> 7 THEN '40' END AS MAXREF
        FROM item""",
    "pharma0": f"""
        SELECT 'p' || o_custkey AS PATID, 'e' || l_orderkey AS EVTID, 'm' || {LINE_ID} AS ELTID,
               {iso('l_shipdate')} AS DATPRES, p_type AS PRES, p_name AS ALLSPELABEL,
               CAST(l_partkey AS VARCHAR) AS ALLUCD13, p_brand AS CAT
        FROM item""",
    "doceds0": f"""
        SELECT 'p' || o_custkey AS PATID, 'e' || doc_id AS EVTID, 'd' || doc_id AS ELTID,
               {{text}} AS RECTXT,
               CASE WHEN lang NOT IN ('en', 'fr') THEN source END AS RECFAMTXT, {iso('o_orderdate')} AS RECDATE,
               lang AS RECTYPE, CASE WHEN lang = 'fr' THEN source END AS SEJUM
        FROM documents LEFT JOIN orders ON doc_id = o_orderkey""",
    "pmsi0": f"""
        SELECT 'p' || o_custkey AS PATID, 'e' || o_orderkey AS EVTID, 'c' || o_orderkey AS ELTID,
               {iso('o_orderdate')} AS DATENT, o_orderpriority AS DALL, o_orderstatus AS GHM,
               CASE WHEN o_orderstatus = 'O' THEN 'active' END AS PMSISTATUT, CAST(NULL AS VARCHAR) AS CODEACTES
        FROM orders
        UNION ALL
        SELECT 'p' || o_custkey, 'e' || o_orderkey, 'r' || o_orderkey, {iso('o_orderdate')}, NULL, NULL, NULL,
               'A' || (o_orderkey % 20)
        FROM orders""",
    "mvt": "SELECT m.*, CAST(p.PATAGE AS VARCHAR) AS PATAGE, p.PATSEX FROM mvt0 m LEFT JOIN patient p ON m.PATID = p.PATID",
    "biol": """
        SELECT f.* EXCLUDE (PATID), coalesce(f.PATID, m.PATID) AS PATID, m.SEJUM, m.SEJUF,
               coalesce(CAST(p.PATAGE AS VARCHAR), m.PATAGE) AS PATAGE, coalesce(p.PATSEX, m.PATSEX) AS PATSEX
        FROM biol0 f LEFT JOIN patient p ON f.PATID = p.PATID LEFT JOIN mvt m ON f.EVTID = m.EVTID""",
    "pharma": """
        SELECT f.* EXCLUDE (PATID), coalesce(f.PATID, m.PATID) AS PATID, m.SEJUM, m.SEJUF, m.DATENT, m.DATSORT, p.PATBD,
               coalesce(CAST(p.PATAGE AS VARCHAR), m.PATAGE) AS PATAGE, coalesce(p.PATSEX, m.PATSEX) AS PATSEX
        FROM pharma0 f LEFT JOIN patient p ON f.PATID = p.PATID LEFT JOIN mvt m ON f.EVTID = m.EVTID""",
    "doceds": """
        SELECT f.* EXCLUDE (PATID, SEJUM), coalesce(f.PATID, m.PATID) AS PATID, coalesce(f.SEJUM, m.SEJUM) AS SEJUM, m.SEJUF,
               p.PATBD, coalesce(CAST(p.PATAGE AS VARCHAR), m.PATAGE) AS PATAGE, coalesce(p.PATSEX, m.PATSEX) AS PATSEX
        FROM doceds0 f LEFT JOIN patient p ON f.PATID = p.PATID LEFT JOIN mvt m ON f.EVTID = m.EVTID""",
    "pmsi": """
        SELECT f.* EXCLUDE (PATID, DATENT), coalesce(f.PATID, m.PATID) AS PATID, coalesce(f.DATENT, m.DATENT) AS DATENT,
               m.DATSORT, m.SEJUM, m.SEJUF, p.PATBD,
               coalesce(CAST(p.PATAGE AS VARCHAR), m.PATAGE) AS PATAGE, coalesce(p.PATSEX, m.PATSEX) AS PATSEX,
               CAST(coalesce(date_diff('second', CAST(left(coalesce(f.DATENT, m.DATENT), 19) AS TIMESTAMP),
                                       CAST(left(m.DATSORT, 19) AS TIMESTAMP)) // 86400, 0) AS BIGINT) AS SEJDUR
        FROM pmsi0 f LEFT JOIN patient p ON f.PATID = p.PATID LEFT JOIN mvt m ON f.EVTID = m.EVTID""",
}


def strip(text: str) -> str:
    """Reference prefixes off, wherever they stand."""
    for prefix in ("urn:uuid:", "Patient/", "Encounter/", "Practitioner/", "Location/"):
        text = f"replace({text}, '{prefix}', '')"
    return text


def _uses(name: str, text: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) is not None


def tables(body: str, stripped_text: bool = True) -> str:
    """The query with the expected tables that it names, and those they name, put before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, part in _PARTS.items():
            if _uses(name, text) and name not in needed:
                visit(part)
                if name not in needed:
                    needed.append(name)

    visit(body)
    # Text read from records has lost its reference prefixes; text taken from the table has not.
    value = strip("text") if stripped_text else "text"
    ctes = [f"{n} AS ({_PARTS[n].replace('{text}', value)})" for n in needed]
    own = body.strip()
    if own.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {own[5:]}"
    return f"WITH {', '.join(ctes)} {own}" if ctes else own


def columns(table: str, have: str, prefix: str = "") -> str:
    """All columns of a table; those not in ``have`` are null."""
    known = set(have.split())
    return ", ".join(
        prefix + c if c in known else f"CAST(NULL AS {'BIGINT' if c == 'SEJDUR' else 'VARCHAR'}) AS {c}"
        for c in model.TABLES[table]
    )


HAVE0 = {
    "patient": "PATID PATBD PATAGE PATSEX",
    "mvt": "PATID EVTID ELTID DATENT DATSORT SEJUF SEJUM",
    "biol": "PATID EVTID ELTID PRLVTDATE PNAME ANAME RNAME LOINC RESULT UNIT MINREF MAXREF",
    "pharma": "PATID EVTID ELTID DATPRES PRES ALLSPELABEL ALLUCD13 CAT",
    "doceds": "PATID EVTID ELTID RECTXT RECFAMTXT RECDATE RECTYPE SEJUM",
    "pmsi": "PATID EVTID ELTID DATENT DALL GHM PMSISTATUT CODEACTES",
}
HAVE = {
    "patient": HAVE0["patient"],
    "mvt": HAVE0["mvt"] + " PATAGE PATSEX",
    "biol": HAVE0["biol"] + " SEJUM SEJUF PATAGE PATSEX",
    "pharma": HAVE0["pharma"] + " SEJUM SEJUF DATENT DATSORT PATBD PATAGE PATSEX",
    "doceds": HAVE0["doceds"] + " SEJUF PATBD PATAGE PATSEX",
    "pmsi": HAVE0["pmsi"] + " DATSORT SEJUM SEJUF PATBD PATAGE PATSEX SEJDUR",
}


def whole(table: str, enriched: bool = True, stripped_text: bool = True) -> str:
    """Every column of an expected table."""
    if enriched or table == "patient":
        return tables(f"SELECT {columns(table, HAVE[table])} FROM {table}", stripped_text)
    return tables(f"SELECT {columns(table, HAVE0[table])} FROM {table}0", stripped_text)


# Ids of all tables of a dataset, before enrichment.
ALL_IDS0 = """
    SELECT 'patient' AS "table", PATID, CAST(NULL AS VARCHAR) AS EVTID, CAST(NULL AS VARCHAR) AS ELTID FROM patient
    UNION ALL SELECT 'mvt', PATID, EVTID, ELTID FROM mvt0
    UNION ALL SELECT 'biol', PATID, EVTID, ELTID FROM biol0
    UNION ALL SELECT 'pharma', PATID, EVTID, ELTID FROM pharma0
    UNION ALL SELECT 'doceds', PATID, EVTID, ELTID FROM doceds0
    UNION ALL SELECT 'pmsi', PATID, EVTID, ELTID FROM pmsi0"""

# Records that the tables stand for: one per row and mapped type of its table.
RECORDS = """
    SELECT 'Patient' AS type, 0 AS ord, PATID AS patient_id, CAST(NULL AS VARCHAR) AS stay_id, PATID AS id,
           CAST(NULL AS VARCHAR) AS location_id FROM patient
    UNION ALL SELECT 'Encounter', 1, PATID, EVTID, EVTID, ELTID FROM mvt0
    UNION ALL SELECT 'Observation', 2, PATID, EVTID, ELTID, NULL FROM biol0
    UNION ALL SELECT 'MedicationRequest', 3, PATID, EVTID, ELTID, NULL FROM pharma0
    UNION ALL SELECT 'DiagnosticReport', 4, PATID, EVTID, ELTID, NULL FROM doceds0
    UNION ALL SELECT 'DocumentReference', 5, PATID, EVTID, ELTID, NULL FROM doceds0
    UNION ALL SELECT 'Composition', 6, PATID, EVTID, ELTID, NULL FROM doceds0
    UNION ALL SELECT 'Condition', 7, PATID, EVTID, ELTID, NULL FROM pmsi0
    UNION ALL SELECT 'Procedure', 8, PATID, EVTID, ELTID, NULL FROM pmsi0"""


def members(records: str, group: str, prefix: str) -> str:
    """CTE bodies: entries of bundles by ``group``, location stubs included."""
    return f"""
    rec AS ({records}),
    entry AS (
        SELECT '{prefix}' || {group} AS bundle_id, ord, type, id FROM rec WHERE {group} IS NOT NULL
        UNION ALL
        SELECT DISTINCT '{prefix}' || {group}, -1, 'Location', location_id FROM rec
        WHERE {group} IS NOT NULL AND location_id IS NOT NULL)"""
