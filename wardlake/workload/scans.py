"""Sources, sinks, routing and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.functions import ids, records, values
from wardlake.operators import browse, enrich, extract
from wardlake.session import scratch
from wardlake.sources import bundles as docs
from wardlake.sources import tables as store
from wardlake.workload import fixtures as fx
from wardlake.workload.expected import LINE_ID, STAY_END, iso, strip, tables, whole
from wardlake.workload.registry import query

_BUNDLES = """
    SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem)
         + (SELECT count(*) FROM documents) + (SELECT count(*) FROM nation) AS n"""

# Ids as they stand in the records of the bundles.
_RAW_IDS = f"""
    SELECT 'Patient' AS resource_type, 'p' || c_custkey AS id FROM customer
    UNION ALL SELECT 'Encounter', 'urn:uuid:e' || o_orderkey FROM orders
    UNION ALL SELECT 'Condition', 'c' || o_orderkey FROM orders
    UNION ALL SELECT 'Procedure', 'r' || o_orderkey FROM orders
    UNION ALL SELECT 'Observation', 'o' || {LINE_ID} FROM lineitem
    UNION ALL SELECT 'MedicationRequest', 'm' || {LINE_ID} FROM lineitem
    UNION ALL SELECT CASE lang WHEN 'en' THEN 'DiagnosticReport' WHEN 'fr' THEN 'DocumentReference'
                     ELSE 'Composition' END, 'd' || doc_id FROM documents
    UNION ALL SELECT 'Organization', 'n' || n_nationkey FROM nation"""


@query(
    "scan_bundles",
    f"""SELECT CAST((SELECT n FROM ({_BUNDLES})) AS BIGINT) AS ok_documents,
               CAST((SELECT count(*) FROM region) AS BIGINT) AS empty_documents,
               CAST((SELECT count(*) FROM supplier) AS BIGINT) AS malformed_documents""",
)
def scan_bundles(spark, sf_dir):
    folder = scratch(spark, "bundles")
    fx.bundles(spark, sf_dir).select("value").write.options(**docs.PACKED).text(folder)
    status = docs.read_status(F.col("value"))
    read = docs.scan_bundles(spark, folder, per_line=True, pattern="*.txt.gz").select(status.alias("status"))
    return read.agg(
        F.count_if(F.col("status") == "ok").alias("ok_documents"),
        F.count_if(F.col("status") == "no_entry").alias("empty_documents"),
        F.count_if(F.col("status") == "malformed").alias("malformed_documents"),
    )


@query("bundle_entries", _RAW_IDS)
def bundle_entries(spark, sf_dir):
    entries = extract.bundle_entries(fx.bundles(spark, sf_dir))
    return entries.select("resource_type", records.json_path(F.col("resource"), "id").alias("id"))


@query(
    "scan_warnings",
    f"""SELECT 'patient-' || c_custkey AS file, 'ok' AS status FROM customer
        UNION ALL SELECT 'stay-' || o_orderkey, 'ok' FROM orders
        UNION ALL SELECT 'line-' || {LINE_ID}, 'ok' FROM lineitem
        UNION ALL SELECT 'document-' || doc_id, 'ok' FROM documents
        UNION ALL SELECT 'nation-' || n_nationkey, 'ok' FROM nation
        UNION ALL SELECT 'region-' || r_regionkey, 'no_entry' FROM region
        UNION ALL SELECT 'supplier-' || s_suppkey, 'malformed' FROM supplier""",
)
def scan_warnings(spark, sf_dir):
    return docs.scan_warnings(fx.bundles(spark, sf_dir).withColumnRenamed("name", "file"))


@query(
    "paged_bundles",
    """SELECT 'p' || o_custkey || '/e' || o_orderkey AS request_id, page_no, pos, resource_type, id FROM (
           SELECT *, 1 AS page_no, CAST(0 AS BIGINT) AS pos, 'Encounter' AS resource_type, 'urn:uuid:e' || o_orderkey AS id FROM orders
           UNION ALL SELECT *, 1, 1, 'Condition', 'c' || o_orderkey FROM orders
           UNION ALL SELECT *, 2, 0, 'Procedure', 'r' || o_orderkey FROM orders)""",
)
def paged_bundles(spark, sf_dir):
    pages = F.array(
        F.struct(F.lit(1).alias("page_no"), fx.bundle_of(fx.encounter_record(), fx.condition_record()).alias("value")),
        F.struct(F.lit(2).alias("page_no"), fx.bundle_of(fx.procedure_record()).alias("value")),
    )
    request = F.concat(F.lit("p"), F.col("o_custkey"), F.lit("/e"), F.col("o_orderkey"))
    saved = fx.orders(spark, sf_dir).select(request.alias("request_id"), F.inline(pages))
    return docs.paged_bundles(saved).select(
        "request_id", "page_no", "pos", "resource_type", records.json_path(F.col("resource"), "id").alias("id")
    )


@query(
    "scan_table",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders",
)
def scan_table(spark, sf_dir):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    return store.scan_table(spark, sf_dir, "orders").select(columns)


_GIVEN = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
    "orders", "pages", "part", "region", "supplier",
]


@query("scan_dataset", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in _GIVEN))
def scan_dataset(spark, sf_dir):
    return browse.snapshot_counts(store.scan_dataset(spark, sf_dir), spark)


@query("write_table", whole("mvt", enriched=False))
def write_table(spark, sf_dir):
    folder = scratch(spark, "write-table")
    store.write_table(fx.dataset(spark, sf_dir, "mvt")["mvt"], folder, "mvt")
    return store.scan_table(spark, folder, "mvt")


@query(
    "route_resources",
    f"""SELECT resource_type, "table", count(*) AS n FROM (
            SELECT resource_type, CASE resource_type WHEN 'Patient' THEN 'patient' WHEN 'Encounter' THEN 'mvt'
                WHEN 'Observation' THEN 'biol' WHEN 'MedicationRequest' THEN 'pharma' WHEN 'Condition' THEN 'pmsi'
                WHEN 'Procedure' THEN 'pmsi' WHEN 'Organization' THEN NULL ELSE 'doceds' END AS "table" FROM ({_RAW_IDS}))
        WHERE "table" IS NOT NULL GROUP BY ALL""",
)
def route_resources(spark, sf_dir):
    routed = extract.route_resources(fx.resources(spark, sf_dir))
    return routed.groupBy("resource_type", "table").agg(F.count("*").alias("n"))


@query(
    "json_path",
    """SELECT event_id, regexp_extract(props, '"k": ?([0-9]+)', 1) AS k, CAST(NULL AS VARCHAR) AS absent,
              CAST(NULL AS VARCHAR) AS nothing FROM events""",
)
def json_path(spark, sf_dir):
    props = F.col("props")
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        records.json_path(props, "k").alias("k"),
        records.json_path(props, "k[0].x").alias("absent"),
        records.json_path(props, "").alias("nothing"),
    )


_MARKED = "('Patient/' || text || ' see Location/l' || doc_id || ' urn:uuid:Encounter/e' || doc_id)"


@query("strip_ref_prefix", f"SELECT doc_id, {strip(_MARKED)} AS stripped FROM documents")
def strip_ref_prefix(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    marked = F.concat(
        F.lit("Patient/"), F.col("text"), F.lit(" see Location/l"), doc, F.lit(" urn:uuid:Encounter/e"), doc
    )
    return fx.table(spark, sf_dir, "documents").select("doc_id", ids.strip_ref_prefix(marked).alias("stripped"))


@query(
    "stringify_nested",
    """SELECT o_orderkey, '{"text":"' || o_orderpriority || '","coding":[{"code":"' || o_orderstatus || '"}]}' AS code
       FROM orders""",
)
def stringify_nested(spark, sf_dir):
    schema = "id string, code struct<text:string, coding:array<struct<code:string>>>"
    read = fx.resources(spark, sf_dir, "Condition").select(F.from_json("resource", schema).alias("r"))
    return read.select(
        F.substring("r.id", 2, 20).cast("bigint").alias("o_orderkey"), records.stringify_nested(F.col("r.code")).alias("code")
    )


@query(
    "normalize_typed",
    """SELECT o_orderkey, o_custkey AS first_item, TRY_CAST(left(o_orderpriority, 1) AS BIGINT) AS rank,
              CAST(NULL AS BIGINT) AS failed, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
              '{"s":"' || o_orderstatus || '"}' AS nested, TRUE AS filled
       FROM orders""",
)
def normalize_typed(spark, sf_dir):
    text = T.StringType()
    nested = T.StructType([T.StructField("s", text)])
    return fx.orders(spark, sf_dir).select(
        "o_orderkey",
        values.normalize_typed(F.array("o_custkey", "o_orderkey"), T.ArrayType(T.LongType()), "bigint").alias("first_item"),
        values.normalize_typed(F.left("o_orderpriority", F.lit(1)), text, "bigint").alias("rank"),
        values.normalize_typed(F.col("o_orderpriority"), text, "bigint").alias("failed"),
        values.normalize_typed(F.col("o_totalprice"), T.DoubleType(), "bigint").alias("whole"),
        values.normalize_typed(F.struct(F.col("o_orderstatus").alias("s")), nested, "string").alias("nested"),
        values.normalize_typed(F.col("o_orderstatus"), text, "boolean").alias("filled"),
    )


# Raw ids in the forms that occur, by order priority.
_FORMS_SQL = """
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'urn:uuid:e' || o_orderkey WHEN '2' THEN 'urn:oid:e' || o_orderkey
         WHEN '3' THEN 'Encounter/e' || o_orderkey WHEN '4' THEN 'http://x|y|e' || o_orderkey ELSE 'e' || o_orderkey END"""


def _forms():
    key = F.col("o_orderkey").cast("string")
    first = F.left("o_orderpriority", F.lit(1))
    return (
        F.when(first == "1", F.concat(F.lit("urn:uuid:e"), key)).when(first == "2", F.concat(F.lit("urn:oid:e"), key))
        .when(first == "3", F.concat(F.lit("Encounter/e"), key)).when(first == "4", F.concat(F.lit("http://x|y|e"), key))
        .otherwise(F.concat(F.lit("e"), key))
    )


@query("clean_ids", "SELECT o_orderkey, 'e' || o_orderkey AS id FROM orders")
def clean_ids(spark, sf_dir):
    return fx.orders(spark, sf_dir).select("o_orderkey", ids.clean_ids(_forms()).alias("id"))


@query(
    "clean_id",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN left(o_orderpriority, 1) IN ('1', '3')
             THEN 'e' || o_orderkey ELSE {_FORMS_SQL} END AS id FROM orders""",
)
def clean_id(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 7 != 0, _forms())
    return fx.orders(spark, sf_dir).select("o_orderkey", ids.clean_id(raw).alias("id"))


@query(
    "normalize_sex",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'M' WHEN 'BUILDING' THEN 'F' ELSE 'I' END AS sex FROM customer",
)
def normalize_sex(spark, sf_dir):
    return fx.customers(spark, sf_dir).select("c_custkey", values.normalize_sex(fx.gender()).alias("sex"))


@query(
    "compute_age",
    tables(
        """SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 THEN
               CAST(date_diff('year', born, DATE '2024-06-15')
                    - CASE WHEN strftime(born, '%m%d') > '0615' THEN 1 ELSE 0 END AS INTEGER) END AS age FROM people"""
    ),
)
def compute_age(spark, sf_dir):
    timed = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(fx.birth_date(), F.lit("T08:30:00"))).otherwise(fx.birth_date())
    return fx.customers(spark, sf_dir).select("c_custkey", values.compute_age(timed, fx.AS_OF).alias("age"))


@query(
    "default_unit",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Hôpital Indéterminé' ELSE o_orderpriority END AS unit FROM orders",
)
def default_unit(spark, sf_dir):
    unit = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    return fx.orders(spark, sf_dir).select("o_orderkey", values.default_unit(unit).alias("unit"))


@query(
    "stay_duration",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey % 12 END AS BIGINT) AS days,
              CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE -(o_orderkey % 12) END AS BIGINT) AS back,
              CAST(0 AS BIGINT) AS unreadable FROM orders""",
)
def stay_duration(spark, sf_dir):
    start, end = fx.iso(F.col("o_orderdate")), F.replace(fx.stay_end(), F.lit("+01:00"), F.lit("-05:00"))
    return fx.orders(spark, sf_dir).select(
        "o_orderkey",
        values.stay_duration(start, end).alias("days"),
        values.stay_duration(end, start).alias("back"),
        values.stay_duration(start, F.col("o_orderpriority")).alias("unreadable"),
    )


@query("enforce_schema", whole("pmsi", enriched=False))
def enforce_schema(spark, sf_dir):
    wide = extract.union_resource_types(fx.resources(spark, sf_dir, "Condition", "Procedure"), "pmsi")
    return extract.enforce_schema(wide.withColumn("EXTRA", F.lit("dropped")), "pmsi")


@query(
    "coalesce_fill",
    f"""SELECT o_orderkey, coalesce({STAY_END}, {iso('o_orderdate')}) AS DATSORT FROM orders""",
)
def coalesce_fill(spark, sf_dir):
    df = fx.orders(spark, sf_dir).select(
        "o_orderkey", fx.stay_end().alias("DATSORT"), fx.iso(F.col("o_orderdate")).alias("DATSORT_other")
    )
    return enrich.coalesce_fill(enrich.coalesce_fill(df, "DATSORT", "DATSORT_other"), "DATSORT", "absent")


@query(
    "coding_by_system",
    f"""SELECT 'o' || {LINE_ID} AS id, CAST(l_partkey AS VARCHAR) AS loinc, CAST(NULL AS VARCHAR) AS other FROM lineitem""",
)
def coding_by_system(spark, sf_dir):
    parsed = F.from_json("resource", "id string, code struct<coding:array<struct<system:string,code:string>>>")
    read = fx.resources(spark, sf_dir, "Observation").select(parsed.alias("r"))
    return read.select(
        F.col("r.id").alias("id"),
        records.coding_by_system(F.col("r.code.coding"), fx.LOINC).alias("loinc"),
        records.coding_by_system(F.col("r.code.coding"), "http://snomed.info/sct").alias("other"),
    )


@query(
    "fhir_date",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
              ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END AS at,
              CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS text FROM events""",
)
def fhir_date(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return events.select(
        "event_id",
        values.fhir_date(F.col("ts"), events.schema["ts"].dataType).alias("at"),
        values.fhir_date(text).alias("text"),
    )


@query("encode_base64", "SELECT doc_id, to_base64(encode(text)) AS data FROM documents")
def encode_base64(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", values.encode_base64(F.col("text")).alias("data"))


@query(
    "xhtml_div",
    """SELECT doc_id, CASE WHEN lang = 'fr' THEN '<DIV>' || trim(text, E' \\t\\n\\r\\f\\x0b') || '</DIV>'
              ELSE '<div xmlns="http://www.w3.org/1999/xhtml">' || trim(text, E' \\t\\n\\r\\f\\x0b') || '</div>' END AS div
       FROM documents""",
)
def xhtml_div(spark, sf_dir):
    body = F.trim("text", F.lit(" \t\n\r\f\x0b"))
    raw = F.when(F.col("lang") == "fr", F.concat(F.lit(" \n<DIV>"), body, F.lit("</DIV> "))).otherwise(F.col("text"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", values.xhtml_div(raw).alias("div"))


@query(
    "clip_cell",
    """SELECT doc_id, CASE WHEN length(text) > 40 THEN left(translate(text, E'\\n\\r', '  '), 39) || '…'
              ELSE translate(text, E'\\n\\r', '  ') END AS cell,
              translate(text, E'\\n\\r', '  ') AS line, '' AS nothing FROM documents""",
)
def clip_cell(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        values.clip_cell(F.col("text"), 40).alias("cell"),
        values.clip_cell(F.col("text"), 0).alias("line"),
        values.clip_cell(F.lit(None).cast("string"), 5).alias("nothing"),
    )


@query(
    "patient_display",
    tables(
        """SELECT 'p' || c_custkey AS id, c_name AS family, c_mktsegment AS given, coalesce(PATBD, 'N/A') AS birth,
                  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'male' WHEN 'BUILDING' THEN 'female' WHEN 'MACHINERY' THEN 'other'
                       WHEN 'FURNITURE' THEN 'unknown' ELSE 'N/A' END AS gender
           FROM customer JOIN patient ON PATID = 'p' || c_custkey"""
    ),
)
def patient_display(spark, sf_dir):
    shape = "id string, birthDate string, gender string, name array<struct<family:string,given:array<string>>>"
    read = fx.resources(spark, sf_dir, "Patient").select(F.from_json("resource", shape).alias("p"))
    return read.select(*records.patient_display(F.col("p")))
