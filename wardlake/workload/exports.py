"""Records and bundles from tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlake.functions import ids, records, values
from wardlake.operators import export
from wardlake.operators.filters import Propagate, Where
from wardlake.plans import exporting
from wardlake.session import scratch
from wardlake.sources import bundles as docs
from wardlake.workload import fixtures as fx
from wardlake.workload.expected import RECORDS, members, tables
from wardlake.workload.registry import query

ENTRY = "resource string, request struct<method:string,url:string>"


def _records(spark, sf_dir, *names):
    return export.dataset_to_resources(fx.dataset(spark, sf_dir, *names, wide=True))


def _read(rows, *paths: str):
    """The rows with ``_read``, their record parsed once for all of the paths."""
    return records.parsed(rows, records.pruned_schema(paths), "_read")


def _get(*paths: str):
    return [records.at_path(F.col("_read"), p).alias(p.replace(".", "_").replace("[", "").replace("]", "")) for p in paths]


@query("rows_to_resources", tables(f"SELECT type, ord, id, patient_id, stay_id, location_id FROM ({RECORDS})"))
def rows_to_resources(spark, sf_dir):
    return _records(spark, sf_dir).select("type", "ord", "id", "patient_id", "stay_id", "location_id")


@query(
    "set_path",
    tables(
        """SELECT ELTID AS id, 'Patient/' || PATID AS subject_reference, 'Encounter/' || EVTID AS encounter_reference,
                  ANAME AS code_text, LOINC AS code_coding0_code, RNAME AS code_coding0_display,
                  RESULT AS valueQuantity_value, MINREF AS referenceRange0_low_value,
                  PATID IS NOT NULL AS has_subject, MINREF IS NOT NULL AS has_range FROM biol0"""
    ),
)
def set_path(spark, sf_dir):
    paths = [
        "id", "subject.reference", "encounter.reference", "code.text", "code.coding[0].code",
        "code.coding[0].display", "valueQuantity.value", "referenceRange[0].low.value",
    ]
    return _read(_records(spark, sf_dir, "biol"), *paths).select(
        *_get(*paths),
        F.col("resource").contains('"subject"').alias("has_subject"),
        F.col("resource").contains('"referenceRange"').alias("has_range"),
    )


@query(
    "resource_defaults",
    tables(
        f"""SELECT type, CASE type WHEN 'Encounter' THEN 'finished' WHEN 'Observation' THEN 'final'
                   WHEN 'MedicationRequest' THEN 'active' WHEN 'DiagnosticReport' THEN 'final'
                   WHEN 'DocumentReference' THEN 'current' WHEN 'Procedure' THEN 'completed' END AS status,
                   CASE type WHEN 'MedicationRequest' THEN 'order' END AS intent, count(*) AS n
            FROM ({RECORDS}) GROUP BY ALL"""
    ),
)
def resource_defaults(spark, sf_dir):
    paths = ["status", "intent"]
    found = _read(_records(spark, sf_dir), *paths).select("type", *_get(*paths))
    return found.groupBy("type", "status", "intent").agg(F.count("*").alias("n"))


@query(
    "coerce_values",
    tables(
        """SELECT PATID AS id, CASE PATSEX WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' ELSE 'unknown' END AS gender,
                  PATBD AS "birthDate" FROM patient"""
    ),
)
def coerce_values(spark, sf_dir):
    paths = ["id", "gender", "birthDate"]
    return _read(_records(spark, sf_dir, "patient"), *paths).select(*_get(*paths))


@query(
    "gender_out",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'male' WHEN 'BUILDING' THEN 'female' ELSE 'unknown' END AS gender
       FROM customer""",
)
def gender_out(spark, sf_dir):
    segment = F.col("c_mktsegment")
    raw = F.when(segment == "HOUSEHOLD", " m\n").when(segment == "BUILDING", "F").when(segment == "MACHINERY", "I")
    return fx.customers(spark, sf_dir).select("c_custkey", values.gender_out(raw).alias("gender"))


@query(
    "normalize_fhir_id",
    """SELECT doc_id, left(CASE lang WHEN 'en' THEN 'd' || doc_id WHEN 'fr' THEN 'x' || doc_id ELSE text END, 64) AS id
       FROM (SELECT doc_id, lang, replace(replace(replace(text, '|', ' '), '=', ' '), '?', ' ') AS text FROM documents)""",
)
def normalize_fhir_id(spark, sf_dir):
    lang, doc = F.col("lang"), F.col("doc_id").cast("string")
    free = F.translate("text", "|=?", "   ")
    raw = (
        F.when(lang == "en", F.concat(F.lit("Patient?identifier=http://x|urn:uuid:d"), doc))
        .when(lang == "fr", F.concat(F.lit("Patient?id=Patient/x"), doc)).otherwise(free)
    )
    return fx.table(spark, sf_dir, "documents").select("doc_id", ids.normalize_fhir_id(raw).alias("id"))


@query(
    "stable_id",
    "SELECT o_orderkey, sha1('Encounter|' || o_orderkey || '||' || o_orderpriority) AS id FROM orders",
)
def stable_id(spark, sf_dir):
    parts = [F.lit("Encounter"), F.col("o_orderkey"), F.lit(None), F.col("o_orderpriority")]
    return fx.orders(spark, sf_dir).select("o_orderkey", ids.stable_id(*parts).alias("id"))


@query(
    "fallback_id",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN sha1('Location/') WHEN 'O' THEN sha1('T|' || o_orderkey || '|O')
              ELSE 'e' || o_orderkey END AS id FROM orders""",
)
def fallback_id(spark, sf_dir):
    status = F.col("o_orderstatus")
    raw = F.when(status == "F", "Location/").when(status == "P", fx.text("Encounter/e", "o_orderkey"))
    return fx.orders(spark, sf_dir).select(
        "o_orderkey", ids.fallback_id(raw, F.lit("T"), F.col("o_orderkey"), status).alias("id")
    )


@query(
    "build_references",
    tables(
        """SELECT EVTID AS id, 'Patient/' || PATID AS subject_reference,
                  'Location/' || ELTID AS location0_location_reference, SEJUF AS location0_location_display FROM mvt0"""
    ),
)
def build_references(spark, sf_dir):
    paths = ["id", "subject.reference", "location[0].location.reference", "location[0].location.display"]
    return _read(_records(spark, sf_dir, "mvt"), *paths).select(*_get(*paths))


@query("patient_of_resource", tables(f"SELECT type, id, patient_id FROM ({RECORDS}) WHERE patient_id IS NOT NULL"))
def patient_of_resource(spark, sf_dir):
    shape = "id string, subject struct<reference:string>, patient struct<reference:string>"
    read = records.parsed(_records(spark, sf_dir), shape, "r").drop("id", "patient_id")
    owner = ids.patient_of_reference(F.col("r.subject.reference"), F.col("r.patient.reference"))
    owner = F.when(F.col("type") == "Patient", F.col("r.id")).otherwise(owner)
    return read.select("type", F.col("r.id").alias("id"), owner.alias("patient_id")).filter("patient_id IS NOT NULL")


def _flat(lines):
    """Entries of bundles in their order, read back from their JSON."""
    read = F.from_json(F.ltrim("value", F.lit(",")), ENTRY)
    entries = lines.filter("kind = 'entry'").select("bundle_id", "ord", "id", read["request"]["url"].alias("url"))
    pos = F.row_number().over(W.partitionBy("bundle_id").orderBy("ord", "id")).cast("bigint") - 1
    return entries.select("bundle_id", pos.alias("pos"), "url")


def _bundle_sql(group: str, prefix: str) -> str:
    return tables(
        f"""WITH {members(RECORDS, group, prefix)}
            SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY ord, id) - 1 AS pos, type || '/' || id AS url
            FROM entry"""
    )


@query("bundle_by_patient", _bundle_sql("patient_id", "patient-"))
def bundle_by_patient(spark, sf_dir):
    return _flat(exporting.dataset_bundles(fx.dataset(spark, sf_dir, again=True)))


@query("bundle_by_encounter", _bundle_sql("stay_id", "encounter-"))
def bundle_by_encounter(spark, sf_dir):
    return _flat(exporting.dataset_bundles(fx.dataset(spark, sf_dir, again=True), "encounter"))


@query(
    "dedupe_resources",
    tables(
        """SELECT 'patient-' || PATID AS bundle_id, 'Encounter' AS type, EVTID AS id,
                  CASE WHEN DATENT < '1998' THEN 0 ELSE 1 END AS ord FROM mvt0"""
    ),
)
def dedupe_resources(spark, sf_dir):
    """Two batches that overlap: of records in both, the first batch's stays."""
    mvt = fx.dataset(spark, sf_dir, "mvt")["mvt"]
    batches = [
        export.rows_to_resources(mvt.filter(part), "mvt").withColumn("ord", F.lit(ord))
        for ord, part in enumerate(["DATENT < '1998'", "DATENT > '1996'"])
    ]
    both = export.grouped(batches[0].unionByName(batches[1]))
    return export.dedupe_resources(both).select("bundle_id", "type", "id", "ord")


@query(
    "location_stubs",
    tables(
        """SELECT DISTINCT 'patient-' || PATID AS bundle_id, ELTID AS id, 'Auto-generated Location ' || ELTID AS name,
                  'active' AS status FROM mvt0"""
    ),
)
def location_stubs(spark, sf_dir):
    paths = ["name", "status"]
    stubs = _read(export.location_stubs(_records(spark, sf_dir, "mvt")), *paths)
    return stubs.select("bundle_id", "id", *_get(*paths))


@query(
    "transaction_entries",
    tables(
        """SELECT 'patient-' || PATID AS bundle_id, 'PUT' AS method, 'MedicationRequest/' || ELTID AS url,
                  ELTID AS id, ALLSPELABEL AS label FROM pharma0"""
    ),
)
def transaction_entries(spark, sf_dir):
    rows = export.transaction_entries(export.bundle_members(_records(spark, sf_dir, "pharma")))
    shape = "resource struct<id:string,medicationCodeableConcept:struct<text:string>>, request struct<method:string,url:string>"
    read = rows.select("bundle_id", F.from_json("entry", shape).alias("e"))
    return read.select(
        "bundle_id", "e.request.method", "e.request.url", "e.resource.id",
        F.col("e.resource.medicationCodeableConcept.text").alias("label"),
    )


@query(
    "export_summary",
    tables(
        f"""WITH rec AS ({RECORDS}) SELECT type AS item, count(*) AS n FROM rec GROUP BY 1
            UNION ALL SELECT 'Bundle', count(DISTINCT patient_id) FROM rec"""
    ),
)
def export_summary(spark, sf_dir):
    return export.export_summary(_records(spark, sf_dir))


@query(
    "bundle_size_stats",
    tables(
        """WITH size AS (
               SELECT strlen('{"resourceType":"Bundle","type":"transaction","id":"patient-' || PATID || '","entry":[{"resource":'
                   || '{"resourceType":"Patient","id":"' || PATID || '"' || coalesce(',"birthDate":"' || PATBD || '"', '')
                   || ',"gender":"' || CASE PATSEX WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' ELSE 'unknown' END || '"}'
                   || ',"request":{"method":"PUT","url":"Patient/' || PATID || '"}}]}') AS n FROM patient)
           SELECT count(*) AS n_bundles, CAST(sum(n) AS BIGINT) AS total_bytes, CAST(sum(n) // count(*) AS BIGINT) AS avg_bytes,
                  CAST(min(n) AS BIGINT) AS min_bytes, CAST(max(n) AS BIGINT) AS max_bytes FROM size"""
    ),
)
def bundle_size_stats(spark, sf_dir):
    return export.bundle_size_stats(export.bundle_by_patient(_records(spark, sf_dir, "patient")))


@query(
    "write_bundles",
    tables(
        f"""WITH {members(RECORDS, 'patient_id', 'patient-')}
            SELECT bundle_id, count(*) AS n_entries FROM entry GROUP BY 1"""
    ),
)
def write_bundles(spark, sf_dir):
    folder = scratch(spark, "bundles-out")
    docs.write_bundles(exporting.dataset_bundles(fx.dataset(spark, sf_dir, again=True)), folder, **docs.PACKED)
    return export.entry_counts(docs.read_bundles(spark, folder))


@query(
    "filter_then_export",
    tables(
        f"""WITH keep AS (SELECT PATID FROM patient WHERE PATAGE > 50 AND PATSEX = 'F'),
            {members(f"SELECT * FROM ({RECORDS}) WHERE patient_id IN (SELECT PATID FROM keep)", 'patient_id', 'patient-')}
            SELECT bundle_id, count(*) AS n_entries FROM entry GROUP BY 1"""
    ),
)
def filter_then_export(spark, sf_dir):
    bundles = exporting.filter_then_export(
        fx.dataset(spark, sf_dir, again=True),
        [Where("patient", "PATAGE", ">", 50), Where("patient", "PATSEX", "==", "F")],
        [Propagate("PATID", "patient")],
    )
    return export.entry_counts(bundles)
