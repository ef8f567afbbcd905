"""Health records derived from the given tables; see FIXTURES.md.

Every record is built from whole tables with plain expressions. Each source row becomes one bundle with
its records, so building bundles needs no grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardlake import model
from wardlake.functions import values
from wardlake.operators import enrich
from wardlake.operators.extract import enforce_schema, extract_table
from wardlake.session import spread, stored
from wardlake.sources.tables import CODEC

AS_OF = "2024-06-15"
LOINC = "http://loinc.org"
OFFSET = "+01:00"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the files once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _source(spark: SparkSession, sf_dir: str, name: str, wide: bool) -> DataFrame:
    """A given table; ``wide`` where costly work per row follows, see ``spread``."""
    given = table(spark, sf_dir, name)
    return spread(given) if wide else given


def iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(OFFSET))


def text(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), *[p if isinstance(p, Column) else F.col(p) for p in parts])


def ref(prefix: str, *parts) -> Column:
    return F.struct(text(prefix, *parts).alias("reference"))


def one(*fields) -> Column:
    """Array of one struct."""
    return F.array(F.struct(*fields))


def record(record_type: str, *fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(record_type).alias("resourceType"), *fields))


def customers(spark, sf_dir, wide=False):
    return _source(spark, sf_dir, "customer", wide)


def gender() -> Column:
    return (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "male").when(F.col("c_mktsegment") == "BUILDING", "female")
        .when(F.col("c_mktsegment") == "MACHINERY", "other").when(F.col("c_mktsegment") == "FURNITURE", "unknown")
    )


def birth_date() -> Column:
    """A full date, a year alone, or none."""
    born = F.date_add(F.lit("1930-01-01").cast("date"), (F.col("c_custkey") * 37 % 30000).cast("int"))
    return (
        F.when(F.col("c_custkey") % 17 == 0, F.lit(None)).when(F.col("c_custkey") % 19 == 0, F.date_format(born, "yyyy"))
        .otherwise(F.date_format(born, "yyyy-MM-dd"))
    )


def patient_record() -> Column:
    return record(
        "Patient",
        text("p", "c_custkey").alias("id"),
        birth_date().alias("birthDate"),
        gender().alias("gender"),
        one(F.col("c_name").alias("family"), F.array("c_mktsegment").alias("given")).alias("name"),
    )


def orders(spark, sf_dir, wide=False):
    return _source(spark, sf_dir, "orders", wide)


def stay_end() -> Column:
    k = F.col("o_orderkey")
    return F.when(k % 13 != 0, iso(F.col("o_orderdate") + F.make_dt_interval((k % 12).cast("int"))))


def encounter_record() -> Column:
    k = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "in-progress")
        .otherwise("planned")
    )
    period = F.struct(iso(F.col("o_orderdate")).alias("start"), stay_end().alias("end"))
    place = F.struct(text("Location/l", k % 50).alias("reference"), text("UF", k % 50).alias("display"))
    return record(
        "Encounter",
        text("urn:uuid:e", k).alias("id"),
        status.alias("status"),
        ref("Patient/p", "o_custkey").alias("subject"),
        period.alias("period"),
        one(place.alias("location")).alias("location"),
        F.when(k % 7 != 0, F.struct(F.col("o_orderpriority").alias("display"))).alias("serviceProvider"),
    )


def condition_record() -> Column:
    k = F.col("o_orderkey")
    active = F.when(F.col("o_orderstatus") == "O", F.struct(one(F.lit("active").alias("code")).alias("coding")))
    return record(
        "Condition",
        text("c", k).alias("id"),
        ref("Patient/p", "o_custkey").alias("subject"),
        ref("Encounter/e", k).alias("encounter"),
        F.struct(F.col("o_orderpriority").alias("text"), one(F.col("o_orderstatus").alias("code")).alias("coding")).alias("code"),
        active.alias("clinicalStatus"),
        iso(F.col("o_orderdate")).alias("recordedDate"),
    )


def procedure_record() -> Column:
    k = F.col("o_orderkey")
    return record(
        "Procedure",
        text("r", k).alias("id"),
        ref("Patient/p", "o_custkey").alias("subject"),
        ref("Encounter/e", k).alias("encounter"),
        F.struct(one(text("A", k % 20).alias("code")).alias("coding")).alias("code"),
        F.struct(iso(F.col("o_orderdate")).alias("start")).alias("performedPeriod"),
    )


def lines(spark, sf_dir, wide=False):
    """Line items with the customer of their order and the part they name.

    The joins deal the rows out, small inputs too, and hash the smaller side; sorts of all line items would hold far more.
    """
    owner = orders(spark, sf_dir).select("o_orderkey", "o_custkey").hint("shuffle_hash")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand").hint("shuffle_hash")
    item = table(spark, sf_dir, "lineitem")
    joined = item.join(owner, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")


#: What the tables of a dataset take from line items.
LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus",
    "o_custkey", "p_name", "p_type", "p_brand",
]


def stored_lines(spark, sf_dir) -> DataFrame:
    """``lines``, joined once and stored, for jobs that read them several times. Eager."""
    return stored(lines(spark, sf_dir).select(*LINE_COLUMNS), "lines", compression=CODEC)


def line_id() -> Column:
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("-", *parts, F.date_format("l_shipdate", "yyyyMMdd"))


def observation_record() -> Column:
    limits = one(
        F.struct(F.lit(10).alias("value")).alias("low"), F.struct(F.lit(40).alias("value")).alias("high")
    )
    code = F.struct(
        text("test-", "l_returnflag").alias("text"),
        one(
            F.lit(LOINC).alias("system"), F.col("l_partkey").cast("string").alias("code"),
            F.concat("l_returnflag", "l_linestatus").alias("display"),
        ).alias("coding"),
    )
    return record(
        "Observation",
        text("o", line_id()).alias("id"),
        F.when(F.col("l_linestatus") == "F", "final").otherwise("preliminary").alias("status"),
        F.when(F.col("l_partkey") % 11 != 0, ref("Patient/p", "o_custkey")).alias("subject"),
        ref("Encounter/e", "l_orderkey").alias("encounter"),
        iso(F.col("l_shipdate")).alias("effectiveDateTime"),
        code.alias("code"),
        F.struct(F.col("l_quantity").alias("value"), F.lit("g").alias("unit")).alias("valueQuantity"),
        F.when(F.col("l_linenumber") != 7, limits).alias("referenceRange"),
    )


def medication_record() -> Column:
    return record(
        "MedicationRequest",
        text("m", line_id()).alias("id"),
        ref("Patient/p", "o_custkey").alias("subject"),
        ref("Encounter/e", "l_orderkey").alias("encounter"),
        iso(F.col("l_shipdate")).alias("authoredOn"),
        one(F.col("p_type").alias("text")).alias("dosageInstruction"),
        F.struct(
            F.col("p_name").alias("text"), one(F.col("l_partkey").cast("string").alias("code")).alias("coding")
        ).alias("medicationCodeableConcept"),
        one(F.col("p_brand").alias("text")).alias("category"),
    )


def documents(spark, sf_dir, wide=False):
    """Documents with the order of the same number."""
    owner = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate")
    return _source(spark, sf_dir, "documents", wide).join(owner, F.col("doc_id") == F.col("o_orderkey"), "left")


def document_type() -> Column:
    return (
        F.when(F.col("lang") == "en", "DiagnosticReport").when(F.col("lang") == "fr", "DocumentReference")
        .otherwise("Composition")
    )


def document_record() -> Column:
    stay = ref("Encounter/e", "doc_id")
    common = [text("d", "doc_id").alias("id"), F.when(F.col("o_custkey").isNotNull(), ref("Patient/p", "o_custkey")).alias("subject")]
    kind = one(one(F.col("lang").alias("display")).alias("coding"))
    day = iso(F.col("o_orderdate"))
    report = record(
        "DiagnosticReport", *common, stay.alias("encounter"), day.alias("effectiveDateTime"),
        one(F.col("text").alias("data")).alias("presentedForm"), kind.alias("category"),
    )
    reference = record(
        "DocumentReference", *common, F.struct(stay.alias("encounter")).alias("context"), day.alias("date"),
        one(F.col("text").alias("data")).alias("content"), kind.alias("category"),
        F.struct(F.col("source").alias("display")).alias("custodian"),
    )
    composition = record(
        "Composition", *common, stay.alias("encounter"), day.alias("date"),
        F.struct(F.col("lang").alias("text")).alias("type"), F.struct(F.col("text").alias("div")).alias("text"),
        one(F.struct(F.col("source").alias("div")).alias("text")).alias("section"),
    )
    return F.when(F.col("lang") == "en", report).when(F.col("lang") == "fr", reference).otherwise(composition)


def organization_record() -> Column:
    """A type that the mapping does not know."""
    return record("Organization", text("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"))


_SOURCES = {
    "Patient": (customers, patient_record),
    "Encounter": (orders, encounter_record),
    "Observation": (lines, observation_record),
    "MedicationRequest": (lines, medication_record),
    "Condition": (orders, condition_record),
    "Procedure": (orders, procedure_record),
    "Organization": (lambda spark, sf_dir, wide: table(spark, sf_dir, "nation"), organization_record),
}
DOCUMENT_TYPES = ["DiagnosticReport", "DocumentReference", "Composition"]
ALL_TYPES = [*_SOURCES, *DOCUMENT_TYPES]


def resources(spark: SparkSession, sf_dir: str, *types: str, again: bool = False) -> DataFrame:
    """(resource_type, resource) of the named types, default all. A filter on the type leaves only its source to be read.

    ``again``: the joins of the line items are stored (eager), so that nothing of them is held while the records are shuffled.
    """
    chosen = types or ALL_TYPES
    parts = []
    for t in chosen:
        if t in _SOURCES:
            load, build = _SOURCES[t]
            rows = stored_lines(spark, sf_dir) if again and load is lines else load(spark, sf_dir, True)
            parts.append(rows.select(F.lit(t).alias("resource_type"), build().alias("resource")))
    if any(t in DOCUMENT_TYPES for t in chosen):
        docs = documents(spark, sf_dir, True).select(document_type().alias("resource_type"), document_record().alias("resource"))
        parts.append(docs.filter(F.col("resource_type").isin(list(chosen))))
    return reduce(DataFrame.unionByName, parts)


def all_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``resources`` of all types, for jobs that read each of them.

    The rows of a source give all of their records at once, so every source is read, and its joins are done, once.
    """
    by_source: dict = {}
    for t, (load, build) in _SOURCES.items():
        by_source.setdefault(load, []).append(build().alias(t))
    parts = []
    for load, built in by_source.items():
        rows = load(spark, sf_dir, True).select(*built)
        # Made in a projection of their own, where what they share (ids, dates) is made once.
        each = [F.struct(F.lit(t).alias("resource_type"), F.col(t).alias("resource")) for t in rows.columns]
        parts.append(rows.select(F.inline(F.array(*each))))
    return reduce(DataFrame.unionByName, [*parts, resources(spark, sf_dir, *DOCUMENT_TYPES)])


BUNDLE_KINDS = ["patient", "stay", "line", "document", "nation", "region", "supplier"]


def bundle_of(*entries: Column) -> Column:
    """Collection bundle around records that are JSON text already."""
    items = [F.concat(F.lit('{"resource":'), e, F.lit("}")) for e in entries]
    return F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.concat_ws(",", *items), F.lit("]}"))


def bundles(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(name, value): one bundle per source row. Regions give bundles without entries, part types no JSON at all.

    ``kinds``: beginnings of the names, default all; the sources of other bundles are not read.
    """
    chosen = kinds or BUNDLE_KINDS

    def of(rows: DataFrame, kind: str, key: Column | str, value: Column) -> DataFrame:
        return rows.select(text(f"{kind}-", key).alias("name"), value.alias("value"))

    makers = {
        "patient": lambda: of(customers(spark, sf_dir, True), "patient", "c_custkey", bundle_of(patient_record())),
        "stay": lambda: of(
            orders(spark, sf_dir, True), "stay", "o_orderkey", bundle_of(encounter_record(), condition_record(), procedure_record())
        ),
        "line": lambda: of(lines(spark, sf_dir, True), "line", line_id(), bundle_of(observation_record(), medication_record())),
        "document": lambda: of(documents(spark, sf_dir, True), "document", "doc_id", bundle_of(document_record())),
        "nation": lambda: of(table(spark, sf_dir, "nation"), "nation", "n_nationkey", bundle_of(organization_record())),
        "region": lambda: of(
            table(spark, sf_dir, "region"), "region", "r_regionkey", F.lit('{"resourceType":"Bundle","type":"collection"}')
        ),
        "supplier": lambda: of(
            table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", F.concat(F.lit('{"resourceType":'), "s_name")
        ),
    }
    return reduce(DataFrame.unionByName, [makers[k]() for k in BUNDLE_KINDS if k in chosen])


def extracted(spark: SparkSession, sf_dir: str, name: str, again: bool = False) -> DataFrame:
    """A table as it is before enrichment, read from its records."""
    return extract_table(resources(spark, sf_dir, *model.types_of_table(name), again=again), name, as_of=AS_OF)


def imported(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Tables read from their records and enriched; only the named ones are built. Patients and stays are stored for facts (eager)."""
    facts = bool(set(names) - {"patient", "mvt"})

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, compression=CODEC) if facts else df

    patient = kept(extracted(spark, sf_dir, "patient"), "patient")
    mvt = kept(enrich.enrich_patient_mvt(extracted(spark, sf_dir, "mvt"), patient), "mvt")
    ready = {"patient": patient, "mvt": mvt}
    return {
        n: ready[n] if n in ready else enrich.enrich_table(extracted(spark, sf_dir, n, again=True), n, patient, mvt) for n in names
    }


def _patient(spark, sf_dir, wide):
    born = birth_date()
    return customers(spark, sf_dir, wide).select(
        text("p", "c_custkey").alias("PATID"), born.alias("PATBD"), values.compute_age(born, AS_OF).alias("PATAGE"),
        values.normalize_sex(gender()).alias("PATSEX"),
    )


def _mvt(spark, sf_dir, wide):
    k = F.col("o_orderkey")
    return orders(spark, sf_dir, wide).select(
        text("p", "o_custkey").alias("PATID"), text("e", k).alias("EVTID"), text("l", k % 50).alias("ELTID"),
        iso(F.col("o_orderdate")).alias("DATENT"), stay_end().alias("DATSORT"), text("UF", k % 50).alias("SEJUF"),
        values.default_unit(F.when(k % 7 != 0, F.col("o_orderpriority"))).alias("SEJUM"),
    )


def _biol(items):
    limit = F.col("l_linenumber") != 7
    return items.select(
        F.when(F.col("l_partkey") % 11 != 0, text("p", "o_custkey")).alias("PATID"),
        text("e", "l_orderkey").alias("EVTID"), text("o", line_id()).alias("ELTID"),
        iso(F.col("l_shipdate")).alias("PRLVTDATE"), text("test-", "l_returnflag").alias("PNAME"),
        text("test-", "l_returnflag").alias("ANAME"), F.concat("l_returnflag", "l_linestatus").alias("RNAME"),
        F.col("l_partkey").cast("string").alias("LOINC"), F.col("l_quantity").cast("string").alias("RESULT"),
        F.lit("g").alias("UNIT"), F.when(limit, "10").alias("MINREF"), F.when(limit, "40").alias("MAXREF"),
    )


def _pharma(items):
    return items.select(
        text("p", "o_custkey").alias("PATID"), text("e", "l_orderkey").alias("EVTID"), text("m", line_id()).alias("ELTID"),
        iso(F.col("l_shipdate")).alias("DATPRES"), F.col("p_type").alias("PRES"), F.col("p_name").alias("ALLSPELABEL"),
        F.col("l_partkey").cast("string").alias("ALLUCD13"), F.col("p_brand").alias("CAT"),
    )


def _doceds(spark, sf_dir, wide):
    lang = F.col("lang")
    return documents(spark, sf_dir, wide).select(
        text("p", "o_custkey").alias("PATID"), text("e", "doc_id").alias("EVTID"), text("d", "doc_id").alias("ELTID"),
        F.col("text").alias("RECTXT"), F.when(~lang.isin("en", "fr"), F.col("source")).alias("RECFAMTXT"),
        iso(F.col("o_orderdate")).alias("RECDATE"), lang.alias("RECTYPE"),
        F.when(lang == "fr", F.col("source")).alias("SEJUM"),
    )


def _pmsi(spark, sf_dir, wide):
    k = F.col("o_orderkey")
    base = orders(spark, sf_dir, wide)
    common = [text("p", "o_custkey").alias("PATID"), text("e", k).alias("EVTID"), iso(F.col("o_orderdate")).alias("DATENT")]
    conditions = base.select(
        *common, text("c", k).alias("ELTID"), F.col("o_orderpriority").alias("DALL"), F.col("o_orderstatus").alias("GHM"),
        F.when(F.col("o_orderstatus") == "O", "active").alias("PMSISTATUT"),
    )
    procedures = base.select(*common, text("r", k).alias("ELTID"), text("A", k % 20).alias("CODEACTES"))
    return conditions.unionByName(procedures, allowMissingColumns=True)


_TABLES = {"patient": _patient, "mvt": _mvt, "biol": _biol, "pharma": _pharma, "doceds": _doceds, "pmsi": _pmsi}
_OF_LINES = {"biol", "pharma"}


def dataset(spark: SparkSession, sf_dir: str, *names: str, wide: bool = False, again: bool = False) -> dict[str, DataFrame]:
    """Tables as they are before enrichment, computed without records: the input of filters, exports and counts.

    Filters on them reach the Parquet scans of the given tables. ``again``: the job reads the tables several times, so the joins of
    the line items are stored (eager).
    """
    chosen = names or tuple(_TABLES)
    items = None
    if _OF_LINES & set(chosen):
        items = stored_lines(spark, sf_dir) if again else lines(spark, sf_dir, wide)
    return {n: enforce_schema(_TABLES[n](items) if n in _OF_LINES else _TABLES[n](spark, sf_dir, wide), n) for n in chosen}
