"""Counts, previews, reports, searches, versions and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake import model
from wardlake.functions import records
from wardlake.operators import browse, merge, search
from wardlake.session import scratch, spread, tidy
from wardlake.sources import bundles as docs
from wardlake.sources import pages, runs, tokenindex
from wardlake.sources import tables as store
from wardlake.sources.versions import VersionStore
from wardlake.streaming import arrivals
from wardlake.workload import fixtures as fx
from wardlake.workload.expected import ALL_IDS0, LINE_ID, iso, tables
from wardlake.workload.joins import ALL_IDS, whole_rows_sql, id_rows, whole_rows
from wardlake.workload.registry import query
from wardlake.workload.scans import _RAW_IDS

STREAM_WAIT = 3600

_COUNTS = f"""SELECT "table", count(*) AS n_rows FROM ({ALL_IDS0}) GROUP BY 1"""


@query(
    "bundle_summary",
    f"""SELECT resource_type, count(*) AS n FROM ({_RAW_IDS}) GROUP BY 1
        UNION ALL SELECT '*', count(*) FROM ({_RAW_IDS})""",
)
def bundle_summary(spark, sf_dir):
    return browse.bundle_summary(fx.resources(spark, sf_dir))


@query("table_row_count", "SELECT 'lineitem' AS \"table\", count(*) AS n_rows FROM lineitem UNION ALL SELECT 'absent', 0")
def table_row_count(spark, sf_dir):
    found = browse.table_row_count(store.scan_table(spark, sf_dir, "lineitem"), "lineitem", spark)
    return found.unionByName(browse.table_row_count(store.scan_table(spark, sf_dir, "absent"), "absent", spark))


@query("snapshot_counts", tables(f"{_COUNTS} UNION ALL SELECT 'absent', 0"))
def snapshot_counts(spark, sf_dir):
    return browse.snapshot_counts(fx.dataset(spark, sf_dir), spark, [*model.TABLES, "absent"])


_OLD, _NEW = "DATENT < '1998'", "DATENT >= '1997'"


@query(
    "merge_report",
    tables(
        f"""SELECT 'mvt' AS "table", count_if({_OLD}) AS before_rows, count_if({_NEW}) AS incoming_rows,
                   count(*) AS after_rows, count(*) - count_if({_OLD}) AS added_rows FROM mvt0
            UNION ALL SELECT 'pmsi', count_if({_OLD}), count_if({_NEW}), count(*), count(*) - count_if({_OLD}) FROM pmsi0
            UNION ALL SELECT 'patient', 0, count(*), count(*), count(*) FROM patient
            UNION ALL SELECT 'biol', 0, count(*), count(*), count(*) FROM biol0
            UNION ALL SELECT 'pharma', 0, count(*), count(*), count(*) FROM pharma0
            UNION ALL SELECT 'doceds', 0, count(*), count(*), count(*) FROM doceds0"""
    ),
)
def merge_report(spark, sf_dir):
    """Stays and claims overlap with what is stored; the other tables are new."""
    data = fx.dataset(spark, sf_dir)
    base = {t: data[t].filter(_OLD) for t in ("mvt", "pmsi")}
    incoming = {t: df.filter(_NEW) if t in base else df for t, df in data.items()}
    after = {t: merge.merge_insert_only(base.get(t), incoming[t], model.MERGE_KEYS[t]) for t in incoming}
    sides = [browse.snapshot_counts(d, spark) for d in (base, after, incoming)]
    return browse.merge_report(*sides)


@query("incoming_accumulate", 'SELECT event_type AS "table", CAST(sum(user_id) AS BIGINT) AS n_rows FROM events GROUP BY 1')
def incoming_accumulate(spark, sf_dir):
    merges = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("table"), F.col("user_id").alias("incoming_rows"))
    return browse.incoming_accumulate(merges)


_WIDTHS = ", ".join(f"('{t}', {len(c)})" for t, c in model.TABLES.items())


@query(
    "table_stats",
    tables(
        f"""SELECT c."table", n_rows, CAST(w.n AS BIGINT) AS n_cols FROM ({_COUNTS}) c
            JOIN (VALUES {_WIDTHS}) AS w(t, n) ON w.t = c."table" WHERE c."table" <> 'patient'"""
    ),
)
def table_stats(spark, sf_dir):
    return browse.table_stats(fx.dataset(spark, sf_dir), spark)


@query(
    "dataset_totals",
    tables(
        f"""SELECT count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS total_rows,
                   string_agg("table" || '=' || n_rows, ',' ORDER BY "table") AS detail FROM ({_COUNTS})"""
    ),
)
def dataset_totals(spark, sf_dir):
    totals = browse.dataset_totals(fx.dataset(spark, sf_dir), spark)
    return totals.withColumn("detail", _map_text("detail"))


def _map_text(column: str):
    """Map as ``key=value,...`` in key order, the form that the check states."""
    items = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(items, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query("preview", tables("SELECT PATID, EVTID, ELTID, RESULT FROM biol0 ORDER BY ELTID LIMIT 50"))
def preview(spark, sf_dir):
    return browse.preview(fx.dataset(spark, sf_dir, "biol")["biol"], ["ELTID"]).select("PATID", "EVTID", "ELTID", "RESULT")


@query("preview_columns", tables("SELECT EVTID, left(SEJUM, 5) || CASE WHEN length(SEJUM) > 6 THEN '…' ELSE substr(SEJUM, 6) END AS SEJUM FROM mvt0 ORDER BY EVTID LIMIT 7"))
def preview_columns(spark, sf_dir):
    mvt = fx.dataset(spark, sf_dir, "mvt")["mvt"]
    return browse.preview_columns(mvt, ["EVTID", "SEJUM"], limit=7, max_cell=6, order=["EVTID"])


@query("patient_ids", "SELECT 'p' || c_custkey AS patient_id FROM customer ORDER BY 1 LIMIT 25")
def patient_ids(spark, sf_dir):
    return browse.patient_ids(fx.resources(spark, sf_dir), limit=25)


# Patients of all records as the bundles hold them.
_OWNED = f"""
    SELECT 'Patient' AS resource_type, 'p' || c_custkey AS patient_id, 'p' || c_custkey AS id FROM customer
    UNION ALL SELECT 'Encounter', 'p' || o_custkey, 'urn:uuid:e' || o_orderkey FROM orders
    UNION ALL SELECT 'Condition', 'p' || o_custkey, 'c' || o_orderkey FROM orders
    UNION ALL SELECT 'Procedure', 'p' || o_custkey, 'r' || o_orderkey FROM orders
    UNION ALL SELECT 'Observation', 'p' || o_custkey, 'o' || {LINE_ID} FROM item WHERE l_partkey % 11 <> 0
    UNION ALL SELECT 'MedicationRequest', 'p' || o_custkey, 'm' || {LINE_ID} FROM item
    UNION ALL SELECT CASE lang WHEN 'en' THEN 'DiagnosticReport' WHEN 'fr' THEN 'DocumentReference' ELSE 'Composition' END,
                     'p' || o_custkey, 'd' || doc_id FROM documents JOIN orders ON doc_id = o_orderkey"""


@query(
    "import_status",
    tables(
        f"""SELECT patient_id, 'success' AS status, CAST(sum(n) AS BIGINT) AS entries_total,
                   string_agg(resource_type || '=' || n, ',' ORDER BY resource_type) AS resources_per_type
            FROM (SELECT patient_id, resource_type, count(*) AS n FROM ({_OWNED}) GROUP BY ALL) GROUP BY 1"""
    ),
)
def import_status(spark, sf_dir):
    owned = search.patient_everything(fx.all_resources(spark, sf_dir), with_readable=True)
    status = browse.import_status(owned)
    return status.withColumn("resources_per_type", _map_text("resources_per_type"))


@query(
    "import_requests",
    """SELECT 'p' || c_custkey AS patient_id, 'success' AS status, CAST(NULL AS VARCHAR) AS error, 1 + coalesce(n, 0) * 3 AS entries_total,
              CASE WHEN n > 0 THEN 'Condition=' || n || ',Encounter=' || n || ',Patient=1,Procedure=' || n ELSE 'Patient=1' END AS resources_per_type
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey
       UNION ALL SELECT 's' || s_suppkey, 'failed', '1 unreadable documents', 0, '' FROM supplier
       UNION ALL SELECT 'r' || r_regionkey, 'success', NULL, 0, '' FROM region""",
)
def import_requests(spark, sf_dir):
    """The documents asked for per patient: patients and their stays, texts that are no JSON, bundles without entries."""
    number = F.regexp_extract("name", "-(.+)$", 1)
    others = [("patient", "p"), ("supplier", "s"), ("region", "r")]
    came = {n: fx.bundles(spark, sf_dir, n).filter(F.col("name").startswith(f"{n}-")) for n in ("patient", "supplier", "region", "stay")}
    asked = [browse.judge_requests(came[n].select(F.concat(F.lit(p), number).alias("patient_id"), "value")) for n, p in others]
    owner = fx.orders(spark, sf_dir).select(fx.text("stay-", "o_orderkey").alias("name"), fx.text("p", "o_custkey").alias("patient_id"))
    stays = browse.judge_requests(came["stay"]).join(owner, "name").drop("name")
    status = browse.request_status(reduce(DataFrame.unionByName, [*asked, stays]))
    return status.withColumn("resources_per_type", _map_text("resources_per_type"))


@query(
    "run_log",
    """SELECT event_type AS run_type, max_by(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS run_id,
              max(ts) AS started_at, CASE WHEN event_type = 'error' THEN 'partial_success' ELSE 'success' END AS status,
              CASE WHEN event_type = 'error' THEN CAST(max_by(user_id, (ts, CAST(event_id AS VARCHAR))) AS INTEGER) + 90 ELSE 0 END AS n_errors
       FROM events GROUP BY event_type""",
)
def run_log(spark, sf_dir):
    path = scratch(spark, "runs")
    failed = F.col("event_type") == "error"
    errors = F.when(failed, F.array_repeat(F.lit("failed"), (F.col("user_id") + 90).cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = spread(fx.table(spark, sf_dir, "events")).select(
        F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("run_type"),
        F.lit(None).cast("string").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"),
        F.col("props").alias("summary"), errors.alias("errors"),
    )
    runs.append_runs(rows, path)
    last = runs.last_runs(spark.read.parquet(path))
    return last.select("run_type", "run_id", "started_at", "status", "n_errors")


@query(
    "search_by_id",
    "SELECT 'c' || o_orderkey AS id, o_orderpriority AS text FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)",
)
def search_by_id(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(fx.text("c", "l_orderkey"))
    found = search.search_by_id(fx.resources(spark, sf_dir), "Condition", wanted)
    r = F.col("resource")
    return found.select(records.json_path(r, "id").alias("id"), records.json_path(r, "code.text").alias("text"))


@query("search_by_token", f"SELECT 'o' || {LINE_ID} AS id FROM lineitem WHERE l_linestatus = 'F'")
def search_by_token(spark, sf_dir):
    found = search.search_by_token(fx.resources(spark, sf_dir), "Observation", "status", "final")
    return found.select(records.json_path(F.col("resource"), "id").alias("id"))


@query(
    "search_by_name",
    """SELECT 'p' || c_custkey AS id FROM customer WHERE lower(c_mktsegment) LIKE 'build%'
       UNION SELECT 'p' || c_custkey FROM customer WHERE lower(c_name) LIKE 'customer#00000000%'""",
)
def search_by_name(spark, sf_dir):
    patients = fx.resources(spark, sf_dir, "Patient")
    by_given = search.search_by_name(patients, "Build")
    by_family = search.search_by_name(patients, "CUSTOMER#00000000", family_only=True)
    own = records.json_path(F.col("resource"), "id").alias("id")
    return by_given.select(own).unionByName(by_family.select(own)).distinct()


@query(
    "search_by_index",
    f"""SELECT 'final' AS search, 'o' || {LINE_ID} AS id FROM lineitem WHERE l_linestatus = 'F'
        UNION ALL SELECT 'code', 'o' || {LINE_ID} FROM lineitem WHERE l_partkey IN (7, 77)
        UNION ALL SELECT 'condition', 'c' || o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'
        UNION ALL SELECT 'given', 'p' || c_custkey FROM customer WHERE lower(c_mktsegment) LIKE 'build%'
        UNION ALL SELECT 'family', 'p' || c_custkey FROM customer WHERE lower(c_name) LIKE 'customer#00000000%'""",
)
def search_by_index(spark, sf_dir):
    """Token and name searches on an index that is written once."""
    folder = scratch(spark, "tokens")
    found = fx.resources(spark, sf_dir, "Observation", "Condition", "Patient")
    paths = {"Observation": ["status", "code.coding[0].code"], "Condition": ["code.text"]}
    tokenindex.write_index(tokenindex.token_rows(found, paths), folder)
    index = tokenindex.read_index(spark, folder)
    searches = {
        "final": tokenindex.find(index, "Observation", "status", "final"),
        "code": tokenindex.find(index, "Observation", "code.coding[0].code", "7", "77"),
        "condition": tokenindex.find(index, "Condition", "code.text", "5-LOW"),
        "given": tokenindex.find_name(index, "Build"),
        "family": tokenindex.find_name(index, "CUSTOMER#00000000", family_only=True),
    }
    return reduce(DataFrame.unionByName, [ids.select(F.lit(s).alias("search"), "id") for s, ids in searches.items()])


@query(
    "search_page",
    """SELECT 'p' || c_custkey AS id, (row_number() OVER (ORDER BY 'p' || c_custkey) - 1) // 100 + 1 AS page_no,
              count(*) OVER () AS total FROM customer""",
)
def search_page(spark, sf_dir):
    patients = fx.resources(spark, sf_dir, "Patient").select(records.json_path(F.col("resource"), "id").alias("id"))
    return search.search_pages(patients, "id", 100)


@query(
    "search_page_stored",
    """WITH p AS (SELECT 'p' || c_custkey AS id, (row_number() OVER (ORDER BY 'p' || c_custkey) - 1) // 100 + 1 AS page_no FROM customer)
       SELECT id, page_no FROM p WHERE page_no IN (1, 2, (SELECT max(page_no) FROM p))""",
)
def search_page_stored(spark, sf_dir):
    """The first two pages and the last one, each from the ranges that hold it."""
    folder = scratch(spark, "pages")
    patients = fx.resources(spark, sf_dir, "Patient").select(records.json_path(F.col("resource"), "id").alias("id"))
    pages.write_pages(patients, "id", folder)
    last = -(-pages.page_total(spark, folder).first()["total"] // 100)
    wanted = [pages.read_page(spark, folder, n, 100).withColumn("page_no", F.lit(n).cast("bigint")) for n in sorted({1, 2, last})]
    return reduce(DataFrame.unionByName, wanted)


@query(
    "patient_everything",
    tables(
        f"""SELECT patient_id, resource_type, id FROM ({_OWNED})
            WHERE patient_id IN (SELECT 'p' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')"""
    ),
)
def patient_everything(spark, sf_dir):
    wanted = fx.customers(spark, sf_dir).filter("c_mktsegment = 'MACHINERY'").select(fx.text("p", "c_custkey"))
    found = search.patient_everything(fx.all_resources(spark, sf_dir), wanted, with_id=True)
    return found.select("patient_id", "resource_type", "id")


@query(
    "lastn",
    tables(
        f"""SELECT subject, code, id, effective FROM (
                SELECT 'p' || o_custkey AS subject, 'test-' || l_returnflag AS code, 'o' || {LINE_ID} AS id,
                       {iso('l_shipdate')} AS effective FROM item WHERE l_partkey % 11 <> 0)
            QUALIFY row_number() OVER (PARTITION BY subject, code ORDER BY effective DESC, id) <= 3"""
    ),
)
def lastn(spark, sf_dir):
    shape = "id string, effectiveDateTime string, subject struct<reference:string>, code struct<text:string>"
    read = records.parsed(fx.resources(spark, sf_dir, "Observation"), shape, "r")
    observations = read.select(
        search.ids.patient_of_reference(F.col("r.subject.reference")).alias("subject"),
        F.col("r.code.text").alias("code"), F.col("r.id").alias("id"), F.col("r.effectiveDateTime").alias("effective"),
    )
    return search.lastn(observations.filter("subject IS NOT NULL"), 3).select("subject", "code", "id", "effective")


@query(
    "lastn_filtered",
    tables(
        f"""SELECT subject, code, id, effective FROM (
                SELECT 'p' || o_custkey AS subject, CAST(l_partkey AS VARCHAR) AS code, 'o' || {LINE_ID} AS id,
                       {iso('l_shipdate')} AS effective FROM item WHERE l_partkey % 11 <> 0)
            WHERE effective >= '1996' AND effective < '2000'
              AND subject IN (SELECT 'p' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
            QUALIFY row_number() OVER (PARTITION BY subject, code ORDER BY effective DESC, id) <= 1"""
    ),
)
def lastn_filtered(spark, sf_dir):
    patients = fx.customers(spark, sf_dir).filter("c_mktsegment = 'BUILDING'").select(fx.text("p", "c_custkey"))
    found = search.search_lastn(fx.resources(spark, sf_dir), since="1996", until="2000", patients=patients)
    return found.select("subject", "code", "id", "effective")


def _log(spark, sf_dir):
    """Events as a log of writes; errors are deletions."""
    return fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("type"), F.col("user_id").alias("id"), F.col("ts").alias("written_at"),
        F.col("event_id").alias("seq"), "value", (F.get_json_object("props", "$.k").cast("int") > 80).alias("deleted"),
    )


_LATEST = """
    SELECT event_type AS type, user_id AS id, event_id AS seq, value,
           CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) > 80 AS deleted FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1"""


@query("upsert_put", f"SELECT type, id, seq, value FROM ({_LATEST})")
def upsert_put(spark, sf_dir):
    return search.upsert_put(_log(spark, sf_dir)).select("type", "id", "seq", "value")


@query("upsert_compacted", f"SELECT type, id, seq, value, deleted FROM ({_LATEST})")
def upsert_compacted(spark, sf_dir):
    """The log in three parts, the last one of late writes: two are taken into the snapshot, one lies behind it."""
    log, kept = _log(spark, sf_dir), VersionStore(spark, scratch(spark, "versions"))
    half = F.expr("timestamp'2024-01-16'")
    kept.put(log.filter((F.col("written_at") >= half) & (F.col("type") != "view")))
    kept.compact()
    kept.put(log.filter((F.col("written_at") >= half) & (F.col("type") == "view")))
    kept.compact()
    kept.put(log.filter(F.col("written_at") < half))
    return kept.current().select("type", "id", "seq", "value", "deleted")


@query(
    "version_history",
    """SELECT event_type AS type, user_id AS id, event_id AS seq,
              row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS version FROM events""",
)
def version_history(spark, sf_dir):
    return search.version_history(_log(spark, sf_dir)).select("type", "id", "seq", "version")


@query("delete_resource", f"SELECT type, id, seq FROM ({_LATEST}) WHERE NOT deleted")
def delete_resource(spark, sf_dir):
    return search.delete_resource(_log(spark, sf_dir)).select("type", "id", "seq")


@query("stream_import", tables(ALL_IDS))
def stream_import(spark, sf_dir):
    landing, folder = scratch(spark, "landing"), scratch(spark, "dataset")
    with tidy(spark):
        fx.bundles(spark, sf_dir).select("value").write.options(**docs.PACKED).text(landing)
    stream = arrivals.arriving_bundles(spark, landing, per_line=True, pattern="*.txt.gz", files_per_batch=1_000_000)
    _finish(arrivals.stream_import(stream, folder, scratch(spark, "stream"), as_of=fx.AS_OF))
    return id_rows(store.scan_dataset(spark, folder), "PATAGE", "PATSEX")


@query("stream_late_facts", whole_rows_sql())
def stream_late_facts(spark, sf_dir):
    """Facts arrive first, then stays, then patients, each in a batch of its own; every column of every table."""
    landing, folder, checkpoint = scratch(spark, "landing"), scratch(spark, "dataset"), scratch(spark, "stream")
    bundles = fx.bundles(spark, sf_dir)
    patients, stays = "name LIKE 'patient-%'", "name LIKE 'stay-%'"
    for part in (f"NOT ({patients}) AND NOT ({stays})", stays, patients):
        with tidy(spark):
            bundles.filter(part).select("value").write.mode("append").options(**docs.PACKED).text(landing)
        stream = arrivals.arriving_bundles(spark, landing, per_line=True, pattern="*.txt.gz", files_per_batch=1_000_000)
        _finish(arrivals.stream_import(stream, folder, checkpoint, as_of=fx.AS_OF))
    return whole_rows(store.scan_dataset(spark, folder))


@query("stream_subscription", f"SELECT 'o' || {LINE_ID} AS id FROM lineitem WHERE l_linestatus = 'F'")
def stream_subscription(spark, sf_dir):
    landing, out = scratch(spark, "landing"), scratch(spark, "matches")
    with tidy(spark):
        fx.resources(spark, sf_dir, "Observation", "Condition").select("resource").write.options(**docs.PACKED).text(landing)
    stream = arrivals.arriving_resources(spark, landing)
    _finish(arrivals.stream_subscription(stream, out, scratch(spark, "stream"), "Observation", "status", "final"))
    return spark.read.parquet(out).select(records.json_path(F.col("resource"), "id").alias("id"))


@query(
    "stream_subscriptions",
    f"""SELECT 'part ' || l_partkey AS criterion, 'o' || {LINE_ID} AS id FROM lineitem
        UNION ALL SELECT 'status ' || s, 'o' || {LINE_ID}
            FROM lineitem JOIN (VALUES ('final', 'F'), ('preliminary', 'O')) v(s, f) ON l_linestatus = f
        UNION ALL SELECT 'all conditions', 'c' || o_orderkey FROM orders
        UNION ALL SELECT 'urgent', 'c' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def stream_subscriptions(spark, sf_dir):
    """A criterion per part, and some others, in one stream."""
    landing, out = scratch(spark, "landing"), scratch(spark, "matches")
    with tidy(spark):
        fx.resources(spark, sf_dir, "Observation", "Condition").select("resource").write.options(**docs.PACKED).text(landing)
    part = F.col("p_partkey").cast("string")
    criteria = fx.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part "), part).alias("criterion"), F.lit("Observation").alias("resource_type"),
        F.lit("code.coding[0].code").alias("path"), part.alias("token"),
    ).unionByName(spark.createDataFrame([
        ("status final", "Observation", "status", "final"), ("status preliminary", "Observation", "status", "preliminary"),
        ("all conditions", "Condition", None, None), ("urgent", "Condition", "code.text", "1-URGENT"),
    ], "criterion string, resource_type string, path string, token string"))
    stream = arrivals.arriving_resources(spark, landing)
    _finish(arrivals.stream_subscriptions(stream, criteria, out, scratch(spark, "stream")))
    return spark.read.parquet(out).select("criterion", records.json_path(F.col("resource"), "id").alias("id"))


def _finish(running) -> None:
    if not running.awaitTermination(STREAM_WAIT):
        running.stop()
        raise TimeoutError("the stream did not finish")
