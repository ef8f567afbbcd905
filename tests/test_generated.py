"""The text rules of extracted values: methods that the JVM compiles, and the same texts as the plain rule."""

from pyspark.sql import functions as F

from wardlake import model
from wardlake.functions import ids
from wardlake.operators import extract

#: Bytes of a method above which the JVM interprets it; what follows an extraction joins its methods, so it may take half.
HUGE = 8000


def test_extraction_makes_no_method_too_large_to_compile(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def extracted(record_type):
            found = spark.createDataFrame([(record_type, '{"id":"1"}')], "resource_type string, resource string")
            return extract.extract_table(found, model.MAPPING[record_type]["table"], as_of="2024-06-15")

        for record_type in ("Observation", "MedicationRequest"):
            plan = extracted(record_type)._jdf.queryExecution().executedPlan()
            debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
            stages = getattr(debug, "MODULE$").codegenStringSeq(plan)
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
            assert sizes and max(sizes) <= HUGE // 2, (record_type, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_guarded_rules_equal_the_plain_ones(spark):
    texts = [
        None, "", "plain", "Patient/1", "a/b", "urn:uuid:x", "Patiurn:uuid:ent/5", "{Patient/1}", "[see Encounter/2", '{"a":"Patient/1"}',
        '["urn:uuid:x"]', '{"a":1}', "[x", "{urn:uuid:9", "x|y", "urn:oid:1", "a:b", "a\nb|c/d", "é/7", "-/7", "urn:", "x urn:oid:1",
    ]
    v = F.col("v")
    nested = (v.startswith("{") | v.startswith("[")) & F.try_parse_json(v).isNotNull()
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", extract.extracted_text(v).alias("text"), F.when(nested, v).otherwise(ids.strip_ref_prefix(v)).alias("plain_text"),
        ids.clean_ids(v).alias("id"), F.regexp_replace(v, ids.ID_PREFIX, "").alias("plain_id"),
    ).collect()
    assert len(rows) == len(texts)
    assert [(r.v, r.text, r.id) for r in rows] == [(r.v, r.plain_text, r.plain_id) for r in rows]
    assert all(any(mark in prefix for mark in ids.REFERENCE_MARKS) for prefix in ids.REFERENCE_PREFIXES)
