"""Search and version operators over a table of records (resource_type, resource, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlake.functions import ids, records
from wardlake.operators.numbering import number_rows

PAGE_SIZE = 100

NAME_SCHEMA = "name array<struct<family:string,given:array<string>,text:string>>"


def _of_type(resources: DataFrame, record_type: str) -> DataFrame:
    return resources.filter(F.col("resource_type") == record_type)


def search_by_id(resources: DataFrame, record_type: str, wanted: Sequence[str] | DataFrame) -> DataFrame:
    """Records of a type with one of the ids (a list, or a one-column DataFrame of any size)."""
    found = _of_type(resources, record_type)
    own = records.json_path(F.col("resource"), "id")
    if isinstance(wanted, DataFrame):
        listed = wanted.toDF("_wanted")
        return found.withColumn("_id", own).join(listed, F.col("_id") == F.col("_wanted"), "left_semi").drop("_id")
    return found.filter(own.isin(list(wanted)))


def token_match(path: str, *tokens: str) -> Column:
    """True where the value at the path is one of the tokens."""
    return records.json_path(F.col("resource"), path).isin(list(tokens))


def search_by_token(resources: DataFrame, record_type: str, path: str, *tokens: str) -> DataFrame:
    """``Type?path=token``; several tokens are joined by OR."""
    return _of_type(resources, record_type).filter(token_match(path, *tokens))


def search_by_name(
    resources: DataFrame, name: str, wanted: Sequence[str] | None = None, family_only: bool = False
) -> DataFrame:
    """Patients with a name part that starts with the text, in any case; ``wanted`` ids are joined by AND."""
    prefix = name.lower()
    names = F.from_json("resource", NAME_SCHEMA)["name"]

    def starts(part: Column) -> Column:
        return F.coalesce(F.lower(part).startswith(prefix), F.lit(False))

    def hit(n: Column) -> Column:
        if family_only:
            return starts(n["family"])
        given = F.coalesce(F.exists(n["given"], starts), F.lit(False))
        return starts(n["family"]) | starts(n["text"]) | given

    found = _of_type(resources, "Patient").filter(F.exists(names, hit))
    return found if wanted is None else search_by_id(found, "Patient", wanted)


def search_page(df: DataFrame, key: str, size: int = PAGE_SIZE, after: str | None = None) -> DataFrame:
    """The next page of a result in key order: a top-n over the rows after the last key seen."""
    rest = df if after is None else df.filter(F.col(key) > after)
    return rest.orderBy(key).limit(size)


def search_pages(df: DataFrame, key: str, size: int = PAGE_SIZE) -> DataFrame:
    """All rows with page_no (from 1) and total. Eager, see ``number_rows``; the key must be unique."""
    numbered = number_rows(df, [F.col(key)], name="_rn")
    page = F.floor((F.col("_rn") - 1) / size).cast("bigint") + 1
    total = df.agg(F.count("*").alias("total"))
    return numbered.withColumn("page_no", page).drop("_rn").withColumn("total", F.lit(total.scalar().cast("bigint")))


OWNER_SCHEMA = "id string, subject struct<reference:string>, patient struct<reference:string>"


def patient_everything(
    resources: DataFrame, wanted: Sequence[str] | DataFrame | None = None, with_id: bool = False, with_readable: bool = False
) -> DataFrame:
    """Every record of the wanted patients (default: all), with patient_id: their own and those that refer to them.

    ``with_id`` and ``with_readable`` add the record's id and whether it is JSON (``records.is_readable``), from the parse that
    finds the owner: whoever needs no more than these reads a record once and does not shuffle its text.
    """
    subject = ids.patient_of_reference(F.col("record.subject.reference"), F.col("record.patient.reference"))
    patient = F.when(F.col("resource_type") == "Patient", F.col("record.id")).otherwise(subject)
    more = [F.col("record.id").alias("id")] if with_id else []
    if with_readable:
        read = records.parsed(resources, f"{OWNER_SCHEMA}, {records.CORRUPT} string", options=records.KEEP_CORRUPT)
        # A value of another type is kept as corrupt too, so the plain check decides on what was not read smoothly.
        smooth = F.col(f"record.{records.CORRUPT}").isNull()
        more.append(F.when(smooth, F.lit(True)).otherwise(records.is_readable(F.col("resource"))).alias("readable"))
    else:
        read = records.parsed(resources, OWNER_SCHEMA)
    owned = read.select(*resources.columns, patient.alias("patient_id"), *more).filter(F.col("patient_id").isNotNull())
    if wanted is None:
        return owned
    if isinstance(wanted, DataFrame):
        return owned.join(wanted.toDF("_wanted"), F.col("patient_id") == F.col("_wanted"), "left_semi")
    return owned.filter(F.col("patient_id").isin(list(wanted)))


def lastn(
    observations: DataFrame, n: int = 1, subject: str = "subject", code: str = "code", date: str = "effective",
    tie: str = "id",
) -> DataFrame:
    """The latest ``n`` observations per subject and code. Filters on category, code, date or patient go before.

    Each task keeps at most ``n`` rows per group before the shuffle, so a hot code does not pile up.
    """
    latest = W.partitionBy(subject, code).orderBy(F.desc(date), F.col(tie))
    return observations.withColumn("rank", F.row_number().over(latest)).filter(F.col("rank") <= n)


OBSERVATION_SCHEMA = (
    "id string, effectiveDateTime string, subject struct<reference:string>, patient struct<reference:string>, "
    "code struct<text:string,coding:array<struct<code:string>>>, "
    "category array<struct<text:string,coding:array<struct<code:string>>>>"
)


def observations(resources: DataFrame) -> DataFrame:
    """(subject, code, categories, effective, id, resource) of the Observation records.

    The code is that of the first coding, else the text; categories are all category codes.
    """
    read = records.parsed(_of_type(resources, "Observation"), OBSERVATION_SCHEMA, "_o")
    o = F.col("_o")
    return read.select(
        ids.patient_of_reference(o["subject"]["reference"], o["patient"]["reference"]).alias("subject"),
        F.coalesce(F.get(o["code"]["coding"], F.lit(0))["code"], o["code"]["text"]).alias("code"),
        F.flatten(F.transform(o["category"], lambda c: F.transform(c["coding"], lambda k: k["code"]))).alias("categories"),
        o["effectiveDateTime"].alias("effective"),
        o["id"].alias("id"),
        "resource",
    )


def search_lastn(
    resources: DataFrame, n: int = 1, category: Sequence[str] = (), code: Sequence[str] = (),
    since: str | None = None, until: str | None = None, patients: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Latest ``n`` Observation records per patient and code; each filter that is given must hold.

    ``since`` is inclusive, ``until`` exclusive; both compare ISO text. Records without a subject count as one.
    """
    found = observations(resources)
    if category:
        found = found.filter(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in category])))
    if code:
        found = found.filter(F.col("code").isin(list(code)))
    if since is not None:
        found = found.filter(F.col("effective") >= since)
    if until is not None:
        found = found.filter(F.col("effective") < until)
    if isinstance(patients, DataFrame):
        found = found.join(patients.toDF("_wanted"), F.col("subject") == F.col("_wanted"), "left_semi")
    elif patients is not None:
        found = found.filter(F.col("subject").isin(list(patients)))
    return lastn(found, n)


def latest_versions(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last write per key."""
    newest = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def upsert_put(log: DataFrame, keys: Sequence[str] = ("type", "id"), order: Sequence[str] = ("written_at", "seq")) -> DataFrame:
    """State after all PUTs of a log: the latest one per type and id wins."""
    return latest_versions(log, keys, order)


def version_history(
    log: DataFrame, keys: Sequence[str] = ("type", "id"), order: Sequence[str] = ("written_at", "seq"), **limits
) -> DataFrame:
    """Every write with its version number, 1 for the first. Eager, see ``number_rows``."""
    return number_rows(log, [F.col(c) for c in order], keys, "version", **limits)


def delete_resource(
    log: DataFrame, deleted: str = "deleted", keys: Sequence[str] = ("type", "id"),
    order: Sequence[str] = ("written_at", "seq"),
) -> DataFrame:
    """Records still visible: those whose latest write is no tombstone."""
    return latest_versions(log, keys, order).filter(~F.coalesce(deleted, F.lit(False)))
