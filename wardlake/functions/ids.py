"""Identifier and reference cleaning."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Removed from every extracted string, in this order.
REFERENCE_PREFIXES = ["urn:uuid:", "Patient/", "Encounter/", "Practitioner/", "Location/"]

# Every reference prefix holds one of these.
REFERENCE_MARKS = ["/", "urn:uuid:"]

# Fixed value: leading part of an id column. (?U) gives the Unicode \w, (?d) lets "." stop at \n only.
ID_PREFIX = r"(?Ud)^(urn:uuid:|urn:oid:|[\w]+/|.*\|)"

# Leading prefixes taken off a reference id, one at most.
LEADING_PREFIXES = [
    "urn:uuid:", "Patient/", "Encounter/", "Observation/", "Procedure/", "Condition/",
    "MedicationRequest/", "Location/",
]

# Fixed value: characters of an id that a record may carry.
ID_LENGTH = 64


def strip_ref_prefix(value: Column) -> Column:
    """Remove every occurrence of the reference prefixes, wherever they stand."""
    for prefix in REFERENCE_PREFIXES:
        value = F.replace(value, F.lit(prefix), F.lit(""))
    return value


def may_hold_prefix(value: Column) -> Column:
    """False for text that ``strip_ref_prefix`` leaves as it is; most text holds none of the marks."""
    return reduce(or_, [value.contains(mark) for mark in REFERENCE_MARKS])


def clean_ids(value: Column) -> Column:
    """Drop a leading urn, ``Type/`` or ``system|`` part of an id column; bare ids do not meet the pattern."""
    value = value.cast("string")
    part = value.contains("/") | value.contains("|") | value.startswith("urn:")
    return F.when(part, F.regexp_replace(value, ID_PREFIX, "")).otherwise(value)


def clean_id(value: Column) -> Column:
    """Drop one known leading prefix; null and empty become the empty string."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), f"^({'|'.join(LEADING_PREFIXES)})", "")


def bare_id(value: Column) -> Column:
    """Id after the last ``|``, then after the last ``=``, prefix off, of any length.

    ``substring_index`` returns the whole text where the mark is absent.
    """
    tail = F.substring_index(F.coalesce(value.cast("string"), F.lit("")), "|", -1)
    return clean_id(F.substring_index(tail, "=", -1))


def normalize_fhir_id(value: Column) -> Column:
    """Id that a record may carry: the bare id, cut after 64 characters."""
    return F.substring(bare_id(value), 1, ID_LENGTH)


def record_id(value: Column) -> Column:
    """Id under which a row is exported: the bare id, and the hash of all of it where it is too long to be carried.

    Ids that share their first 64 characters stay different, so no record takes another's place.
    """
    bare = bare_id(value)
    return F.when(F.length(bare) > ID_LENGTH, stable_id(bare)).otherwise(bare)


def stable_id(*parts: Column) -> Column:
    """SHA-1 (hex) of the parts joined by ``|``; null parts count as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha1(F.concat_ws("|", *texts).cast("binary"))


def filled_id(value: Column, normal: Column) -> Column:
    """Normalised id of a value, the hash of the value where that is empty, null where there is no value."""
    return F.when(value.isNotNull(), F.when(normal == "", stable_id(value)).otherwise(normal))


def fallback_id(value: Column, *row: Column) -> Column:
    """Id for the export; hash of the value if that is empty; hash of the row parts if there is no value."""
    own = filled_id(value, record_id(value))
    return F.coalesce(own, stable_id(*row)) if row else own


def patient_of_reference(subject: Column, patient: Column | None = None) -> Column:
    """Patient id from ``subject.reference``, else ``patient.reference``: the text after the first ``/``."""
    ref = F.nullif(subject, F.lit(""))
    if patient is not None:
        ref = F.coalesce(ref, patient)
    return F.when(ref.contains("/"), F.substr(ref, F.locate("/", ref) + F.lit(1)))
