"""Value rules: sex codes, dates, ages, durations, text shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sex codes in the tables and in the records.
SEX_CODES = {"male": "M", "female": "F", "other": "I", "unknown": "I"}
SEX_DEFAULT = "I"
GENDERS = {"M": "male", "F": "female"}
GENDER_DEFAULT = "unknown"

# Unit of a stay without one, namespace of a text block, offset suffix of a date.
UNKNOWN_UNIT = "Hôpital Indéterminé"
XHTML_NAMESPACE = ' xmlns="http://www.w3.org/1999/xhtml"'
UTC_OFFSET = r"[+-]\d{2}:\d{2}$"

_BLANKS = " \t\n\r\f\x0b"


def _choose(value: Column, table: dict[str, str], default: str) -> Column:
    choice = None
    for key, code in table.items():
        choice = (F if choice is None else choice).when(value == key, code)
    return choice.otherwise(default)


def normalize_sex(value: Column) -> Column:
    """male -> M, female -> F; anything else, null included -> I."""
    return _choose(value, SEX_CODES, SEX_DEFAULT)


def gender_out(value: Column) -> Column:
    """M -> male, F -> female (any case, blanks trimmed); anything else, null included -> unknown."""
    return _choose(F.upper(F.trim(value.cast("string"), F.lit(_BLANKS))), GENDERS, GENDER_DEFAULT)


def compute_age(birth: Column, as_of: Column | str | None = None) -> Column:
    """Full years from an ISO birth date to ``as_of`` (default: today); invalid or partial dates give null.

    The explicit format matters: without it ``1980`` and ``1980-05`` would be taken for dates.
    """
    born = _iso_day(birth)
    if as_of is None:
        ref = F.current_date()
    else:
        ref = _iso_day(F.lit(as_of) if isinstance(as_of, str) else as_of)
    before_birthday = F.struct(F.month(ref), F.dayofmonth(ref)) < F.struct(F.month(born), F.dayofmonth(born))
    return (F.year(ref) - F.year(born) - before_birthday.cast("int")).cast("int")


def _iso_day(value: Column) -> Column:
    return F.try_to_date(F.substring_index(value.cast("string"), "T", 1), "yyyy-MM-dd")


def default_unit(value: Column) -> Column:
    return F.coalesce(value, F.lit(UNKNOWN_UNIT))


def stay_duration(start: Column, end: Column) -> Column:
    """Whole days between two ISO texts, their UTC offset dropped (not applied); unreadable or null -> 0.

    Zone-free timestamps keep the result independent of the session time zone.
    """
    begin, finish = (F.regexp_replace(c, UTC_OFFSET, "").try_cast("timestamp_ntz") for c in (start, end))
    days = F.date_part(F.lit("DAY"), finish - begin)
    return F.coalesce(days.cast("bigint"), F.lit(0).cast("bigint"))


def fhir_date(value: Column, dtype: T.DataType | None = None) -> Column:
    """Empty text -> null, timestamps -> ISO text (fraction only if there is one), other text unchanged."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.nullif(value.cast("string"), F.lit(""))


def encode_base64(value: Column) -> Column:
    """UTF-8 text as base64 on one line (Spark breaks the line every 76 characters)."""
    return F.translate(F.base64(F.encode(value, "UTF-8")), "\r\n", "")


def xhtml_div(value: Column) -> Column:
    """Trimmed text, put into an XHTML div unless it already starts with one."""
    text = F.trim(value, F.lit(_BLANKS))
    wrapped = F.concat(F.lit(f"<div{XHTML_NAMESPACE}>"), text, F.lit("</div>"))
    return F.when(F.lower(text).startswith("<div"), text).otherwise(wrapped)


def clip_cell(value: Column, width: int) -> Column:
    """One-line preview text of at most ``width`` characters (0: no cut); null -> empty."""
    text = F.translate(F.coalesce(value.cast("string"), F.lit("")), "\n\r", "  ")
    if width <= 0:
        return text
    cut = F.concat(F.substring(text, 1, width - 1), F.lit("…"))
    return F.when(F.char_length(text) > width, cut).otherwise(text)


def normalize_typed(value: Column, dtype: T.DataType, target: str) -> Column:
    """Value of a declared type: first item of an array, JSON text of a struct or map, null if the cast fails."""
    if isinstance(dtype, T.ArrayType):
        value, dtype = F.get(value, F.lit(0)), dtype.elementType
    if isinstance(dtype, (T.StructType, T.MapType)):
        return F.to_json(value)
    if target == "boolean" and not isinstance(dtype, T.BooleanType):
        filled = F.length(value) > 0 if isinstance(dtype, T.StringType) else value != 0
        return filled
    if isinstance(dtype, (T.FloatType, T.DoubleType)) and target in ("int", "bigint"):
        value = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    if isinstance(dtype, T.StringType) and target in ("int", "bigint", "float", "double"):
        value = F.trim(value, F.lit(_BLANKS))
    return value.try_cast(target)
