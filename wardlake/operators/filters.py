"""Dataset filter: clauses on columns, and keys that propagate from table to table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.operators import merge
from wardlake.sources.tables import read_list

Dataset = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Where:
    """A condition on one column of the tables that match ``table``: a name, ``*`` or ``/regex/``."""

    table: str
    column: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Propagate:
    """Rows of all tables must have a ``key`` that is left in the matching source tables."""

    key: str
    source: str = "*"


def table_matches(pattern: str | None, table: str) -> bool:
    pattern = (pattern or "").strip()
    if pattern in ("", "*"):
        return True
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
        return re.search(pattern[1:-1], table) is not None
    return pattern == table


def select_tables(
    dataset: Dataset, pattern: str = "*", only: Iterable[str] = (), exclude: Iterable[str] = ()
) -> dict[str, DataFrame]:
    """Tables of a run: those that match, that are in ``only`` (if given) and not in ``exclude``; by name."""
    only, exclude = set(only or ()), set(exclude or ())
    return {
        name: dataset[name]
        for name in sorted(dataset)
        if table_matches(pattern, name) and (not only or name in only) and name not in exclude
    }


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _comparable(column: str, dtype: T.DataType, *bounds: Any) -> Column:
    """The column as the bounds need it: a number if they are numbers, else text.

    ``try_cast`` leaves text that is no number null, so the row drops out instead of failing the job.
    """
    col = F.col(column)
    if all(_is_number(b) for b in bounds):
        return col if isinstance(dtype, T.NumericType) else col.try_cast("double")
    if all(isinstance(b, bool) for b in bounds):
        return col if isinstance(dtype, T.BooleanType) else col.try_cast("boolean")
    if all(isinstance(b, str) for b in bounds):
        return col if isinstance(dtype, T.StringType) else col.cast("string")
    return col


def _compare(test: Callable[[Column, Any], Column]) -> Callable[[Column, Any, str, T.DataType], Column]:
    return lambda _col, value, column, dtype: test(_comparable(column, dtype, value), value)


def _between(_col: Column, value: Any, column: str, dtype: T.DataType) -> Column:
    low, high = value
    return _comparable(column, dtype, low, high).between(low, high)


def _isin(col: Column, value: Any, *_: Any) -> Column:
    items = value if isinstance(value, (list, tuple, set, frozenset)) else [value]
    return col.cast("string").isin([str(i) for i in items])


def _regex(col: Column, value: Any, *_: Any) -> Column:
    text = str(value)
    return col.cast("string").rlike(text[1:-1] if len(text) > 1 and text[0] == text[-1] == "/" else text)


OPERATIONS: dict[str, Callable[..., Column]] = {
    "==": _compare(lambda c, v: c == v),
    "!=": _compare(lambda c, v: c != v),
    ">": _compare(lambda c, v: c > v),
    "<": _compare(lambda c, v: c < v),
    ">=": _compare(lambda c, v: c >= v),
    "<=": _compare(lambda c, v: c <= v),
    "contains": lambda col, value, *_: col.cast("string").contains(str(value)),
    "regex": _regex,
    "in": _isin,
    "between": _between,
    "is_null": lambda col, *_: col.isNull(),
    "not_null": lambda col, *_: col.isNotNull(),
}


def predicate(df: DataFrame, clause: Where) -> Column:
    """The clause as a Column. ``contains`` is a literal search; use ``regex`` for patterns."""
    if clause.op not in OPERATIONS:
        raise ValueError(f"unknown operation: {clause.op}")
    build = OPERATIONS[clause.op]
    return build(F.col(clause.column), clause.value, clause.column, df.schema[clause.column].dataType)


def where(df: DataFrame, clause: Where) -> DataFrame:
    """Rows that meet the clause; a null result drops the row; an absent column leaves the table alone.

    ``in_file`` takes the path of a text file with one value per line, or a one-column DataFrame, and
    becomes a semi-join: the list may be larger than any literal list.
    """
    if clause.column not in df.columns:
        return df
    if clause.op == "in_file":
        listed = clause.value if isinstance(clause.value, DataFrame) else read_list(df.sparkSession, clause.value)
        listed = listed.toDF("_listed").distinct()
        return df.join(listed, F.col(clause.column).cast("string") == F.col("_listed"), "left_semi")
    return df.filter(predicate(df, clause))


def where_all(df: DataFrame, table: str, clauses: Iterable[Where]) -> DataFrame:
    """All clauses that match the table, joined by AND."""
    return reduce(where, [c for c in clauses if table_matches(c.table, table)], df)


def propagate_keys(
    dataset: Dataset, spec: Propagate, clauses: Iterable[Where] = (), keep_nulls: bool = False
) -> DataFrame | None:
    """Distinct keys of the source tables after their own clauses; None if no source has the column."""
    clauses = list(clauses)
    parts = []
    for name, df in select_tables(dataset, spec.source).items():
        if spec.key in df.columns:
            keys = where_all(df, name, clauses).select(F.col(spec.key))
            parts.append(keys if keep_nulls else keys.filter(F.col(spec.key).isNotNull()))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).distinct()


def propagate_semi(df: DataFrame, keys: DataFrame, key: str, keep_nulls: bool = False) -> DataFrame:
    """Rows whose key is in the set; with ``keep_nulls`` a null in the set matches rows without a key."""
    if key not in df.columns:
        return df
    known = keys.select(F.col(key).alias("_known"))
    if not keep_nulls:
        return df.join(known, F.col(key) == F.col("_known"), "left_semi")
    # Rows without a key would all meet in one task: they are spread, and the null of the set goes to every part.
    salt, salts = merge.spread_salt(F.col(key).isNull(), df.columns), merge.all_salts(F.col("_known").isNull())
    salted = df.withColumn("_salt", salt)
    same = F.col(key).eqNullSafe(F.col("_known")) & (F.col("_salt") == F.col("_for"))
    return salted.join(known.withColumn("_for", F.explode(salts)), same, "left_semi").drop("_salt")


def filter_dataset(
    dataset: Dataset,
    clauses: Iterable[Where] = (),
    propagate: Iterable[Propagate] = (),
    only: Iterable[str] = (),
    exclude: Iterable[str] = (),
    keep_nulls: bool = False,
    prepare_keys: Callable[[DataFrame], DataFrame] = lambda keys: keys,
) -> dict[str, DataFrame]:
    """Every chosen table, filtered by its clauses and by all propagated key sets.

    ``only`` and ``exclude`` choose what comes out; keys are drawn from all tables that a spec names, chosen or not.
    Key sets never leave the executors. ``prepare_keys`` may store a set that many writes will reuse.
    """
    clauses, chosen = list(clauses), select_tables(dataset, "*", only, exclude)
    key_sets = []
    for spec in propagate:
        keys = propagate_keys(dataset, spec, clauses, keep_nulls)
        if keys is not None:
            key_sets.append((spec.key, prepare_keys(keys)))
    out = {}
    for name, df in chosen.items():
        kept = where_all(df, name, clauses)
        for key, keys in key_sets:
            kept = propagate_semi(kept, keys, key, keep_nulls)
        out[name] = kept
    return out
