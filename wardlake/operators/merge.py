"""Set operations and the insert-only merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_key(column: str) -> Column:
    """Key as text, null as empty text, so that rows without a key match each other."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# Parts over which rows that share a missing key are spread.
SALTS = 64


def spread_salt(missing: Column, columns: Sequence[str]) -> Column:
    """0 for rows with a key; rows without one are spread by all they hold."""
    return F.when(missing, F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")).otherwise(0)


def all_salts(missing: Column) -> Column:
    """The salts for which a key stands: a missing key for all of them."""
    return F.when(missing, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))


def key_hashes(keys: Sequence[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the null-safe keys from different starts, 128 bits in all.

    Each part is hashed onto the hash of those before it, so no two tuples run together.
    """
    parts = [null_safe_key(k) for k in keys]
    return F.xxhash64(*parts), F.xxhash64(F.lit(len(parts)), *parts)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct null-safe key tuples. Copies are dropped before the shuffle, so a hot key costs one row per task."""
    return df.select(*[null_safe_key(k).alias(k) for k in keys]).distinct()


def safe_concat(first: DataFrame | None, second: DataFrame | None) -> DataFrame | None:
    """Append by name: union of the columns in order, missing ones null, columns of unlike type as text.

    A side that is None counts as empty. A frame is never tested for rows, which would run it: a caller that knows
    a side to be empty passes None, and the other side keeps its types.
    """
    if first is None or second is None:
        return second if first is None else first
    types = [{f.name: f.dataType for f in df.schema.fields} for df in (first, second)]
    unlike = [c for c in types[0] if c in types[1] and types[0][c] != types[1][c]]
    sides = [df.withColumns({c: F.col(c).cast("string") for c in unlike}) if unlike else df for df in (first, second)]
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def without(tagged: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose hashes (_k1, _k2) are not among the known ones, which are distinct. Rows without any key are spread."""
    keyless = reduce(lambda a, b: a & b, [null_safe_key(k) == "" for k in keys])
    none = reduce(lambda a, b: a & b, [F.col(n) == h for n, h in zip(("_k1", "_k2"), _hashes_of_nothing(len(keys)))])
    salted = known.select("_k1", "_k2", F.explode(all_salts(none)).alias("_salt"))
    own = [c for c in tagged.columns if c not in ("_k1", "_k2")]
    return tagged.withColumn("_salt", spread_salt(keyless, own)).join(salted, ["_k1", "_k2", "_salt"], "left_anti").drop("_salt")


def _hashes_of_nothing(n: int) -> tuple[Column, Column]:
    """Hashes of a key of which all parts are missing."""
    parts = [F.lit("")] * n
    return F.xxhash64(*parts), F.xxhash64(F.lit(n), *parts)


def new_rows(base: DataFrame | None, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not in base. Copies within the batch are kept; stored keys keep their nulls.

    Both sides meet by two hashes of the key, so a key that holds a whole text costs no more than any other. For a stored
    table with an index of its keys, which spares reading base, see ``wardlake.sources.keyindex``.
    """
    if base is None or not keys:
        return incoming
    k1, k2 = key_hashes(keys)
    known = base.select(k1.alias("_k1"), k2.alias("_k2")).distinct()
    return without(incoming.withColumns({"_k1": k1, "_k2": k2}), known, keys).drop("_k1", "_k2")


def merge_insert_only(base: DataFrame | None, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base as it is, plus the new rows. Without keys: plain append.

    To grow a stored table, append ``new_rows`` to it: base need not be rewritten.
    """
    return safe_concat(base, new_rows(base, incoming, keys))


def append_no_key(base: DataFrame | None, incoming: DataFrame) -> DataFrame:
    return merge_insert_only(base, incoming, [])


def delete_by_id(df: DataFrame, ids: DataFrame | Sequence[str], column: str) -> DataFrame:
    """Rows whose id is not listed; rows without an id stay. A list of any size can come as a DataFrame."""
    if isinstance(ids, DataFrame):
        gone = ids.select(F.col(ids.columns[0]).cast("string").alias("_id"))
        own = F.col(column).cast("string")
        # Rows without an id match nothing; a second form of the key keeps them from meeting in one task.
        spread = F.concat(F.lit("#"), F.xxhash64(*df.columns).cast("string"))
        keyed = df.withColumn("_key", F.coalesce(own, spread))
        return keyed.join(gone, (F.col("_key") == F.col("_id")) & (own == F.col("_id")), "left_anti").drop("_key")
    listed = F.col(column).cast("string").isin([str(i) for i in ids])
    return df.filter(F.col(column).isNull() | ~listed)
