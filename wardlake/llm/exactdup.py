"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. One pass over the texts takes a digest of each normalised text: SHA-256, code points. The digests are stored; each
   stored part knows its number.
2. Every part sorts the first ``BITS`` bits of its digests, cuts them by owner (equal ranges of values) and sends the
   Golomb-Rice coded differences, about 30 bits for each text.
3. An owner decodes what all parts sent, finds the values that occur twice or more, and returns to each part a bitmap over
   what that part had sent. A part marks its suspects by it.
4. Only texts of suspects are shuffled, to be compared byte by byte: they are grouped by the normalised text itself, and
   copies collapse in every task before the shuffle, so a text that is a third of all rows meets nobody's memory.
   Fingerprints that agree by chance part again here.
Of equal texts the row with the most code points stays, then the one with the smallest id.

Edge cases: null text counts as empty; texts of blanks only are equal to the empty text. Null ids are the largest in a
tie. Repeated rows are rows of one group: each is returned, one of them is marked kept. An empty table gives no rows.
Other columns are ignored by ``mark`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlake.llm.common import BLANKS, drop_matching, keep_matching
from wardlake.session import durable

#: Bits of a fingerprint. Values that agree by chance only cost a comparison.
BITS = 48
#: Fingerprints that one owner decodes at a time.
OWNED = 2_000_000
#: Texts that a task holds as Python objects.
SLICE = 512


def normal(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace").translate(None, BLANKS)


def golomb_encode(sorted_values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients, binary remainders of the differences of sorted numbers."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    mean = float(sorted_values[-1]) / len(sorted_values) if len(sorted_values) else 0.0
    k = max(0, int(np.log2(mean * 0.69))) if mean * 0.69 >= 1 else 0
    quotients = (steps >> np.uint64(k)).astype(np.int64)
    # A quotient q is q ones and a zero; all bits are one but for the ends.
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    remainders = ((steps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(remainders.ravel()).tobytes()


def golomb_decode(k: int, n: int, unary: bytes, remainders: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(unary, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    steps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * k).reshape(n, k)
        steps |= low.astype(np.uint64) @ (np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64))
    return np.cumsum(steps, dtype=np.uint64)


def row_key(doc_id: str, text: str) -> Column:
    """Stands for a row; only repeated rows share it."""
    return F.xxhash64(doc_id, text)


def first_bits(digests: list, bits: int) -> pa.Array:
    return pa.array([int.from_bytes(d.digest()[:8], "big") >> (64 - bits) for d in digests], pa.int64())


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of Arrow batches, with the texts of their last column; those of one slice only are alive as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            yield piece, piece.column(piece.num_columns - 1).to_pylist()
    pa.default_memory_pool().release_unused()  # workers live on and others need the memory


def digests(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, row_key, n_points, sha, print, part: one row per document, stored."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in sliced(batches, SLICE):
            found = [hashlib.sha256(normal(value)) for value in texts]
            yield pa.RecordBatch.from_arrays([
                piece.column(0), piece.column(1),
                pa.array([0 if value is None else len(value) for value in texts], pa.int64()),
                pa.array([h.hexdigest() for h in found], pa.string()), first_bits(found, BITS),
            ], names=["doc_id", "row_key", "n_points", "sha", "print"])

    rows = docs.select("doc_id", row_key("doc_id", text).alias("row_key"), F.col(text).alias("text"))
    rows = rows.mapInArrow(digest, "doc_id bigint, row_key bigint, n_points bigint, sha string, print bigint")
    return durable(rows.withColumn("part", F.spark_partition_id()))


def suspects(stored: DataFrame, owners: int) -> DataFrame:
    """The fingerprints that more than one document has, found by the exchange; distinct values."""
    width = -(-(1 << BITS) // owners)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, values in _by_part(frames):
            cuts = np.searchsorted(values, np.arange(owners + 1, dtype=np.uint64) * np.uint64(width))
            rows = []
            for owner, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    k, unary, low = golomb_encode(values[a:b] - np.uint64(owner * width))
                    rows.append((owner, part, int(b - a), k, unary, low))
            yield pd.DataFrame(rows, columns=["owner", "part", "n", "k", "unary", "low"])

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        sent = [golomb_decode(*row) for row in zip(frame["k"], frame["n"], frame["unary"], frame["low"])]
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        twice = values[counts > 1]
        maps = [np.packbits(np.isin(x, twice)).tobytes() for x in sent]
        pack = zstandard.ZstdCompressor(level=1).compress
        return pd.DataFrame({"owner": frame["owner"], "part": frame["part"], "bitmap": [pack(m) for m in maps]})

    def receive(key, rows: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(rows["print"].to_numpy(np.uint64))
        maps = maps.sort_values("owner")
        starts = np.searchsorted(values, np.arange(owners + 1, dtype=np.uint64) * np.uint64(width))
        marked = []
        for owner, bitmap in zip(maps["owner"], maps["bitmap"]):
            a, b = starts[owner], starts[owner + 1]
            bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bitmap), np.uint8), count=b - a)
            marked.append(values[a:b][bits == 1])
        found = np.unique(np.concatenate(marked)) if marked else np.empty(0, np.uint64)
        return pd.DataFrame({"print": found.astype(np.int64)})

    prints = stored.select("part", "print")
    blobs = prints.mapInPandas(send, "owner int, part int, n bigint, k int, unary binary, low binary")
    maps = blobs.groupBy("owner").applyInPandas(own, "owner int, part int, bitmap binary")
    back = prints.groupBy("part").cogroup(maps.groupBy("part")).applyInPandas(receive, "print bigint")
    return durable(back.distinct())


def _by_part(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted fingerprints of each part of a stored table; a task reads one part, or small parts one after another."""
    held: dict[int, list[np.ndarray]] = {}
    for frame in frames:
        for part, rows in frame.groupby("part"):
            held.setdefault(int(part), []).append(rows["print"].to_numpy(np.uint64))
    for part, values in held.items():
        yield part, np.sort(np.concatenate(values))


def mark(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    stored = digests(rows, "text")
    n = stored.count()
    found = suspects(stored, -(-n // OWNED) or 1)
    many = found.count()

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in sliced(batches, SLICE):
            body = [normal(value) for value in texts]
            shas = [hashlib.sha256(b) for b in body]
            yield pa.RecordBatch.from_arrays([
                piece.column(0), piece.column(1), pa.array(body, pa.binary()),
                pa.array([h.hexdigest() for h in shas], pa.string()), first_bits(shas, BITS),
            ], names=["doc_id", "n_points", "body", "sha", "print"])

    points = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    bodies = rows.select("doc_id", points.alias("n_points"), "text").mapInArrow(
        normalised, "doc_id bigint, n_points bigint, body binary, sha string, print bigint"
    )
    # Most code points, then the smallest id, nulls last: the greatest of these structs.
    rank = F.struct("n_points", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id").alias("back"))
    groups = keep_matching(bodies, found, "print", many).groupBy("body").agg(
        F.first("sha").alias("sha"), F.count("*").alias("group_size"), F.max(rank).alias("best")
    )
    groups = durable(
        groups.filter("group_size > 1").select(
            F.col("sha").alias("text_sha256"), F.bitwise_not("best.back").alias("keep_id"), "group_size",
            F.col("best.n_points").alias("most"),
        )
    )
    twin = stored.select("doc_id", "row_key", "n_points", F.col("sha").alias("text_sha256"))
    joined = twin.join(groups, "text_sha256", "left")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "row_key"]
    single = joined.filter("group_size IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "row_key",
    )
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("most"))
    copies = joined.filter("group_size IS NOT NULL").withColumn("kept", best)
    # Rows that equal the kept one in id and text: the first stays.
    first = F.row_number().over(W.partitionBy("text_sha256", "row_key").orderBy("n_points")) == 1
    stays = copies.filter("kept").withColumn("kept", first)
    return single.unionByName(copies.filter(~F.col("kept")).select(columns)).unionByName(stays.select(columns))


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    marked = mark(docs, text).filter("group_size > 1")
    keys = marked.groupBy("row_key").agg(F.count(F.when(F.col("kept"), 1)).alias("stay"), F.count("*").alias("rows"))
    keys = durable(keys.filter("stay < rows"))
    gone = keys.filter("stay = 0").select(F.col("row_key").alias("__row"))
    again = keys.filter("stay > 0").select(F.col("row_key").alias("__row"))
    named = docs.withColumn("__row", row_key("doc_id", text))
    sizes = {r["stay"] > 0: r["n"] for r in keys.groupBy((F.col("stay") > 0).alias("stay")).agg(F.count("*").alias("n")).collect()}
    left = drop_matching(named, gone, "__row", sizes.get(False, 0))
    if sizes.get(True):  # repeated rows of which one stays
        once = keep_matching(left, again, "__row", sizes[True]).dropDuplicates(["__row"])
        left = drop_matching(left, again, "__row", sizes[True]).unionByName(once)
    return left.select(docs.columns)
