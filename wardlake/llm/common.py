"""What several operators share: folds, hashing of tokens, joins behind a size check."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words in every contract: space and the control characters 9 to 13.
BLANKS = b" \t\n\x0b\x0c\r"
# Rows of one long (or of a few) that every task may hold as a broadcast table: 32 MB at the most.
BROADCAST_ROWS = 1_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z in lower case. ``bytes.split`` cuts at exactly the six blanks, ``lower`` touches ASCII only."""
    return [] if text is None else text.encode("utf-8", "replace").lower().split()


class WordHash:
    """64-bit hashes of words. The memory of known words is a cache with a bound, it never changes a result."""

    def __init__(self, bound: int = 500_000) -> None:
        self.known: dict[bytes, int] = {}
        self.bound = bound

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            for w in set(tokens):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as compressed byte planes of their differences."""
    if not len(numbers):
        return b""
    steps = np.diff(numbers, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, mostly small, as compressed byte planes."""
    if not len(numbers):
        return b""
    planes = np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_counts(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.uint32)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def keep_matching(df: DataFrame, keys: DataFrame, on: str, rows: int) -> DataFrame:
    """Semi join on one column. ``rows``: how many ``keys`` were counted; only few of them are broadcast."""
    return df.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, on, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on: str, rows: int) -> DataFrame:
    """Anti join on one column that is never null, with the same bound."""
    return df.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, on, "left_anti")


def batches(frames: Iterable, weight, most: int):
    """Regroup the rows of Arrow batches into lists of bounded total weight (one row may weigh more by itself)."""
    held, total = [], 0
    for frame in frames:
        for row in frame.itertuples(index=False, name=None):
            w = weight(row)
            if held and total + w > most:
                yield held
                held, total = [], 0
            held.append(row)
            total += w
    if held:
        yield held


def in_slices(function, schema: pa.Schema, rows: int = 512):
    """A function over frames for ``mapInArrow``, which gets ``rows`` rows at a time.

    An Arrow batch may hold ten thousand long texts; as Python objects only those of a slice are alive. What Arrow has kept
    for its next batch is given back at the end of the task, as workers live on and others need the memory.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        def frames():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows).to_pandas()

        for frame in function(frames()):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)
        pa.default_memory_pool().release_unused()

    return run
