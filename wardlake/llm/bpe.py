"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts of up to ``CHUNK`` characters are encoded where they lie. Longer ones are cut into overlapping chunks that any
task may take: (1) each chunk is pre-tokenised from its own start, which need not be a true boundary; (2) at each seam
the boundaries of the two neighbours are compared within the overlap, and the first one they share is where they have
resynchronised: since a pre-token depends only on the text from its start, all boundaries after it are the same;
(3) the stretch between two seams is encoded by itself. Only boundaries that the end of a chunk cannot have changed take
part, and only behind a character that is not white space, as a run of white space is split by what follows it. If some
seam of a text has no shared boundary (one run of letters longer than the overlap), that text is encoded as a whole.
Decoding concatenates the bytes of the tokens; it is defined on bytes, so ids may be cut anywhere.

Edge cases: null counts as the empty text, which has no ids. Repeated rows are encoded each. Null document ids are
allowed. Columns other than the id and the text are not returned.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and of the overlap in which neighbours must resynchronise.
CHUNK, OVERLAP = 1 << 16, 1 << 9

@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str):
    """The encoding of a rank file; one per worker process."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode(text: str | None, ranks: str, pattern: str) -> list[int]:
    return encoding(ranks, pattern).encode_ordinary(text or "")


def decode(ids: Iterable[int], ranks: str, pattern: str) -> bytes:
    return encoding(ranks, pattern).decode_bytes(list(ids))


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Starts of pre-tokens that no text after the chunk can move. ``last``: nothing follows the chunk."""
    found, size = [], len(text)
    for m in regex.finditer(pattern, text):
        found.append(m.start())
        if not last and max(m.end() + 2, m.start() + 3) > size:
            break
    return found


def seam_marks(text: str, start: int, size: int, pattern: str) -> tuple[list[int], list[int]]:
    """Boundaries, as places in the document, in the overlaps at the chunk's start and after its end."""
    places = [p for p in boundaries(text, pattern, start + len(text) >= size) if p and not text[p - 1].isspace()]
    return [start + p for p in places if p < OVERLAP], [start + p for p in places if p >= CHUNK]


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids joined by spaces), decoded_sha256, one row per document."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("text"))

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def whole(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for value in batch:
                ids = encode(value, ranks, pattern)
                joined = " ".join(map(str, ids)).encode()
                raw = decode(ids, ranks, pattern)
                out.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    short = rows.filter(F.length("text") <= CHUNK).select("doc_id", whole("text").alias("found"))
    short = short.select("doc_id", "found.*")
    return short.unionByName(_long_texts(rows.filter(F.length("text") > CHUNK), ranks, pattern))


def chunks(rows: DataFrame) -> DataFrame:
    """key, doc_id, part, start, size, text: overlapping chunks of long texts, copies of a row once, dealt out evenly.

    ``key`` stands for the id and the text, so that different texts under one id stay apart.
    """
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(CHUNK))
    cut = rows.select("key", "doc_id", "text", F.posexplode(starts).alias("part", "start")).select(
        "key", "doc_id", "part", "start", F.length("text").alias("size"),
        F.substring("text", F.col("start") + 1, F.lit(CHUNK + OVERLAP)).alias("text"),
    )
    return cut.repartition("key", "part").dropDuplicates(["key", "part"])


def seams(cut: DataFrame, pattern: str) -> DataFrame:
    """key, part, at: where the chunk ``part`` takes over from the one before it; null if they never agree."""

    def marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [seam_marks(*row, pattern) for row in zip(frame["text"], frame["start"], frame["size"])]
            yield pd.DataFrame({
                "key": frame["key"], "part": frame["part"],
                "head": [x[0] for x in found], "tail": [x[1] for x in found],
            })

    marked = cut.select("key", "part", "start", "size", "text").mapInPandas(
        marks, "key string, part int, head array<int>, tail array<int>"
    )
    heads = marked.filter("part > 0").select("key", "part", F.col("head").alias("places"))
    tails = marked.select("key", (F.col("part") + 1).alias("part"), F.col("tail").alias("places"))
    # Two rows per seam; the first place that both name.
    places = heads.withColumn("side", F.lit(0)).unionByName(tails.withColumn("side", F.lit(1)))
    pair = places.groupBy("key", "part").agg(
        F.max(F.when(F.col("side") == 0, F.col("places"))).alias("head"),
        F.max(F.when(F.col("side") == 1, F.col("places"))).alias("tail"),
    )
    return pair.filter("head IS NOT NULL").select(
        "key", "part", F.array_min(F.array_intersect("head", "tail")).alias("at")
    )


def _long_texts(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))
    rows = rows.withColumn("key", F.sha2(name, 256))
    cut = chunks(rows)
    at = seams(cut, pattern)
    broken = at.filter("at IS NULL").select("key").distinct()

    # The seam before a chunk bounds it on the left, the seam of its successor on the right: one row per chunk.
    sides = at.select("key", "part", F.col("at").alias("left"), F.lit(None).cast("int").alias("right")).unionByName(
        at.select("key", (F.col("part") - 1).alias("part"), F.lit(None).cast("int").alias("left"), F.col("at").alias("right"))
    )
    bounds = sides.groupBy("key", "part").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    first = F.coalesce("left", "start")
    stop = F.coalesce("right", "size")
    pieces = cut.join(broken, "key", "left_anti").join(bounds, ["key", "part"], "left").select(
        "key", "doc_id", "part", F.substring("text", first - F.col("start") + 1, stop - first).alias("text")
    )
    unsplit = rows.join(broken, "key", "left_semi").dropDuplicates(["key"]).select(
        "key", "doc_id", F.lit(0).alias("part"), "text"
    )

    @F.pandas_udf("n_tokens bigint, ids string, raw binary")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            ids = [encode(value, ranks, pattern) for value in batch]
            yield pd.DataFrame({
                "n_tokens": [len(x) for x in ids], "ids": [" ".join(map(str, x)) for x in ids],
                "raw": [decode(x, ranks, pattern) for x in ids],
            })

    parts = pieces.unionByName(unsplit).select("key", "part", encoded("text").alias("found")).select(
        "key", "part", "found.*"
    )
    in_order = F.array_sort(F.collect_list(F.struct("part", "ids", F.hex("raw").alias("raw"))))
    texts = parts.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"), in_order.alias("parts")).select(
        "key", "n_tokens",
        F.sha2(F.array_join(F.filter("parts.ids", lambda x: x != ""), " "), 256).alias("ids_sha256"),
        F.sha2(F.unhex(F.array_join("parts.raw", "")), 256).alias("decoded_sha256"),
    )
    return rows.select("key", "doc_id").join(texts, "key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
