"""Token-id files of bit planes.

A file holds the ids of consecutive documents in ascending order of their id:

    magic | chunk 0 | chunk 1 | ... | document table | index (JSON) | length of the index (8 bytes) | magic

A chunk is a block of ``BLOCK`` ids (the last one of a file may be shorter). Its ids, as 32-bit numbers, are transposed
into 32 bit planes (plane b holds bit b of every id, eight ids to a byte); every plane is compressed by zstandard, and
planes without a set bit take no room. The index names for each chunk its place, the number of ids, and the lengths of
its planes, so that any chunk is read by itself. The document table has the ids and the token counts of the documents.

Documents are dealt to files by ranges of their id. A task encodes its range, writes blocks as they fill up and holds one
block at a time. A file is written under a name of its own per attempt; only the names that the successful attempts
return enter the manifest, so a lost executor or a second attempt can never mix two files.

Edge cases: null text has only the end id. Documents with a null id come first. Repeated rows and ids are kept, rows of
one id in the order of their text. An empty table gives no file. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"PLANES01"
#: Ids of a block; a multiple of 8.
BLOCK = 1 << 18
#: Characters of text per file, so that the index and the document table of a file stay small.
FILE_CHARS = 1 << 27

#: A space behind anything but white space starts a pre-token under every byte-level pattern.
_CUT = re.compile(r"(?<=\S)(?= )")
#: A stop or comma behind anything but a letter or digit, and white space but for space and line end: not cut by the rule above.
_ODD = re.compile(r"[.,](?<![^\W_].)|[^\S \n]")
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_HEADS = frozenset("\n.,")
#: What a piece of a text that is cut at spaces only may not start with, to be known by what is behind its space.
_PLAIN = frozenset(["", " ", "\t", "\n", ".", ","])


def pack_block(ids: np.ndarray) -> list[bytes]:
    """32 compressed bit planes of a block of unsigned 32-bit ids; empty where no bit is set."""
    compress = zstandard.ZstdCompressor(level=1).compress
    planes = [b""] * 32
    octets = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    for i in range(4):
        octet = np.ascontiguousarray(octets[:, i])
        used = int(np.bitwise_or.reduce(octet)) if len(octet) else 0
        for bit in range(8):
            if used >> bit & 1:
                planes[8 * i + bit] = compress(np.packbits(octet & np.uint8(1 << bit)).tobytes())
    return planes


def unpack_block(planes: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    expand = zstandard.ZstdDecompressor().decompress
    for bit, plane in enumerate(planes):
        if plane:
            bits = np.unpackbits(np.frombuffer(expand(plane), np.uint8), count=n)
            ids |= bits.astype(np.uint32) << np.uint32(bit)
    return ids


class Encoder:
    """Ids of texts by a tokenizer file. Stretches between spaces are encoded once and remembered.

    The memory has two halves: what is used moves to the young one; when that is full it becomes the old one, and what was
    not used since is forgotten. So its size is bounded and what is frequent stays.
    """

    def __init__(self, path: str, bound: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():  # a byte-level token has one character per byte
            self.sizes[number] = len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bound = bound

    def _learn(self, pieces: list[str]) -> None:
        """Pieces as they stand behind a space, or with a head of their own, or (marked by a tab in front) as they are."""
        young, old, new = self.young, self.old, []
        for p in pieces:
            ids = old.get(p)
            if ids is None:
                new.append(p)
            else:
                young[p] = ids
        joined = []
        for p in new:
            if p[:1] == "\t" or p[:1] in _HEADS or p[-1:].isspace() or not p:
                whole = p[1:] if p[:1] == "\t" else p if p[:1] in _HEADS else " " + p
                young[p] = np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, np.uint32).tobytes()
            else:
                joined.append(p)
        if not joined:
            return
        # Pieces that start with a space and do not end in one keep their ids when put together.
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(joined)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self.sizes[ids])
        lengths = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in joined), np.int64, len(joined)) + 1
        stops = (4 * (np.searchsorted(ends, np.cumsum(lengths)) + 1)).tolist()
        raw, start = ids.tobytes(), 0
        for p, stop in zip(joined, stops):
            young[p] = raw[start:stop]
            start = stop

    def _ids(self, pieces: list[str]) -> np.ndarray:
        if len(self.young) > self.bound:
            self.young, self.old = {}, self.young
        if new := set(pieces).difference(self.young):
            self._learn(list(new))
        return np.frombuffer(b"".join(map(self.young.__getitem__, pieces)), np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if any(t in text for t in self.added):  # cut by the library alone, so that no piece holds an added token
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if any(d in text for d in _DOUBLE) or _ODD.search(text):
            first, *pieces = _CUT.split(text)
            return self._ids(["\t" + first, *(p[1:] if p[1:2] not in _PLAIN else "\t" + p for p in pieces)])
        # White space stands alone everywhere: a space belongs to the word behind it. A line end, and a stop or comma
        # behind a word, starts a pre-token too; it is kept at the head of its piece, which then has no space.
        first, *pieces = text.replace("\n", " \n").replace(".", " .").replace(",", " ,").split(" ")
        return self._ids(["\t" + first, *pieces])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def open_file(folder: str, name: str, mode: str):
    """A file in a shared folder, by whatever file system its address names."""
    from pyarrow import fs

    if "://" not in folder and folder.startswith("file:"):
        folder = folder.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    if mode == "w":
        system.create_dir(path, recursive=True)
        return system.open_output_stream(f"{path}/{name}")
    return system.open_input_file(f"{path}/{name}")


def write_file(folder: str, name: str, documents: Iterable[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Write the ids of documents; returns how many ids and documents."""
    chunks, doc_ids, counts, held, size, at = [], [], [], [], 0, len(MAGIC)
    with open_file(folder, name, "w") as out:

        def put(ids: np.ndarray) -> None:
            nonlocal at
            planes = pack_block(ids)
            chunks.append([at, len(ids), [len(p) for p in planes]])
            at += out.write(b"".join(planes)) or sum(map(len, planes))

        out.write(MAGIC)
        for doc_id, ids in documents:
            doc_ids.append(doc_id)
            counts.append(len(ids))
            held.append(ids)
            size += len(ids)
            if size >= BLOCK:
                joined = np.concatenate(held)
                for i in range(0, size - size % BLOCK, BLOCK):
                    put(joined[i : i + BLOCK])
                held, size = [joined[size - size % BLOCK :]], size % BLOCK
        if size:
            put(np.concatenate(held))
        missing = np.array([d is None for d in doc_ids], np.uint8)
        known = np.array([0 if d is None else d for d in doc_ids], np.int64)
        parts = [missing.tobytes(), known.tobytes(), np.array(counts, np.int64).tobytes()]
        documents_at, packed = at, zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
        index = {"chunks": chunks, "documents": [documents_at, len(packed), len(doc_ids)]}
        tail = json.dumps(index).encode()
        out.write(packed + tail + len(tail).to_bytes(8, "little") + MAGIC)
    return sum(counts), len(counts)


def read_file(folder: str, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in the order of the file; holds one chunk and one document at a time."""
    with open_file(folder, name, "r") as file:

        def piece(at: int, size: int) -> bytes:
            file.seek(at)
            return file.read(size)

        end = file.size()
        tail = piece(end - 16, 16)
        if tail[8:] != MAGIC or piece(0, 8) != MAGIC:
            raise ValueError(f"{name} is not a file of token ids")
        length = int.from_bytes(tail[:8], "little")
        index = json.loads(piece(end - 16 - length, length))
        at, size, n = index["documents"]
        table = zstandard.ZstdDecompressor().decompress(piece(at, size)) if n else b""
        missing = np.frombuffer(table[:n], np.uint8)
        known, counts = np.frombuffer(table[n:], np.int64).reshape(2, n)

        def blocks() -> Iterator[np.ndarray]:
            for start, many, lengths in index["chunks"]:
                data, ends = piece(start, sum(lengths)), np.cumsum([0, *lengths])
                yield unpack_block([data[a:b] for a, b in zip(ends, ends[1:])], many)

        source, rest = blocks(), np.empty(0, np.uint32)
        for no, doc_id, count in zip(missing, known, counts):
            parts, have = [rest], len(rest)
            while have < count:
                parts.append(next(source))
                have += len(parts[-1])
            joined = np.concatenate(parts) if len(parts) > 1 else rest
            rest = joined[count:]
            yield (None if no else int(doc_id)), joined[:count]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text") -> pd.DataFrame:
    """Write the files; the manifest (file, first id of the file in the whole, ids, documents), one row per file."""
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(  # null ids as a flag: pandas would turn the others into floating-point numbers
        doc_id.isNotNull().alias("named"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chars = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(4 * cores if chars > 1 << 22 else 1, -(-chars // FILE_CHARS))
    dealt = rows.repartitionByRange(files, "named", "doc_id").sortWithinPartitions("named", "doc_id", "text")

    def write_range(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for frame in frames:
                for named, doc_id, value in zip(frame["named"], frame["doc_id"], frame["text"]):
                    yield int(doc_id) if named else None, np.append(encode(value), np.uint32(end_id))

        from pyspark import TaskContext

        name = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.planes"
        ids, many = write_file(folder, name, documents())
        if many:
            yield pd.DataFrame({"place": [TaskContext.get().partitionId()], "file": [name], "ids": [ids], "docs": [many]})

    written = dealt.mapInPandas(write_range, "place int, file string, ids bigint, docs bigint")
    manifest = written.toPandas().sort_values("place", ignore_index=True)  # one row per file of 128 MB of text
    manifest["start"] = manifest["ids"].cumsum() - manifest["ids"]
    return manifest


def read(spark: SparkSession, folder: str, manifest: pd.DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files alone."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if manifest.empty:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(manifest[["file", "start"]], "file string, start bigint").repartition(
        len(manifest), "file"
    )

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, start in zip(frame["file"], frame["start"]):
                rows = []
                for doc_id, ids in read_file(folder, name):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return listed.mapInPandas(digests, schema)
