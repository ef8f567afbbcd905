import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardlake.llm import bpe, queries, tokenfiles
from wardlake.session import scratch

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return tokenizer


def digests(reference, rows):
    out = []
    for doc_id, text in rows:
        ids = reference.encode_ordinary(text or "")
        joined = " ".join(map(str, ids)).encode()
        out.append((str(doc_id), len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 9), (50, 20), (7, 5)])
def test_chunks_are_stitched_as_if_never_cut(edge, reference, monkeypatch, chunk, overlap):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OVERLAP", overlap)
    docs = edge if chunk > 1000 else edge.filter("length(text) < 1000 or text is null")
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = digests(reference, docs.select("doc_id", "text").collect())
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_op3_equals_the_library(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op3_byte_bpe"](spark, small).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == digests(reference, docs)


def test_no_rows(empty):
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab 'tsé\n\t \x1c1!ß日.,.,)_ ", max_size=60))
def test_stretches_are_encoded_like_whole_texts(text):
    encode = tokenfiles.encoder(JSON)
    want = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert encode(text).tolist() == want


@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000])
def test_planes_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (tokenfiles.unpack_block(tokenfiles.pack_block(ids), n) == ids).all()
    assert tokenfiles.pack_block(np.arange(8, dtype=np.uint32))[3:] == [b""] * 29


def test_files_round_trip(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK", 16)
    docs = [(None, np.arange(3, dtype=np.uint32)), (-5, np.arange(50, dtype=np.uint32)), (7, np.empty(0, np.uint32)), (7, np.full(13, 2**31, np.uint32))]
    assert tokenfiles.write_file(str(tmp_path), "x", docs) == (66, 4)
    back = list(tokenfiles.read_file(str(tmp_path), "x"))
    assert [d for d, _ in back] == [None, -5, 7, 7]
    assert all((a[1] == b[1]).all() for a, b in zip(docs, back))
    (tmp_path / "bad").write_bytes(b"0" * 40)
    with pytest.raises(ValueError):
        list(tokenfiles.read_file(str(tmp_path), "bad"))


def _file_rows(library, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, out = 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op5_equals_the_library(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op5_token_files"](spark, small).orderBy("start").collect()
    assert [tuple(r) for r in got] == _file_rows(library, [tuple(r) for r in docs])


def test_file_edges(spark, edge, empty, library):
    folder = scratch(spark, "files")
    manifest = tokenfiles.write(edge, folder, JSON, 2)
    got = tokenfiles.read(spark, folder, manifest).orderBy("start").collect()
    assert [tuple(r) for r in got] == _file_rows(library, [tuple(r) for r in edge.select("doc_id", "text").collect()])
    none = tokenfiles.write(empty, folder, JSON, 2)
    assert none.empty and tokenfiles.read(spark, folder, none).count() == 0


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y, z.\n <|endoftext|>", "a <|endoftext b", "plain, text."])
def test_added_tokens_are_encoded_as_the_library_does(text):
    want = Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids
    assert tokenfiles.Encoder(JSON)(text).tolist() == want
