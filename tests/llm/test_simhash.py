import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from wardlake.llm import queries, simhash


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Label of every fingerprint: the smallest place it reaches over pairs of 3 or fewer differing bits."""
    label = list(range(len(fps)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for start in range(len(fps)):
        if label[start] != start:
            continue
        todo = [start]
        while todo:
            at = todo.pop()
            for other in np.flatnonzero(near[at]).tolist():
                if label[other] > start:
                    label[other] = start
                    todo.append(other)
    return label


def family(rng, n, bits):
    """Distinct fingerprints within some bits of one."""
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    out = {int(base)}
    while len(out) < n:
        out.add(int(base) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, bits + 1), replace=False)))
    return np.array(sorted(out), np.uint64)


def joined_by(edges, fps):
    place = {int(f): i for i, f in enumerate(fps)}
    forest = simhash.Forest(len(fps))
    a, b = (np.array([place[int(np.int64(x).view(np.uint64))] for x in edges[c]], np.int64) for c in ("a", "b"))
    forest.join(a, b)
    return forest.label.tolist()


@pytest.mark.parametrize("text", [None, "", " \t", "one", "One TWO", "a b c d a b c", "Ünï Ж日 x \x85y \x1c z", "w " * 500])
def test_fingerprint_of_a_text(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_gray_order_and_tables_lose_nothing():
    fps = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for table in range(len(simhash.TABLES)):
        moved = simhash._moved(fps, table)
        assert (simhash._moved(moved, table, back=True) == fps).all()
        assert (simhash.gray_code(simhash.gray_rank(moved)) == moved).all()
    ranks = np.arange(100, dtype=np.uint64)
    assert (np.bitwise_count(np.diff(simhash.gray_code(ranks))) >= 1).all()
    assert (simhash.gray_rank(simhash.gray_code(ranks)) == ranks).all()


@pytest.mark.parametrize("n,bits", [(2, 1), (40, 2), (700, 3), (3000, 6), (1500, 12)])
def test_index_links_what_brute_force_links(n, bits):
    rng = np.random.default_rng(n)
    fps = np.unique(np.concatenate([family(rng, n, bits), rng.integers(0, 1 << 63, n, dtype=np.uint64)]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    forest = simhash.Forest(len(fps))
    simhash.GrayIndex(fps).link(forest)
    assert forest.label.tolist() == plain_components(fps)


def test_index_prunes_groups(monkeypatch):
    looked = []
    leaves = simhash.GrayIndex._leaves
    monkeypatch.setattr(simhash.GrayIndex, "_leaves", lambda self, i, j, f: (looked.append(len(i)), leaves(self, i, j, f))[1])
    rng = np.random.default_rng(5)
    fps = np.unique(np.concatenate([family(rng, 128, 2) for _ in range(16)]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    simhash.GrayIndex(fps).link(simhash.Forest(len(fps)))
    many = -(-len(fps) // simhash.LEAF)
    assert sum(looked) < many * (many + 1) // 2 / 2


@pytest.mark.parametrize("leaf,piece,batch", [(32, 4096, 10_000), (4, 16, 50), (3, 5, 7), (8, 64, 1)])
def test_ranges_that_cut_runs_lose_no_link(monkeypatch, leaf, piece, batch):
    """Ranges, batches and pieces of any size give the components of all pairs."""
    for name, value in (("LEAF", leaf), ("PIECE", piece)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(batch)
    fps = np.unique(np.concatenate([family(rng, 150, 4), family(rng, 150, 2), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    placed = pd.concat(simhash._placed([pd.DataFrame({"fp": fps.view(np.int64)})])).sort_values(["tab", "rank"], ignore_index=True)
    cuts = [0, 100, 101, 900, 2000, len(placed)]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        found += list(simhash._search(placed[i : min(b, i + batch)] for i in range(a, b, batch)))
    found = pd.concat(found, ignore_index=True)
    pieces = found[found["piece"].notna()]
    assert pieces["piece"].map(len).max() <= 8 * piece
    pairs = pieces.merge(pieces, on="run", suffixes=("", "2"))
    pairs = pairs[pairs["piece"] < pairs["piece2"]][["piece", "piece2"]].set_axis(["piece", "other"], axis=1)
    edges = pd.concat([found[found["piece"].isna()][["a", "b"]], *simhash._meet([pairs])])
    assert joined_by(edges, fps) == plain_components(fps)


def plain_result(rows):
    fps = np.array([plain_fingerprint(r["text"]) for r in rows], np.uint64)
    label = plain_components(fps)
    least = {}
    for r, at in zip(rows, label):
        if r["doc_id"] is not None:
            least[at] = min(least.get(at, r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], f"{int(f):016x}", least.get(at)) for r, f, at in zip(rows, fps, label)), key=str)


def test_edges(edge, empty):
    got = sorted(map(tuple, simhash.near_duplicates(edge).collect()), key=str)
    assert got == plain_result(edge.collect())
    by_id = {g[0]: g for g in got}
    assert by_id[3][1] == "0" * 16 and by_id[3][2] == by_id[4][2] == by_id[5][2] == 3
    assert simhash.near_duplicates(empty).count() == 0


def test_a_family_of_a_third_of_the_rows(spark):
    """One text with single words changed, and copies of it, among others."""
    body = [f"word{i}" for i in range(400)]
    texts = [" ".join(body[:i] + [f"x{i}"] + body[i + 1 :]) for i in range(150)] + [" ".join(body)] * 100
    texts += [f"other text {i} with {i * 7} numbers of {i * 31}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == plain_result(docs.collect())


def test_query_equals_brute_force(spark, small):
    got = queries.QUERIES["op12_simhash_dedup"](spark, small)
    assert dict(got.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect()), key=str) == plain_result(docs)


def test_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id int, text string")
    docs = docs.withColumns({c: F.lit("own") for c in ("fp", "named", "label", "least", "piece", "run", "fingerprint")})
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1}
