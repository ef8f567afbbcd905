import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from wardlake.llm import common, exactdup, jaccard, queries
from wardlake.llm.components import components


@pytest.mark.parametrize("n,top", [(0, 10), (1, 10), (2000, 1 << 48), (500, 400), (300, 1 << 20)])
def test_golomb_round_trip(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n).astype(np.uint64))
    k, unary, low = exactdup.golomb_encode(values)
    assert (exactdup.golomb_decode(k, n, unary, low) == values).all()
    if n == 2000:
        assert len(unary) + len(low) < 0.85 * 6 * n  # 48-bit numbers


def test_packed_numbers_round_trip():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (common.unpack_sorted(common.pack_sorted(values)) == values).all()
    counts = np.array([0, 1, 2**32 - 1, 7], np.int64)
    assert (common.unpack_counts(common.pack_counts(counts)) == counts).all()
    assert not len(common.unpack_sorted(b"")) and not len(common.unpack_counts(b""))


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[exactdup.normal(r["text"])].append(r)
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for r in members:
            out.append((r["doc_id"], best["doc_id"], len(members)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,owned", [(48, 2_000_000), (4, 3)])
def test_exact_groups(edge, monkeypatch, bits, owned):
    """Few bits make most fingerprints agree by chance; the comparison of the bytes tells them apart."""
    monkeypatch.setattr(exactdup, "BITS", bits)
    monkeypatch.setattr(exactdup, "OWNED", owned)
    got = exactdup.mark(edge).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute_exact(edge.collect())
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in got}


def test_exact_groups_take_texts_in_slices(edge, monkeypatch):
    """Groups do not depend on the slices, and no more texts than a slice holds are alive at a time."""
    monkeypatch.setattr(exactdup, "SLICE", 2)
    got = exactdup.mark(edge).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"]) for r in got], key=str) == brute_exact(edge.collect())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a", None, "b"]})
    assert [texts for _, texts in exactdup.sliced([batch], 2)] == [["a", None], ["b"]]


def test_deduplicate(edge, empty):
    left = exactdup.deduplicate(edge)
    assert left.columns == edge.columns
    ids = sorted(r["doc_id"] for r in left.select("doc_id").collect())
    assert ids == [2, 5, 6, 7, 8, 9, 10, 11, 12]  # 2 has one more character than 1; 5 is longer than the empty 3 and 4
    assert exactdup.deduplicate(empty).count() == 0 and exactdup.mark(empty).count() == 0


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op10_jaccard_join"])
def test_queries_equal_sql(spark, small, name):
    assert difference(queries.QUERIES[name](spark, small), connect(small), queries.CHECKS[name]) is None


def brute_links(rows, n, percent):
    sets = []
    for doc_id, text in rows:
        w = common.words(text)
        size = min(n, len(w))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        known = [m for m in members if m is not None]
        out.append((doc_id, len(sets[i]), (min(known) if known else None) if sets[i] else doc_id))
    return sorted(out, key=str)


def near_rows(seed, count):
    """Families of texts, each a few words away from another; shared passages; short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(25)]
    for i in range(count):
        if rows and rng.random() < 0.6:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                at = rng.randrange(len(text))
                kind = rng.random()
                text[at : at + (kind > 0.3)] = [rng.choice(vocabulary)] if kind < 0.6 else []
                text = text or ["w1"]
        else:
            text = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 200]))]
            if rng.random() < 0.5:
                text = passage + text
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,n,percent,members", [(1, 4, 85, 1024), (2, 5, 80, 5), (3, 1, 60, 8), (4, 3, 80, 1024)])
def test_links_equal_brute_force(spark, monkeypatch, seed, n, percent, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "SENT", 2000)
    monkeypatch.setattr(jaccard, "OWNED", 200)
    rows = near_rows(seed, 250)
    got = jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), n, percent)
    assert sorted(((r[0], r[1], r[2]) for r in got.collect()), key=str) == brute_links(rows, n, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    schemes = jaccard.Schemes(percent)
    for _ in range(300):
        size = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
        most = 2 * (100 - percent) * len(a) // (100 + percent)
        gone = int(rng.integers(0, most + 1))
        b = np.delete(a, rng.choice(len(a), min(gone, len(a) - 1), replace=False))
        b = np.unique(np.append(b, rng.integers(0, 2**63, most - gone).astype(np.uint64)))
        inter = len(np.intersect1d(a, b))
        if len(a) == len(b) == inter or 100 * inter < percent * (len(a) + len(b) - inter):
            continue
        assert len(np.intersect1d(schemes.signatures(a), schemes.signatures(b)))


def test_jaccard_edges(edge, empty):
    got = jaccard.link(edge, 4, 85).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute_links(
        [tuple(r) for r in edge.select("doc_id", "text").collect()], 4, 85
    )
    left = jaccard.one_of_each(edge, 4, 85)
    ids = collections.Counter(r["doc_id"] for r in left.select("doc_id").collect())
    assert left.columns == edge.columns and ids[7] >= 1 and ids[None] == 0 and ids[2] == 0 and ids[3] == ids[4] == ids[5] == 1
    assert jaccard.link(empty, 4, 85).count() == 0 and jaccard.one_of_each(empty, 4, 85).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 100: 90, 95: 90}
    assert components(links.limit(0)).count() == 0
    star = links.sparkSession.range(1, 500).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    assert components(star).filter("label = 0").count() == 499


@pytest.mark.parametrize("labels", [lambda i: i == 0, lambda i: i % 3])
def test_tasks_of_open_groups_are_bounded(spark, monkeypatch, labels):
    """A large open group is dealt by the rows of its cells; cells of one component are not looked at, no pair is left out."""
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    monkeypatch.setattr(jaccard, "ROWS", 200)
    real = jaccard._compare
    seen = []

    def spy(percent):
        compare = real(percent)

        def bounded(frame):
            assert len(frame) <= 600, f"{len(frame)} rows in one task"
            assert (frame.groupby(["group", "i", "j"])["label"].nunique() > 1).all(), "a cell of one component"
            return compare(frame)

        return bounded

    class Texts:
        sketches = spark.range(1000, 1320).select(F.col("id").alias("cls"), F.lit(bytes(jaccard.BINS)).alias("shape"))

    def verified(pairs, texts, percent):
        seen.append({(r["a"], r["b"]) for r in pairs.collect()})
        return pairs.select("a", "b")

    monkeypatch.setattr(jaccard, "_compare", spy)
    monkeypatch.setattr(jaccard, "_verified", verified)
    first = {}
    for i in range(320):
        first.setdefault(labels(i), 1000 + i)
    pairs = spark.createDataFrame(
        [(first[labels(i)], 1000 + i, 9, 9) for i in range(320) if first[labels(i)] != 1000 + i], "a bigint, b bigint, na bigint, nb bigint"
    )
    members = spark.range(1000, 1320).select(
        F.lit(5).cast("bigint").alias("group"), F.col("id").alias("cls"), F.lit(0).cast("bigint").alias("hub"), F.lit(9).cast("bigint").alias("n")
    )
    got = jaccard._link_classes(pairs, members, Texts(), 80)
    assert {r["label"] for r in got.collect()} == {1000} and got.count() == 319
    assert seen[1] == {(1000 + i, 1000 + j) for j in range(320) for i in range(j) if labels(i) != labels(j)}


def test_one_of_each_without_telling_ids(spark):
    """Null ids, and different texts that share the smallest id, leave one document of their group."""
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (None, text + " x"), (None, text + " y"), (None, None), (None, None)]
    rows += [(5, text.upper().replace("W", "v")), (5, text.upper().replace("W", "v") + " z"), (6, text.replace("w", "v"))]
    rows += [(7, "own words only"), (7, "own words only")]
    left = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()
    ids = collections.Counter((r["doc_id"], r["text"] is None) for r in left)
    assert ids == {(None, False): 1, (None, True): 2, (5, False): 1, (7, False): 1}
