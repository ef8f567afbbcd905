import collections
import re

import numpy as np
import pytest

from compare import connect, difference
from wardlake.llm import divergence, queries


def plain_terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_audit(rows, min_docs=30):
    docs, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        found = plain_terms(r["text"])
        counts[lang, source].update(found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted((t for (of, t), n in docs.items() if of == lang and n >= min_docs), key=str.encode)
        groups = {s: c for (of, s), c in counts.items() if of == lang}
        total = collections.Counter()
        for c in groups.values():
            total.update({t: c[t] for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)
        for s, c in groups.items():
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if c[t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, 50)):
                values.sort(key=lambda v: (-v[1], v[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(values[:most], 1)]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("text", [None, "", "Don't STOP", "a1b_c\x7fd", "Ünï日本\x85x é`e", "[Z]@A{z}"])
def test_terms(text):
    assert [t.decode() for t in divergence.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("trees,present,width,top", [(2, 1, 1, 3), (4, 5, 5, 2), (6, 30, 100, 4), (3, 64, 64, 1000), (5, 0, 7, 2), (2, 0, 0, 2)])
def test_trees_price_what_sums_price(trees, present, width, top):
    counts = np.random.default_rng(width).integers(0, top, (trees, present))
    t = divergence.Trees(counts, width)
    totals = [int(c.sum()) + 5 * width + i for i, c in enumerate(counts)]
    shares = [divergence.share(t.values, total) for total in totals]
    full = np.zeros((trees, width), np.int64)
    full[:, :present] = counts
    plain = [[1 + 10**9 * (int(c) + 5) // total for c in row] for row, total in zip(full, totals)]
    others = np.arange(1, trees)
    want = [sum(abs(a - b) for a, b in zip(plain[0], plain[o])) for o in others]
    assert t.distances(0, others, shares) == want
    for tree in range(trees):
        assert t.counted(tree).tolist() == np.flatnonzero(full[tree]).tolist()


def test_equal_subtrees_are_one_node():
    counts = np.tile(np.random.default_rng(0).integers(0, 5, 64), (3, 16))
    t = divergence.Trees(counts, 1024)
    assert [len(left) for left, _ in t.children[-4:]] == [1, 1, 1, 1]  # every tree repeats one subtree of 64 leaves
    assert len(t.children[0][0]) <= 32


def test_shares_have_no_bound():
    assert divergence.share(np.array([10**15]), 10**15 + 7).tolist() == [1 + 10**9 * (10**15 + 5) // (10**15 + 7)]


def test_query_equals_sql(spark, small):
    assert difference(queries.QUERIES["op11_source_divergence"](spark, small), connect(small), queries.CHECKS["op11_source_divergence"]) is None


def test_edges(edge, empty):
    got = result(divergence.audit(edge))
    assert got == plain_audit(edge.collect())
    assert {g[4] for g in got} == {0} and {g[2] for g in got} == {"pair"}  # no term is in 30 documents
    assert divergence.audit(empty).count() == 0


def test_ties_nulls_hot_sources_and_many_sources(spark):
    rows = [(i, f"alpha beta gamma{i % 3} Delta" + " beta" * (i % 4), "en", "hot" if i % 3 == 0 else f"s{i % 150}") for i in range(600)]
    rows += [(i, "eins zwei", None, None) for i in range(31)] + [(i, None, "xx", f"y{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    got = divergence.audit(docs)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert result(got) == plain_audit(rows_of(docs))


def rows_of(df):
    return [r.asDict() for r in df.collect()]
