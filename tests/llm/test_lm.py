import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from wardlake.llm import common, ngramlm, queries

END = b"\0end"


def train_counts(rows, held):
    words, pairs, contexts, docs = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for (doc_id, text), out in zip(rows, held):
        if out:
            continue
        docs += 1
        before = None
        for w in common.words(text) + [END]:
            words[w] += 1
            pairs[before, w] += 1
            contexts[before] += 1
            before = w
    return words, pairs, contexts


def check(got, rows, held, weights):
    words, pairs, contexts = train_counts(rows, held)
    n, v = sum(words.values()), len(words)
    want = []
    for (doc_id, text), out in zip(rows, held):
        base = score = known = 0
        before, tokens = None, common.words(text) + [END]
        for w in tokens:
            c, f = words[w], contexts[before]
            known += c > 0
            base += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            b = weights.pair[int(math.log2(f))] if f else 0.0
            low = weights.word * c / max(n, 1) + (1 - weights.word) / (v + 1)
            score += math.log10(b * pairs[before, w] / max(f, 1) + (1 - b) * low)
            before = w
        want.append((doc_id, out, len(tokens), known, n, base, score))
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5]
        np.testing.assert_allclose(tuple(a)[5:], b[5:], rtol=1e-9, atol=1e-9)


def spied(monkeypatch):
    seen = []
    real = ngramlm._scorer
    monkeypatch.setattr(ngramlm, "_scorer", lambda w: seen.append(w) or real(w))
    return seen


def test_query_equals_a_plain_model(spark, small, monkeypatch):
    monkeypatch.setattr(ngramlm, "BATCH", 50_000)
    monkeypatch.setattr(ngramlm, "OWNED", 2_000)
    seen = spied(monkeypatch)
    got = queries.QUERIES["op4_lm_scores"](spark, small).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    check(got, rows, held, seen[0])
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert 0 < seen[0].word < 1 and 0 < seen[0].pair.max() < 1


def test_weights_maximise_the_likelihood():
    rng = np.random.default_rng(0)
    ratio, n = np.exp(rng.normal(0, 2, 200)), rng.integers(1, 50, 200).astype(float)
    best = ngramlm.learn(ratio, n)
    value = lambda w: (n * np.log(1 - w + w * ratio)).sum()
    assert all(value(best) >= value(w) - 1e-3 for w in np.linspace(0.001, 0.999, 300))
    assert ngramlm.learn(np.zeros(3), np.ones(3)) <= 1e-5


def test_the_mixture_is_a_distribution(spark, monkeypatch):
    """Over all known words and one unknown, the chances behind any context add up to one."""
    seen = spied(monkeypatch)
    rows = [(i, t) for i, t in enumerate(["a b a c", "b b", "c a b", "d"] * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ngramlm.score(df, F.lit(False)).collect()
    w, (words, pairs, contexts) = seen[0], train_counts(rows, [False] * len(rows))
    n, v = sum(words.values()), len(words)
    for before, f in contexts.items():
        b = w.pair[int(math.log2(f))]
        low = lambda c: w.word * c / n + (1 - w.word) / (v + 1)
        total = sum(b * pairs[before, x] / f + (1 - b) * low(words[x]) for x in words) + (1 - b) * low(0)
        assert abs(total - 1) < 1e-9


def test_edges(edge, empty, monkeypatch):
    seen = spied(monkeypatch)
    held = F.col("doc_id").isin(1, 2)
    got = ngramlm.score(edge, F.coalesce(held, F.lit(False))).collect()
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    check(got, rows, [r[0] in (1, 2) for r in rows], seen[0])
    assert ngramlm.score(empty, F.lit(False)).count() == 0
    alone = ngramlm.score(edge, F.lit(True)).collect()
    assert len(alone) == len(rows) and {r["train_tokens"] for r in alone} == {0} and {r["n_known"] for r in alone} == {0}


def test_weights_do_not_depend_on_the_layout(spark, monkeypatch):
    """All training documents count, in whatever partition they lie; a bucket without held-out tokens is not switched off."""
    seen = spied(monkeypatch)
    rows = [(i, f"a b c {w} a b d") for i, w in enumerate("a b c d e f g h".split() * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    one = df.repartition(4).mapInPandas(lambda frames: iter(()), df.schema).union(df)  # rows behind four empty partitions
    for docs in (df, one, df.repartition(6)):
        got = ngramlm.score(docs, F.lit(False)).collect()
        check(got, rows, [False] * len(rows), seen[-1])
    for w in seen:
        assert w.word == seen[0].word != 0.5 and (w.pair == seen[0].pair).all() and (w.pair > 0).all()
