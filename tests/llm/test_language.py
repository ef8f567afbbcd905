import zlib

import numpy as np

from wardlake.llm import langid, queries


def test_held_out_accuracy_and_folds(spark, small):
    found = queries.QUERIES["op1_language_id"](spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(found)
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both["doc_id"]]).all()
    held = both[both["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    assert both["score"].between(0, 1).all()


def test_slices_and_batches_give_the_same_grams():
    text = "abc défg " * 40_000
    parts = list(langid.grams(text))
    assert len(parts) > 1
    joined = np.bincount(np.concatenate(parts), minlength=langid.BUCKETS)
    clean = f" {text.strip()} "
    assert joined.sum() == sum(len(clean) - n + 1 for n in range(1, langid.ORDERS + 1))


def test_scores_equal_a_plain_naive_bayes(spark):
    train = spark.createDataFrame([("aa ab", "x"), ("bb ba", "y"), ("bb", "y"), (None, "x"), ("zz", None)], "text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["x", "y"]
    np.testing.assert_allclose(np.exp(model.prior), [1 / 3, 2 / 3])
    np.testing.assert_allclose(np.exp(model.weights).sum(axis=0), [1, 1])
    [[row]] = [spark.createDataFrame([("aa",)], "text string").transform(lambda d: langid.predict(d, model)).collect()]
    logs = model.prior + sum(model.weights[b].sum(axis=0) for b in langid.grams("aa"))
    assert row["lang_pred"] == "x" and abs(row["score"] - 1 / (1 + np.exp(logs[1] - logs[0]))) < 1e-12


def test_edges(edge, empty):
    model = langid.fit(edge)
    found = langid.predict(edge, model)
    assert found.count() == edge.count() and sorted(found.columns) == sorted(edge.columns)
    rows = found.filter("doc_id in (3, 4, 5, 6)").select("lang_pred", "score").collect()
    assert [tuple(r) for r in rows] == [("und", 0.0)] * 4
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {tuple(r) for r in langid.predict(edge, nothing).select("lang_pred", "score").collect()} == {("und", 0.0)}
