import inspect

import corpus_pipeline
from wardlake.llm import langid, mixing, queries
from wardlake.session import scratch

from test_duplicates import brute_exact, brute_links
from test_tokens import digests, reference  # noqa: F401


def kept(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_against_plain_versions(spark, small, reference):  # noqa: F811
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        path = scratch(spark, "test-stage")
        stage(spark, docs, small).write.parquet(path)
        out = spark.read.parquet(path)
        rows = docs.collect()
        if name == "language_id":
            assert kept(out) == sorted(r["doc_id"] for r in rows if langid.has_letter(r["text"]))
        elif name == "exact_dedup":
            assert kept(out) == sorted({k for _, k, _ in brute_exact(rows)})
        elif name == "near_dedup":
            pairs = [(r["doc_id"], r["text"]) for r in rows]
            assert kept(out) == sorted({c for _, _, c in brute_links(pairs, 5, 80)})
        elif name == "mix_sources":
            sizes = {r["source"]: r["target"] for r in mixing.targets(
                docs.select("source", mixing.words_in("text").alias("size"))).collect()}
            taken = {r["source"]: r["n"] for r in out.withColumn("n", mixing.words_in("text")).groupBy("source").agg({"n": "sum"}).toDF("source", "n").collect()}
            assert all(abs(taken.get(s, 0) - t) < 6000 for s, t in sizes.items())
        else:
            assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == digests(reference, [(r["doc_id"], r["text"]) for r in rows])
        if name != "encode":
            assert out.columns == columns
        docs = out
    assert docs.count() == corpus_pipeline.run(spark, small).count() > 0


def test_stages_on_edge_cases(spark, edge, empty, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, small)
        assert out.count() <= 3 * edge.count()
        if name != "encode":
            assert out.columns == edge.columns
        assert stage(spark, empty, small).count() == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.CHECKS) <= set(queries.QUERIES)
