"""The operators over the given tables, one query each, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import (
    bpe, common, divergence, exactdup, jaccard, langid, mainhtml, mixing, ngramlm, simhash, surrogates, tokenfiles, topk,
    turnrepair,
)
from wardlake.session import scratch

#: The key of the surrogates in the query; a user passes a secret of their own.
SURROGATE_KEY = "public example key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from four of five folds, predict every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = common.fold(F.col("doc_id")) == 0
    model = langid.fit(docs.filter(~held_out & F.col("lang").isNotNull()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op2_exact_top_k", check="""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
               WHERE embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
         s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
               FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


@query("op3_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    manifest = tokenfiles.write(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return tokenfiles.read(spark, folder, manifest)


@query("op6_exact_dedup", check=r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.mark(table(spark, sf_dir, "documents")).drop("row_key")


@query("op8_main_html")
def main_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op9_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.words_in("text").alias("size")), "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_jaccard_join", check=r"""
    WITH RECURSIVE w AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS MATERIALIZED (
        SELECT DISTINCT doc_id, list_aggregate(words[i:i + 3], 'string_agg', ' ') AS shingle
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
               FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS MATERIALIZED (
        SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
              UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY ALL""")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), n=4, percent=85).drop("row_key")


@query("op4_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score(table(spark, sf_dir, "documents"), common.fold(F.col("doc_id")) == 1)


@query("op7_pii_surrogates")
def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


@query("op11_source_divergence", check=r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
    size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
    grp AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
    cnt AS MATERIALIZED (
        SELECT t.lang, source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    own AS (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY ALL),
    p AS MATERIALIZED (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(o.n, 0) + 5 * s.v) AS p,
               1 + 1000000000::HUGEINT * (k.n + 5) // (s.n + 5 * s.v) AS q
        FROM grp g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang
        LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
        LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50""")
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_simhash_dedup")
def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op13_turn_repair", check=r"""
    WITH RECURSIVE key AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                              lambda c: ascii(c)::BIGINT) AS bytes FROM conversations),
    fate AS (
        SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b:
            list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                        lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fate FROM key),
    bad AS (
        SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
               CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM fate JOIN (VALUES (1), (2)) c(k) ON c.k <= CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
    ordered AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM bad),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM ordered),
    f AS MATERIALIZED (
        SELECT *, left(role, 1) AS ini, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1)
                                                 NOT IN ('su', 'ua', 'au'), false) AS illegal,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
    step AS MATERIALIZED (  -- the least costs of a row that stays, by what it becomes: u or a, its own s
        SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stay FROM f),
    ids AS (SELECT conv_id, count(*) AS n FROM bad GROUP BY conv_id),
    g AS (
        SELECT conv_id, n AS i, [0, 10, 5, 0]::BIGINT[] AS c FROM ids
        UNION ALL
        SELECT conv_id, i, [least(h[1], 5 + c2), least(h[2], 5 + c2), c2, least(h[4], 5 + h[3])]
        FROM (SELECT *, least(h[3], 5 + h[4]) AS c2 FROM (
            SELECT g.conv_id, g.i - 1 AS i, [
                least(2 + c[1], u + c[3], stay + CASE WHEN ini = 's' THEN 0 ELSE 1000000 END + c[2]),
                least(2 + c[2], u + c[3]), least(2 + c[3], a + c[4]), least(2 + c[4], u + c[3])] AS h
            FROM g JOIN (SELECT *, stay + CASE WHEN ini = 'u' THEN 0 ELSE 1 END AS u,
                                stay + CASE WHEN ini = 'a' THEN 0 ELSE 1 END AS a FROM step) s
                 ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND s.i = g.i))),
    costs AS MATERIALIZED (SELECT * FROM g),
    walk AS (
        SELECT conv_id, 0::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS body FROM ids
        UNION ALL
        SELECT conv_id, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
               CASE WHEN e = 'D' THEN q WHEN e = 'K' AND ini = 's' THEN 1 ELSE next END, audit || e,
               CASE e WHEN 'D' THEN body WHEN 'K' THEN list_append(body, role || ':' || text)
                      ELSE list_append(body, name || ':' || CASE e WHEN 'R' THEN text ELSE '' END) END
        FROM (
            SELECT w.*, s.role, s.text, s.ini, [2, 2, 3, 2][q + 1] AS next, CASE q WHEN 2 THEN 'assistant' ELSE 'user' END AS name,
                   CASE WHEN 2 + b.c[q + 1] = a.c[q + 1] THEN 'D' WHEN 5 + a.c[[2, 2, 3, 2][q + 1] + 1] = a.c[q + 1] THEN 'I'
                        WHEN (q = 0 AND s.ini IN ('s', 'u') OR q IN (1, 3) AND s.ini = 'u' OR q = 2 AND s.ini = 'a')
                             AND s.stay + b.c[CASE WHEN s.ini = 's' THEN 1 ELSE [2, 2, 3, 2][q + 1] END + 1] = a.c[q + 1] THEN 'K'
                        ELSE 'R' END AS e
            FROM walk w JOIN costs a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i
            LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i + 1
            LEFT JOIN step s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1
            WHERE b.i IS NOT NULL OR w.q IN (1, 2))),
    done AS (
        SELECT w.conv_id, w.audit, sha256(array_to_string(w.body, chr(10))) AS repaired_sha256, c.c[1] AS cost
        FROM walk w JOIN ids ON ids.conv_id IS NOT DISTINCT FROM w.conv_id AND ids.n = w.i
        JOIN costs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = 0 WHERE w.q IN (0, 3)),
    sums AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
           coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a
    LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM a.conv_id""")
def turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.repair(turnrepair.damaged(table(spark, sf_dir, "conversations")))
