"""Exact top-k search by inner product, with no random access.

The vectors are dealt to shards of bounded size by a hash, the queries to blocks; every (shard, block) cell is a task of
its own. In a cell each dimension has a list of the shard's vectors sorted by their component. Round by round the next
stretch of every list is read, from the top for queries with a positive weight in that dimension and from the bottom for
those with a negative one, and added to the lower bounds. A component not yet read is at most what its list has reached
and at least the far end of the list, which bounds the score of every vector from both sides. A query stops when all but
a few vectors cannot reach its k-th best lower bound; the scores of those few are resolved exactly. The local lists of a
query meet in one ranking per query.

Scores are exact: integers are added as doubles only where no sum can pass 2**53, as 64-bit integers otherwise.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part, neither as queries nor as
candidates. Shorter vectors count as padded with zeros. Ties go to the smaller id. Rows that repeat an id and its vector
are one candidate; a query never finds its own id. Fewer candidates than k give them all. No queries or no vectors give
no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a shard, queries of a block, queries worked on at a time, rounds of reading.
SHARD, QUERIES, AT_ONCE, ROUNDS = 8192, 4096, 128, 16


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = 1024) -> DataFrame:
    """vec_id, x: the components as floor(scale * component); rows that take no part are left out."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.filter(F.col(vec_id).isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("bigint")).alias("x")
    )


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per query the places of its k best vectors in the order (score, smaller id); ``ids`` ascend."""
    n, width = vectors.shape
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, width)
    kind = np.float64 if top < 2**52 else np.int64
    x, found = vectors.astype(kind), []
    order = np.argsort(vectors, axis=0, kind="stable")  # per dimension, smallest component first
    ranked = np.take_along_axis(x, order, axis=0)
    low, high = ranked[0], ranked[-1]
    step = max(1, -(-n // ROUNDS))
    for start in range(0, len(queries), AT_ONCE):
        q = queries[start : start + AT_ONCE].astype(kind)
        plus, minus = np.maximum(q, 0).T, np.minimum(q, 0).T  # dimensions x queries
        added = np.zeros((n, len(q)), kind)
        seen_top, seen_low = np.zeros((n, width), bool), np.zeros((n, width), bool)
        mine = own[start : start + AT_ONCE]
        open_ = np.arange(len(q))
        picked: dict[int, np.ndarray] = {}
        for at in range(0, n, step):
            for d in range(width):
                up, down = order[n - min(n, at + step) : n - at, d], order[at : at + step, d]
                added[up] += x[up, d, None] * plus[None, d]
                added[down] += x[down, d, None] * minus[None, d]
                seen_top[up, d] = True
                seen_low[down, d] = True
            if at + step < n // 4:
                continue  # no bound can hold yet
            reached = min(n, at + step)
            front_top, front_low = ranked[n - reached], ranked[reached - 1]
            unseen_top, unseen_low = (~seen_top).astype(kind), (~seen_low).astype(kind)
            p, m = plus[:, open_], minus[:, open_]
            known = added[:, open_]
            most = known + unseen_top @ (p * front_top[:, None]) + unseen_low @ (m * front_low[:, None])
            least = known + unseen_top @ (p * low[:, None]) + unseen_low @ (m * high[:, None])
            still = []
            for j, query in enumerate(open_):
                own_place = ids == mine[query]
                lower = least[~own_place, j]
                bar = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
                rest = np.flatnonzero((most[:, j] >= bar) & ~own_place)
                if len(rest) <= max(8 * k, n // 64) or reached == n:
                    picked[query] = rest
                else:
                    still.append(query)
            open_ = np.array(still, int)
            if not len(open_):
                break
        for j in range(len(q)):
            rest = picked.get(j, np.empty(0, int))
            scores = x[rest] @ q[j]  # resolve the few that may qualify
            found.append(rest[np.lexsort((ids[rest], -scores))[:k]])
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score from rows (vec_id, x) with integer components."""
    rows = vectors.withColumn("_query", is_query)
    n, many = rows.agg(F.count("*"), F.count(F.when(F.col("_query"), 1))).first()
    shards, blocks = -(-n // SHARD) or 1, -(-many // QUERIES) or 1
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks))
    asked = rows.filter("_query").groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    given = rows.drop("_query").withColumn("shard", shard)
    given = given.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kinds = {"shard": "bigint", "block": "bigint"}
    asked, given = (df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()}) for df in (asked, given))

    def cell(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if queries.empty or found.empty:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})
        width = max(max(map(len, queries["x"])), max(map(len, found["x"])), 1)
        found = found.sort_values("vec_id", kind="stable")
        ids, x = found["vec_id"].to_numpy(), _matrix(found["x"], width)
        both = np.unique(np.column_stack([ids, x]), axis=0)
        ids, x = both[:, 0], both[:, 1:]
        q, names = _matrix(queries["x"], width), queries["vec_id"].to_numpy()
        out = []
        for name, query, places in zip(names, q, search(q, names, x, ids, k)):
            out.append(np.column_stack([np.full(len(places), name), ids[places], x[places] @ query]))
        return pd.DataFrame(np.concatenate(out), columns=columns)

    local = asked.groupBy("shard", "block").cogroup(given.groupBy("shard", "block")).applyInPandas(
        cell, "query_id bigint, vec_id bigint, score bigint"
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
