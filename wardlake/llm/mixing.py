"""Mixing sources to target weights by balanced sampling with the cube method.

Target: every source has a share of all words by its weight, but no more than ``MOST`` times its own size; what is above
is shared again by weight until none is above. The level (words per unit of weight) is found by a few aggregations over
the sources, none of which are collected.

Sample: a source whose target is m times its size takes each document floor(m) times, and once more with probability
m - floor(m). Which ones, the cube method decides: as long as three documents of a block are undecided, their
probabilities move along the null space of the two constraints (number of documents, number of words) until one of them
is 0 or 1, so both totals stay as they are. A block leaves at most two documents undecided. Sources of any size are cut
into blocks of ``BLOCK`` documents; what the blocks leave undecided meets in the blocks of the next round, until a source
has one block. The last block keeps ``LANDING`` documents out of the flight; with the two that the flight leaves they are
the landing problem, of whose outcomes the one nearest to the words, then to the documents, is taken. Random numbers come
from hashes of the ids, one for the order of the flight and one for its steps, so every document keeps its probability,
reruns agree and a lost task is drawn again the same way.

Edge cases: null texts and texts without words have size 0 and take 0 words. A null source is a source of its own, the
last one. A source without words has the target 0. Repeated rows and null ids are documents of their own; copies of one
row are told apart by a number. An empty table gives no rows. Other columns are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlake.llm.common import BROADCAST_ROWS
from wardlake.llm.common import mix as mix_bits
from wardlake.session import durable

#: The most times a source, and so a document, is taken.
MOST = 3
#: Weights by the place of the source in the order of names.
WEIGHTS = (1, 2, 3)
#: Documents of one block of the flight.
BLOCK = 2_000
#: Documents of a source that are left for the landing, besides the two that the flight leaves.
LANDING = 12

_STEPS = np.uint64(0x9E3779B97F4A7C15)

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, weight, target from (source, size) rows; one row per source.

    Sources are ranked in ranges, so that millions of them are sorted by many tasks.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").cast("bigint").alias("source_size"), F.count("*").alias("n_docs")
    )
    # UTF-8 sorts as code points do; nulls go last.
    order = [F.col("source").asc_nulls_last()]
    ranges = durable(totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = ranges.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1 + F.col("_offset")
    ranked = durable(
        ranges.join(F.broadcast(offsets), "_part")
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
        .drop("_part", "_offset")
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # level = free words / free weight; a source above its bound at one level stays so, as the level only rises.
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(float(level)) > MOST * F.col("source_size")
        free = ranked.agg(
            F.sum(F.when(above, MOST * F.col("source_size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if free["full"] == full or not free["weight"]:
            break
        full, level = free["full"], (total - free["fixed"]) / free["weight"]
    level = float(level or 0)
    aim = F.least(F.col("weight") * F.lit(level), (MOST * F.col("source_size")).cast("double"))
    return ranked.withColumn("target", aim)


def fly(sizes: np.ndarray, chances: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The flight: chances after it, all 0 or 1 but for at most two; sum and weighted sum as before.

    ``numbers``: uniform random numbers, one per document.
    """
    out = chances.astype(float).copy()
    held: list[int] = []
    for i in range(len(out)):
        if not 0.0 < out[i] < 1.0:
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        xa, xb, xc = float(sizes[a]), float(sizes[b]), float(sizes[c])
        way = (xb - xc, xc - xa, xa - xb)
        if not any(way):
            way = (1.0, -1.0, 0.0)
        up = down = np.inf
        for k, w in zip(held, way):
            if w:
                p = out[k]
                up = min(up, ((1.0 - p) if w > 0 else p) / abs(w))
                down = min(down, (p if w > 0 else (1.0 - p)) / abs(w))
        step = up if numbers[i] * (up + down) < down else -down
        for k, w in zip(held, way):
            p = out[k] + step * w
            out[k] = 0.0 if p < 1e-9 else 1.0 if p > 1.0 - 1e-9 else p
        held = [k for k in held if 0.0 < out[k] < 1.0]
    return out


def land(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Decide the rest: of all outcomes of the few undecided ones, the nearest in words, then in documents."""
    rest = np.flatnonzero((chances > 0.0) & (chances < 1.0))
    out = chances.copy()
    if not len(rest):
        return out
    grids = np.array(np.meshgrid(*[[0.0, 1.0]] * len(rest))).reshape(len(rest), -1).T
    words = np.abs((grids - chances[rest]) @ sizes[rest])
    documents = np.abs((grids - chances[rest]).sum(axis=1))
    out[rest] = grids[np.lexsort((documents, words))[0]]
    return out


def step_numbers(doc: np.ndarray) -> np.ndarray:
    """Random numbers of the steps, by the name of the document; they have nothing to do with the order of the flight."""
    return (mix_bits(doc.astype(np.int64).view(np.uint64) + _STEPS) >> np.uint64(11)).astype(float) / float(1 << 53)


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.drop(columns="_block").sort_values(["draw", "doc"], kind="stable")
    chances = fly(frame["size"].to_numpy(float), frame["chance"].to_numpy(float), step_numbers(frame["doc"].to_numpy()))
    return frame.assign(chance=chances)


def _last_block(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["draw", "doc"], kind="stable")
    held = frame[(frame["chance"] > 0) & (frame["chance"] < 1)].index[:LANDING]
    flown = pd.concat([frame.loc[held].drop(columns="_block"), _block(frame.drop(index=held))])
    return flown.assign(chance=land(flown["size"].to_numpy(float), flown["chance"].to_numpy(float)))


def decide(docs: DataFrame) -> DataFrame:
    """Rows (doc, source, size, chance, n_docs) with ``chance`` moved to 0 or 1. ``doc`` orders and draws."""
    schema = docs.schema
    done = []
    rest, many = docs, docs.agg(F.max("n_docs")).first()[0] or 0
    bound = BLOCK

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        # A source lands in the round in which it has one block, whatever the others need.
        return (_last_block if frame["n_docs"].iloc[0] <= bound else _block)(frame)

    while True:
        blocks = -(-many // BLOCK) or 1
        last = blocks == 1
        own = F.ceil(F.col("n_docs") / BLOCK)
        cut = F.pmod(F.xxhash64(F.lit(len(done)), "doc"), own)
        flown = rest.withColumn("_block", cut).groupBy("source", "_block").applyInPandas(block, schema)
        if last:
            done.append(flown)
            break
        flown = durable(flown)
        undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(flown.filter(~undecided))
        # At most two are left of each block; the bound is on the number of documents that meet next.
        rest, many = flown.filter(undecided).withColumn("n_docs", 2 * own), 2 * blocks
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, size: str, source: str = "source", seed: int = 17) -> DataFrame:
    """All rows and columns of ``docs`` with source_size, target and copies (how often the mix takes the document).

    Existing columns of these names are replaced. ``size``: name of the column with the words of each row.
    """
    kept = docs.drop("source_size", "target", "copies")
    named = kept.withColumn("__source", F.col(source)).withColumn("__size", F.col(size).cast("bigint"))
    goal = targets(named.select(F.col("__source").alias("source"), F.col("__size").alias("size")))
    goal = goal.select(F.col("source").alias("__name"), "source_size", F.col("n_docs").alias("__n_docs"), "target")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return _taken(named, goal.withColumn("__times", times), seed).drop("__source", "__size")


def _taken(named: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    columns = [c for c in named.columns]
    # Two hashes name a document, so that none takes the place of another.
    own = ["doc_id", "__source", "__size"]
    told = named.select("*", F.xxhash64(F.lit(seed), *own).alias("__key"), F.xxhash64(F.lit(~seed), *own).alias("__twin"))
    # Copies of one row get numbers of their own; ids are unique as a rule, so these groups have one row.
    told = told.withColumn("__doc", F.xxhash64("__key", F.row_number().over(W.partitionBy("__key", "__twin").orderBy("__size"))))
    joined = told.join(goal, F.col("__source").eqNullSafe(F.col("__name")))
    whole = F.floor("__times")
    small = joined.select(
        F.col("__doc").alias("doc"), F.col("__twin").alias("twin"), F.col("__source").alias("source"), F.col("__size").alias("size"),
        F.when(F.col("__size") > 0, F.col("__times") - whole).otherwise(0.0).alias("chance"),
        (F.pmod(F.xxhash64(F.lit(seed + 1), "__doc"), F.lit(1 << 30)) / float(1 << 30)).alias("draw"), F.col("__n_docs").alias("n_docs"),
    )
    decided = decide(small).select(
        F.col("doc").alias("__doc"), F.col("twin").alias("__twin"), F.col("chance").cast("int").alias("__more")
    )
    return joined.join(decided, ["__doc", "__twin"]).select(
        *[F.col(f"`{c}`") for c in columns], "source_size", "target", (whole + F.col("__more")).cast("int").alias("copies")
    )


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def take(docs: DataFrame, text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with its columns.

    Only ids, sources and sizes go through the sampling; the texts meet its result at the end.
    """
    key = F.struct(F.xxhash64("doc_id", source, text).alias("a"), F.xxhash64(F.lit(1), "doc_id", source, text).alias("b"))
    slim = docs.select("doc_id", F.col(source).alias("source"), words_in(text).alias("size"), key.alias("__row"))
    times = mix(slim, "size", "source", seed).groupBy("__row").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    times = durable(times)
    chosen = times.filter("__copies > 0").select("__row", "__copies")
    named = docs.withColumn("__row", key)
    if not times.filter("__rows > 1").isEmpty():  # repeated rows: one of them stands for what all of them take
        named = named.dropDuplicates(["__row"])
    few = chosen.count() <= BROADCAST_ROWS
    joined = named.join(F.broadcast(chosen) if few else chosen, "__row")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).select(docs.columns)
