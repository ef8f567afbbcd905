"""Divergence of sources within a language, from term counts, by hash-consed segment trees over term ids.

Every (lang, source) and every lang gives each kept term the smoothed share p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)).
The kept terms of a language are dealt into blocks of about ``BLOCK``; within a block they are numbered in order, and the
counts of every source are the leaves of a segment tree. Nodes are made once for all trees of the block: the node of a pair
of children is looked up by the pair, so equal subtrees of counts (of one source or of several, wherever they stand; most
of all those without any count) are one node.

Two trees are compared from their roots down, all partners of a source at the same time. Of each level the distinct pairs
of nodes go on, so a pair of equal nodes is priced once however often it occurs; prices are then added up level by level.
The comparison with the tree of the language leaves out nodes without a count and prices each pair of leaves once.

The blocks of a language, and tiles of about ``TILE`` of its sources against each other, are rows of their own, so a task
holds two tiles over one block whatever the number of sources or terms; Spark adds up the blocks. Counts leave the tasks
already added up per source and term. Shares and prices are whole Python numbers, which have no bound.

Edge cases: null text, lang and source count as empty texts. Repeated rows are documents each. A language without kept
terms has pairs of value 0 and no terms; a language with one source has no pairs. Empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlake.llm.common import BROADCAST_ROWS
from wardlake.session import stored

#: Smoothing and scale of the shares, documents that a kept term has at least, ranks of the term part.
ADDED, SCALE, MIN_DOCS, TOP = 5, 10**9, 30, 50
#: Terms per block and sources per tile, about; distinct counts that a task holds before it sends them.
BLOCK, TILE, HELD = 4096, 128, 1 << 18

# A-Z in lower case; every other ASCII character but a-z separates terms.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of characters beyond ASCII."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_TERMS).split()


def _counted(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, source, text to lang, source, term, n (occurrences), docs; a row without term for every group."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> pd.DataFrame:
        parts = [
            pd.DataFrame({
                "lang": lang, "source": source, "term": [None, *n], "n": [0, *n.values()], "docs": [0, *(docs[t] for t in n)],
            })
            for (lang, source), (n, docs) in found.items()
        ]
        found.clear()
        return pd.concat(parts, ignore_index=True)

    for frame in frames:
        for lang, source, text in zip(frame["lang"], frame["source"], frame["text"]):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before, tokens = len(n), terms(text)
            n.update(tokens)
            docs.update(set(tokens))
            held += len(n) - before + 1
            if held > HELD:
                yield out()
                held = 0
    if found:
        yield out()


def share(counts: np.ndarray, total: int) -> np.ndarray:
    """p of every count; ``total`` is N + 5 * V."""
    return 1 + SCALE * (counts.astype(object) + ADDED) // total


class Trees:
    """Segment trees over one block, one per row of ``counts``; ``width`` leaves are terms, the rest is padding."""

    def __init__(self, counts: np.ndarray, width: int) -> None:
        depth = max(0, width - 1).bit_length()
        trees, present = counts.shape
        self.values, leaves = np.unique(counts, return_inverse=True)
        if width > present and 0 not in self.values:
            self.values = np.append(self.values, 0)
        self.zero = [int(np.flatnonzero(self.values == 0)[0]) if 0 in self.values else -1]
        self.padding = len(self.values)
        full = np.full((trees, 1 << depth), self.padding, np.int64)
        full[:, :width] = self.zero[0]
        full[:, :present] = leaves.reshape(trees, present)
        self.nodes, self.children = [full], []
        for _ in range(depth):
            below = self.nodes[-1]
            pairs, ids = np.unique((below[:, 0::2] << 32) | below[:, 1::2], return_inverse=True)
            self.children.append((pairs >> 32, pairs & 0xFFFFFFFF))
            self.nodes.append(ids.reshape(trees, -1))
            left, right = self.children[-1]
            empty = np.flatnonzero((left == self.zero[-1]) & (right == self.zero[-1]))
            self.zero.append(int(empty[0]) if len(empty) else -1)

    def distances(self, one: int, others: np.ndarray, shares: list[np.ndarray]) -> list[int]:
        """Sums of the differences of the shares of one tree and of each of the others."""
        roots = self.nodes[-1][:, 0]
        a, b, of = np.full(len(others), roots[one]), roots[others], np.arange(len(others))
        backs = []
        for left, right in reversed(self.children):
            size = int(max(left.max(), right.max())) + 1
            keys = np.concatenate([(of * size + side[a]) * size + side[b] for side in (left, right)])
            keys, back = np.unique(keys, return_inverse=True)
            backs.append(back)
            a, b, of = keys // size % size, keys % size, keys // size // size
        prices = np.zeros(len(a), object)
        real = np.flatnonzero(a != self.padding)
        if len(real):
            mine = shares[one][a[real]]
            theirs = np.stack([shares[o] for o in others])[of[real], b[real]]
            prices[real] = np.abs(mine - theirs)
        for back in reversed(backs):
            left, right = np.split(prices[back], 2)
            prices = left + right
        return prices.tolist()

    def counted(self, tree: int) -> np.ndarray:
        """Leaves of a tree with a count above zero; nodes without one are not entered."""
        at = np.zeros(1, np.int64)
        for level in range(len(self.children), 0, -1):
            at = at[self.nodes[level][tree, at] != self.zero[level]]
            at = np.concatenate([2 * at, 2 * at + 1])
        leaves = self.nodes[0][tree, at]
        return np.sort(at[(leaves != self.zero[0]) & (leaves != self.padding)])


_PRICED = "lang string, source string, part string, item string, value bigint"


def _priced(frame: pd.DataFrame) -> pd.DataFrame:
    """A block and two tiles: heads (sources with their N + 5 * V, without term) and counts, to the prices of both parts."""
    lang, low, high = frame["lang"].iat[0], int(frame["low"].iat[0]), int(frame["high"].iat[0])
    is_head = frame["term"].isna().to_numpy()
    heads = frame[is_head].sort_values("source", ignore_index=True)
    rows = frame[~is_head]
    names, tiles = heads["source"].tolist(), heads["tile"].to_numpy()
    width, of_lang = int(heads["width"].iat[0]), int(heads["total"].iat[0])
    place = {s: i for i, s in enumerate(names)}
    found, column = np.unique(rows["term"].to_numpy(object), return_inverse=True)
    counts = np.zeros((len(names) + 1, len(found)), np.int64)
    counts[rows["source"].map(place).to_numpy(np.int64), column] = rows["n"].to_numpy(np.int64)
    counts[-1, column] = rows["total"].to_numpy(np.int64)  # the tree of the language, where a source has a count
    trees = Trees(counts, width)
    shares = [share(trees.values, int(total)) for total in [*heads["n"], of_lang]]
    out: list[tuple] = []
    for one in np.flatnonzero(tiles == low).tolist():
        others = np.flatnonzero((tiles == high) & ((low != high) | (np.arange(len(names)) > one)))
        if len(others):
            values = trees.distances(one, others, shares)
            out += [(lang, names[one], "pair", names[o], v) for o, v in zip(others, values)]
        if low == high:
            leaves = trees.counted(one)
            mine, theirs = trees.nodes[0][one, leaves], trees.nodes[0][-1, leaves]
            pairs, back = np.unique(np.column_stack([mine, theirs]), axis=0, return_inverse=True)
            value = (shares[one][pairs[:, 0]] - shares[-1][pairs[:, 1]])[back.ravel()] if len(pairs) else np.empty(0, object)
            above = np.flatnonzero(value > 0)
            best = above[np.argsort(-value[above].astype(np.int64), kind="stable")[:TOP]]
            out += [(lang, names[one], "term", found[leaves[i]].decode("utf-8", "replace"), value[i]) for i in best]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"]).astype({"value": "int64"})


def _ranked(values: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return values.withColumn("rank", F.row_number().over(order))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def audit(docs: DataFrame, text: str = "text") -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    rows = docs.select(_text("lang"), _text("source"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInPandas(_counted, "lang string, source string, term binary, n bigint, docs bigint")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "term-counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = stored(kept.filter(F.col("docs") >= MIN_DOCS).select("lang", "term", "total"), "kept-terms")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    groups = counts.filter("term IS NULL").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(sizes, "lang", "left").na.fill(0, ["v", "n_lang"])
    langs = stored(langs.select(
        "lang", "v", (F.col("n_lang") + ADDED * F.col("v")).alias("of_lang"),
        F.greatest(F.ceil(F.col("v") / BLOCK), F.lit(1)).alias("blocks"), F.ceil(F.col("sources") / TILE).alias("tiles"),
    ), "langs")
    few = langs.count() <= BROADCAST_ROWS

    def placed(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(langs) if few else langs, "lang")

    block = F.pmod(F.xxhash64("term"), "blocks")
    tile = F.pmod(F.xxhash64("source"), "tiles")
    widths = placed(kept).groupBy("lang", block.alias("block")).agg(F.count("*").alias("width"))
    used = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "used-counts")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    heads = placed(groups.join(totals, ["lang", "source"], "left")).select(
        "lang", "source", tile.alias("tile"), "tiles", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        F.lit(None).cast("binary").alias("term"), (F.coalesce("n", F.lit(0)) + ADDED * F.col("v")).alias("n"),
        F.col("of_lang").alias("total"),
    )
    heads = heads.join(widths, ["lang", "block"], "left").na.fill(0, ["width"])
    leaves = placed(used).select(
        "lang", "source", tile.alias("tile"), "tiles", block.alias("block"), "term", "n", "total", F.lit(0).cast("bigint").alias("width")
    )
    cells = heads.select(leaves.columns).unionByName(leaves)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    cells = cells.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", "tiles")
    priced = stored(cells.groupBy("lang", "block", "low", "high").applyInPandas(_priced, _PRICED), "prices")

    pairs = priced.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    other_way = pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    best = _ranked(priced.filter("part = 'term'")).filter(F.col("rank") <= TOP)
    return _ranked(pairs.unionByName(other_way)).unionByName(best)
