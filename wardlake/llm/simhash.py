"""SimHash near-duplicates: fingerprints at a small Hamming distance, by an index in Gray order.

Fingerprint: the words (A-Z in lower case), their 3-word shingles with repeats, joined by single spaces; a bit is 1 if it
is set in more than half of the XXH64 hashes (seed 42). Equal fingerprints are one node from the start.

Two fingerprints of at most ``DISTANCE`` = 3 differing bits agree on two of five blocks of bits. So every fingerprint
stands in ten tables, one per pair of blocks, with that pair's bits in front. A table is sorted by Gray rank and dealt in
ranges of equal size: those that agree on the front bits stand side by side, and neighbours differ in few of the others.

A task indexes each run of equal front bits: leaves of up to ``LEAF`` neighbours, ``FAN`` nodes under the next one, every
node with the bits that all of its fingerprints share. What the parents share is not looked at again: two nodes add the
differences in the bits that became common to their own level to those of their parents, and a pair of nodes is dropped
with all below it once these exceed the distance, or once both nodes hang together by links found before. A task returns
no pairs but one edge per fingerprint that it links, to the smallest one it reaches.

Runs that a range cuts, and those above ``PIECE``, leave the task as pieces with the bits that a whole piece shares; these
are the upper nodes of the index. Pieces of one run meet in pairs, without those whose shared bits differ too often, each
pair in a task's row of its own. So no run is held whole, however many fingerprints it has, and no link is lost.

Edge cases: null texts and texts without words have fingerprint zero and link as any other does. Fewer than three words
are one shingle. Documents without an id are members; a component that has no id at all is named null. Repeated rows are
members each. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import words
from wardlake.llm.components import components
from wardlake.session import durable, stored

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Widths of the blocks, from the top; two of five agree where three bits differ.
WIDTHS = (13, 13, 13, 13, 12)
TABLES = tuple(combinations(range(len(WIDTHS)), 2))
#: Fingerprints of a leaf, nodes under a node, fingerprints of a piece; rows that a range is meant to hold.
LEAF, FAN, PIECE, RANGE = 16, 4, 4096, 1 << 18
#: Shingles whose bits are counted together; pairs of fingerprints looked at together.
SHINGLES, PAIRS = 1 << 15, 1 << 20

_SIGN = np.uint64(1 << 63)
_BITS = np.array([[(b >> i) & 1 for i in range(8)] for b in range(256)], np.int64)


def _hashes(tokens: list[bytes]) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, some at a time."""
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    size = min(SHINGLE, len(tokens))
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    many = len(tokens) - size + 1 if tokens else 0
    for a in range(0, many, SHINGLES):
        b = min(a + SHINGLES, many)
        spans = zip(starts[a:b], ends[a + size - 1 : b + size - 1])
        yield np.fromiter((digest(line[s : e - 1], SEED) for s, e in spans), np.uint64, b - a)


def fingerprint(text: str | None) -> int:
    """64 bits, unsigned."""
    counts, many = np.zeros(64, np.int64), 0
    for h in _hashes(words(text)):
        by_byte = h.view(np.uint8).reshape(-1, 8)  # the lowest byte first
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(by_byte[:, k], minlength=256) @ _BITS
        many += len(h)
    return sum(1 << i for i in np.flatnonzero(2 * counts > many).tolist())


def fingerprints(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = np.fromiter(map(fingerprint, frame["text"]), np.uint64, len(frame))
        yield pd.DataFrame({"doc_id": frame["doc_id"], "named": frame["named"], "fp": found.view(np.int64)})


def _moved(fps: np.ndarray, table: int, back: bool = False) -> np.ndarray:
    """The two blocks of a table in front of the others, or back in their places."""
    front = TABLES[table]
    order = [*front, *(b for b in range(len(WIDTHS)) if b not in front)]
    at = {b: 64 - sum(WIDTHS[: b + 1]) for b in range(len(WIDTHS))}
    to = {b: 64 - sum(WIDTHS[c] for c in order[: i + 1]) for i, b in enumerate(order)}
    out = np.zeros_like(fps)
    for b in order:
        here, there = (to, at) if back else (at, to)
        out |= ((fps >> np.uint64(here[b])) & np.uint64((1 << WIDTHS[b]) - 1)) << np.uint64(there[b])
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


def gray_code(ranks: np.ndarray) -> np.ndarray:
    return ranks ^ (ranks >> np.uint64(1))


def _placed(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every fingerprint in all tables; ranks with the top bit turned, so that they sort as signed numbers."""
    for frame in frames:
        fps = frame["fp"].to_numpy().view(np.uint64)
        for table in range(len(TABLES)):
            ranks = gray_rank(_moved(fps, table)) ^ _SIGN
            yield pd.DataFrame({"tab": np.full(len(fps), table, np.int32), "rank": ranks.view(np.int64)})


class Forest:
    """Labels of what hangs together, by the smallest place."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[p], label[q]
            apart = a != b
            if not apart.any():
                return
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                next_ = label[label]
                if (next_ == label).all():
                    break
                label[:] = next_


class GrayIndex:
    """Nodes over fingerprints in Gray order, leaves first: bits that a node shares (``fixed``) and their values (``ones``)."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps
        ones, zeros, size = fps, ~fps, LEAF
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            starts = np.arange(0, len(ones), size)
            ones, zeros, size = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts), FAN
            self.levels.append((ones, ones | zeros))
            if len(ones) == 1:
                break

    def _children(self, level: int, i: np.ndarray, j: np.ndarray, *carried: np.ndarray):
        """Pairs of the nodes below pairs of nodes, each pair once, with what the parents carry."""
        many = len(self.levels[level][0])
        p = np.repeat(i, FAN * FAN) * FAN + np.tile(np.repeat(np.arange(FAN), FAN), len(i))
        q = np.repeat(j, FAN * FAN) * FAN + np.tile(np.tile(np.arange(FAN), FAN), len(j))
        there = (p < many) & (q < many) & (p <= q)
        return p[there], q[there], *(np.repeat(c, FAN * FAN)[there] for c in carried)

    def link(self, forest: Forest) -> None:
        """Join all fingerprints at the distance or nearer; from the root down, near pairs of leaves first."""
        top = len(self.levels) - 1
        i = j = apart = np.zeros(1, np.int64)
        for level in range(top, -1, -1):
            ones, fixed = self.levels[level]
            if level < top:
                known = self.levels[level + 1][1]
                known = known[i] & known[j]
                i, j, known, apart = self._children(level, i, j, known, apart)
            else:
                known = np.zeros(1, np.uint64)
            fresh = (ones[i] ^ ones[j]) & fixed[i] & fixed[j] & ~known
            apart = apart + np.bitwise_count(fresh)
            near = apart <= DISTANCE
            i, j, apart = i[near], j[near], apart[near]
        first = np.argsort(j - i, kind="stable")
        i, j = i[first], j[first]
        for a in range(0, len(i), max(1, PAIRS // (LEAF * LEAF))):
            self._leaves(i[a : a + PAIRS // (LEAF * LEAF)], j[a : a + PAIRS // (LEAF * LEAF)], forest)

    def _leaves(self, i: np.ndarray, j: np.ndarray, forest: Forest) -> None:
        label = forest.label
        starts = np.arange(0, len(label), LEAF)
        low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        open_ = np.minimum(low[i], low[j]) != np.maximum(high[i], high[j])
        i, j = i[open_], j[open_]
        p = (i[:, None] * LEAF + np.repeat(np.arange(LEAF), LEAF)).ravel()
        q = (j[:, None] * LEAF + np.tile(np.arange(LEAF), LEAF)).ravel()
        there = (p < q) & (q < len(label))
        p, q = p[there], q[there]
        near = np.bitwise_count(self.fps[p] ^ self.fps[q]) <= DISTANCE
        forest.join(p[near], q[near])


def _edges(fps: np.ndarray, forest: Forest) -> pd.DataFrame:
    """a, b: one row per fingerprint that hangs on a smaller place."""
    hangs = np.flatnonzero(forest.label != np.arange(len(fps)))
    return pd.DataFrame({"a": fps[hangs].view(np.int64), "b": fps[forest.label[hangs]].view(np.int64)})


def _small_runs(fps: np.ndarray, runs: np.ndarray, forest: Forest) -> None:
    """Runs of one leaf or less, all at once: each fingerprint with the ones behind it in its run."""
    for step in range(1, LEAF):
        p = np.flatnonzero(runs[:-step] == runs[step:]) if step < len(runs) else []
        if not len(p):
            return
        near = np.bitwise_count(fps[p] ^ fps[p + step]) <= DISTANCE
        forest.join(p[near], p[near] + step)


_FOUND = "a bigint, b bigint, run bigint, piece binary, ones bigint, zeros bigint"


def _found(edges: pd.DataFrame, pieces: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
    """Edges, then pieces with the ones and the zeros that all of a piece share."""
    none = np.arange(len(edges) + len(pieces)) >= len(edges)
    zero = np.zeros(len(edges), np.int64)

    def column(of_edges: np.ndarray, of_pieces: list, missing: np.ndarray) -> pd.array:
        return pd.arrays.IntegerArray(np.concatenate([of_edges, np.array(of_pieces, np.int64)]), missing)

    shared = [[np.bitwise_and.reduce(x).view(np.int64) for x in (fps, ~fps)] for _, fps in pieces]
    return pd.DataFrame({
        "a": column(edges["a"].to_numpy(), [0] * len(pieces), none),
        "b": column(edges["b"].to_numpy(), [0] * len(pieces), none),
        "run": column(zero, [run for run, _ in pieces], ~none),
        "piece": [None] * len(edges) + [fps.tobytes() for _, fps in pieces],
        "ones": column(zero, [x for x, _ in shared], ~none),
        "zeros": column(zero, [x for _, x in shared], ~none),
    })


def _search(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a range, by table and rank, to the edges within runs and the pieces of runs that the range may cut."""
    held, held_runs, opens = np.empty(0, np.uint64), np.empty(0, np.int64), True

    def settle(fps: np.ndarray, runs: np.ndarray, first: bool, last: bool) -> pd.DataFrame:
        """All runs of the arrays; the first or the last one may go on elsewhere."""
        forest, pieces = Forest(len(fps)), []
        starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        ends = np.append(starts[1:], len(runs))
        small = np.repeat(ends - starts <= LEAF, ends - starts)
        _small_runs(fps, np.where(small, runs, -1 - np.arange(len(runs))), forest)
        cut = ends - starts > PIECE
        cut[0], cut[-1] = cut[0] or first, cut[-1] or last
        for a, b, is_cut in zip(starts, ends, cut):
            if not is_cut and b - a <= LEAF:
                continue
            for s in range(a, b, PIECE):
                e = min(b, s + PIECE)
                if b - a > LEAF:
                    part = Forest(e - s)
                    GrayIndex(fps[s:e]).link(part)
                    forest.join(np.arange(s, e), part.label + s)
                if is_cut:
                    pieces.append((int(runs[a]), fps[s:e]))
        return _found(_edges(fps, forest), pieces)

    for frame in frames:
        ranks = frame["rank"].to_numpy().view(np.uint64) ^ _SIGN
        tabs = frame["tab"].to_numpy()
        fps, runs = np.empty(len(ranks), np.uint64), np.empty(len(ranks), np.int64)
        for table in np.unique(tabs):
            here = tabs == table
            width = sum(WIDTHS[b] for b in TABLES[table])
            fps[here] = _moved(gray_code(ranks[here]), table, back=True)
            runs[here] = (ranks[here] >> np.uint64(64 - width)).astype(np.int64) | (int(table) << 32)
        fps, runs = np.concatenate([held, fps]), np.concatenate([held_runs, runs])
        if not len(runs):
            continue
        # The last run may go on in the next batch; if it is long already, its pieces leave now.
        done = int(np.searchsorted(runs, runs[-1]))
        if len(runs) - done > PIECE:
            done = len(runs)
        if done:
            yield settle(fps[:done], runs[:done], opens, done == len(runs))
            opens = done == len(runs)
        held, held_runs = fps[done:], runs[done:]
    if len(held):
        yield settle(held, held_runs, opens, True)


def _meet(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of pieces to edges."""
    for frame in frames:
        found = []
        for one, two in zip(frame["piece"], frame["other"]):
            fps = np.concatenate([np.frombuffer(x, np.uint64) for x in (one, two)])
            fps = fps[np.argsort(gray_rank(fps))]
            forest = Forest(len(fps))
            GrayIndex(fps).link(forest)
            found.append(_edges(fps, forest))
        yield pd.concat(found, ignore_index=True) if found else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def links(fps: DataFrame, count: int) -> DataFrame:
    """a, b: edges between distinct fingerprints (column ``fp``, ``count`` of them) that connect whatever is near."""
    ranges = max(1, -(-count * len(TABLES) // RANGE))
    placed = fps.select("fp").mapInPandas(_placed, "tab int, rank bigint").repartitionByRange(ranges, "tab", "rank")
    found = stored(placed.sortWithinPartitions("tab", "rank").mapInPandas(_search, _FOUND), "simhash-found")
    edges = found.filter("piece IS NULL").select("a", "b")
    pieces = durable(found.filter("piece IS NOT NULL").select("run", "piece", "ones", "zeros").withColumn("no", F.sha2("piece", 256)))
    one, two = pieces, pieces.toDF("run", "other", "ones2", "zeros2", "no2")
    differ = F.bit_count((F.col("ones").bitwiseAND(F.col("zeros2"))).bitwiseOR(F.col("zeros").bitwiseAND(F.col("ones2"))))
    pairs = one.join(two, "run").filter((F.col("no") < F.col("no2")) & (differ <= DISTANCE)).select("piece", "other")
    return edges.unionByName(pairs.mapInPandas(_meet, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id; one row per row of ``docs``."""
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNotNull().alias("named"), F.col(text).cast("string").alias("text")
    )
    marked = rows.mapInPandas(fingerprints, "doc_id bigint, named boolean, fp bigint")
    prints = stored(marked.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "fp"), "simhash-prints")
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = components(links(fps, fps.count()))
    joined = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    joined = stored(joined.select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    least = stored(joined.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-least")
    named = stored(joined.join(least, "label").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
