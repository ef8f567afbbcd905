"""Jaccard join of word shingle sets by PartEnum signatures.

Two texts link when 100 * |A and B| >= percent * |A or B|. Equal sets are one class from the start. Classes are compared
within bands of set sizes [l, l * 100 / percent], each with the one above it, so the sets of a pair differ in at most
k = floor(2 * (100 - percent) / (100 + percent) * r) shingles, r being the largest size of the upper band.

Signatures of a band: the domain of shingles (their hashes, cut into equal ranges) is partitioned into n1 parts, n1 a
tenth more than k // 2 + 1, so at least ``good`` = n1 - k // 2 parts differ in at most one shingle. Each part is cut into
three; of three thirds two are then equal, so each pair of thirds is a signature. Signatures of one shingle or none say
little and are left out, as long as fewer than ``good`` parts of the set have such a one: then a part remains whose
signatures all count. (Else they are all sent.) Two similar sets always share a signature.

Every task sends its signatures, sorted and packed, to the owners of ranges of values. An owner returns the classes that
share a signature as stars around the smallest class, and the members of groups of three and more. Stars are verified,
by an exact bound (the difference of the numbers of shingles per range of hashes) and then on the shingle sets, and give
components. Groups whose members are not all connected then are compared in cells of two blocks of about ``MEMBERS``
classes; cells of one component are left out, and a task gets about ``ROWS`` rows of the others. It holds the sketches
only and returns the pairs of different components that the bound cannot exclude; those are verified too. So no group is
expanded into its pairs, and no link is lost.

Classes and shingles are 64-bit hashes.

Edge cases: null texts and texts without words have the empty set and link with nothing. Texts with fewer than n words
have one shingle, all words. Repeated rows and copies are members of one class. Documents without an id are members, but
a component is named by the smallest id; it is null if none has one. Empty tables give no rows. Other columns are ignored
by ``link`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import (
    BROADCAST_ROWS, WordHash, drop_matching, in_slices, mix, pack_counts, pack_sorted, unpack_counts, unpack_sorted, words,
)
from wardlake.llm.components import components
from wardlake.session import durable, stored

#: Signatures that a task holds before it sends them, and that an owner is meant to hold.
SENT, OWNED = 1 << 21, 1 << 22
#: Classes per block in the comparison of groups that the stars leave open.
MEMBERS = 1024
#: Rows of cells that a task looks at together; pairs looked at together, first coarsely and then in all ranges.
ROWS, PAIRS, FINE = 100_000, 200_000, 1 << 14
#: Shingles of the sets that a task of the exact test is meant to hold, and of those of a part of a large component.
HELD = 1 << 18
#: Words whose hashes a task remembers.
KNOWN = 200_000
#: Ranges of the exact bound, and how many of them a first look takes together.
BINS, COARSE = 256, 16

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SENT = pa.schema([("owner", pa.int32()), *[(c, pa.binary()) for c in ("sigs", "places", "classes", "sizes", "digests")]])
_SHAPES = pa.schema([("cls", pa.int64()), ("shape", pa.binary())])
_OUT = "kind int, k1 bigint, k2 bigint, k3 bigint, n1 bigint, n2 bigint"


def shingles(text: str | None, n: int, hashed: WordHash) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    h = hashed(tokens)
    size = min(n, len(h))
    g = mix(h[: len(h) - size + 1] + np.uint64(size))
    for i in range(1, size):
        g = mix(g * _STEP + h[i : len(h) - size + 1 + i])
    return np.unique(g)


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


class Schemes:
    """Bands of set sizes and their signatures for one similarity."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.tops: list[int] = []

    def band(self, size: int) -> int:
        while not self.tops or self.tops[-1] < size:
            low = self.tops[-1] + 1 if self.tops else 1
            self.tops.append(low * 100 // self.percent)
        return bisect_left(self.tops, size)

    def distance(self, band: int) -> int:
        self.band(self.tops[band - 1] + 1 if band else 1)
        return 2 * (100 - self.percent) * self.tops[band] // (100 + self.percent)

    def signatures(self, found: np.ndarray) -> np.ndarray:
        """Of both bands in which the set can have a partner that is not its equal."""
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found + _STEP), dtype=np.uint64)])
        own = self.band(len(found))
        out = [self._of(own + i, found, before) for i in (0, 1)]
        return np.concatenate(out)

    def _of(self, band: int, found: np.ndarray, before: np.ndarray) -> np.ndarray:
        k = self.distance(band)
        if not k:
            return np.empty(0, np.uint64)
        n1 = k // 2 + 1
        n1 += n1 // 10
        good = n1 - k // 2
        cells = 3 * n1
        width = np.uint64((1 << 64) // cells)
        cuts = np.searchsorted(found, np.arange(1, cells, dtype=np.uint64) * width)
        cuts = np.concatenate([[0], cuts, [len(found)]])
        sums = np.diff(before[cuts]).reshape(n1, 3)
        counts = np.diff(cuts).reshape(n1, 3)
        left = counts.sum(axis=1, keepdims=True) - counts
        place = np.uint64(band << 40) + np.arange(cells, dtype=np.uint64).reshape(n1, 3)
        values = mix(sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums + mix(place))
        telling = left > 1
        return values[telling] if (~telling).any(axis=1).sum() < good else values.ravel()


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(doc_id, text)


def _integers(values, missing=None) -> pd.array:
    values = np.asarray(values, np.int64)
    return pd.arrays.IntegerArray(values, np.zeros(len(values), bool) if missing is None else np.asarray(missing, bool))


def _rows(kind: int, k1, k2, k3, n1, n2, missing2=None, missing3=None) -> pd.DataFrame:
    return pd.DataFrame({
        "kind": np.full(len(k1), kind, np.int32), "k1": _integers(k1), "k2": _integers(k2, missing2),
        "k3": _integers(k3, missing3), "n1": _integers(n1), "n2": _integers(n2),
    })


def _sender(n: int, percent: int, bits: int):
    """Documents to packed rows (owner, signatures, places of classes, classes, sizes, digests)."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed, schemes = WordHash(KNOWN), Schemes(percent)
        seen: set[int] = set()
        values, places, classes, sizes, digests = [], [], [], [], []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal held
            out = []
            if values:
                v, p = np.concatenate(values), np.concatenate(places)
                order = np.argsort(v)
                v, p = v[order], p[order]
                owners = (v >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(v), np.int64)
                cuts = np.searchsorted(owners, np.arange((1 << bits) + 1))
                names, many = np.array(classes, np.int64), np.array(sizes, np.int64)
                for owner, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        used, short = np.unique(p[a:b], return_inverse=True)
                        out.append((owner, pack_sorted(v[a:b]), pack_counts(short), names[used].tobytes(), many[used].tobytes(), None))
            if digests:
                table = np.array(digests, np.int64)
                out.append((int(table[0, 0]) % (1 << bits), b"", b"", b"", b"", table.tobytes()))
            for x in (values, places, classes, sizes, digests):
                x.clear()
            held = 0
            return pd.DataFrame(out, columns=["owner", "sigs", "places", "classes", "sizes", "digests"])

        for frame in frames:
            for key, named, doc_id, text in zip(frame["key"], frame["named"], frame["doc_id"], frame["text"]):
                found = shingles(text, n, hashed)
                name = class_of(found) if len(found) else 0
                digests.append((key, named, doc_id, len(found), name))
                held += 8
                if len(found) and name not in seen:
                    seen.add(name)
                    sigs = schemes.signatures(found)
                    if len(sigs):
                        values.append(sigs)
                        places.append(np.full(len(sigs), len(classes), np.uint32))
                        classes.append(name)
                        sizes.append(len(found))
                        held += len(sigs)
                if held > SENT:
                    yield flush()
        if held:
            yield flush()

    return send


def _owner(percent: int):
    """Packed rows of one owner to digests (kind 0), stars (kind 1) and groups of three and more (kind 2)."""

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        tables = [np.frombuffer(x, np.int64).reshape(-1, 5) for x in frame["digests"] if x is not None]
        if tables:
            key, named, doc_id, size, name = np.concatenate(tables).T
            out.append(_rows(0, key, doc_id, name, size, size, named == 0, size == 0))
        parts = frame[frame["digests"].isna()]
        if len(parts):
            sigs = np.concatenate([unpack_sorted(x) for x in parts["sigs"]])
            places = [unpack_counts(x) for x in parts["places"]]
            names = np.concatenate([np.frombuffer(c, np.int64)[p] for c, p in zip(parts["classes"], places)])
            sizes = np.concatenate([np.frombuffer(c, np.int64)[p] for c, p in zip(parts["sizes"], places)])
            out += _groups(sigs, names, sizes, percent)
        return pd.concat(out, ignore_index=True) if out else _rows(0, [], [], [], [], [])

    return own


def _groups(sigs: np.ndarray, names: np.ndarray, sizes: np.ndarray, percent: int) -> list[pd.DataFrame]:
    order = np.lexsort((names, sigs))
    sigs, names, sizes = sigs[order], names[order], sizes[order]
    new = np.ones(len(sigs), bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (names[1:] != names[:-1])
    sigs, names, sizes = sigs[new], names[new], sizes[new]
    starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    many = np.diff(np.append(starts, len(sigs)))
    several = many > 1
    if not several.any():
        return []
    hub = np.repeat(starts, many)
    member = np.repeat(several, many) & (hub != np.arange(len(sigs)))
    a, b = hub[member], np.flatnonzero(member)
    out = []
    close = np.minimum(sizes[a], sizes[b]) * 100 >= percent * np.maximum(sizes[a], sizes[b])
    a, b = a[close], b[close]
    if len(a):
        pairs = np.unique(np.column_stack([names[a], names[b], sizes[a], sizes[b]]), axis=0)
        out.append(_rows(1, pairs[:, 0], pairs[:, 1], pairs[:, 0], pairs[:, 2], pairs[:, 3]))
    # Groups of the same members share one name; one of them is enough.
    group = np.add.reduceat(mix(names.view(np.uint64)), starts)
    _, first = np.unique(group, return_index=True)
    chosen = np.zeros(len(starts), bool)
    chosen[first] = True
    rows = np.repeat(chosen & (many > 2), many)
    if rows.any():
        out.append(_rows(
            2, np.repeat(group, many)[rows].view(np.int64), names[rows], names[hub[rows]], sizes[rows], sizes[rows]
        ))
    return out


def shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many numbers two packed sets have in common."""
    return pd.Series([
        len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        for x, y in zip(a, b)
    ], dtype="int64")


def apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sum of the differences of two sketches: the sets differ in at least so many shingles."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BINS).astype(np.int16) for s in (a, b))
    return pd.Series(np.abs(x - y).sum(axis=1, dtype=np.int64), dtype="int64")


def sketch(found: np.ndarray) -> np.ndarray:
    """Numbers of shingles in ``BINS`` equal ranges of hashes; 255 stands for more, which only lowers differences."""
    cuts = np.searchsorted(found, np.arange(1, BINS, dtype=np.uint64) << np.uint64(56))
    return np.minimum(np.diff(np.concatenate([[0], cuts, [len(found)]])), 255).astype(np.uint8)


class Texts:
    """The texts behind classes: sketches of all that share a signature, whole sets of those that are asked for."""

    def __init__(self, rows: DataFrame, sources: DataFrame, n: int) -> None:
        self.rows, self.sources, self.n = rows, sources, n
        self.sketches = stored(self._made(sources, lambda found: sketch(found).tobytes()), "shingle-sketches")

    def _made(self, sources: DataFrame, shape: Callable[[np.ndarray], bytes]) -> DataFrame:
        """cls, shape: from one document of each class."""
        n = self.n

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashed = WordHash(KNOWN)
            for frame in frames:
                shapes = [shape(shingles(text, n, hashed)) for text in frame["text"]]
                yield pd.DataFrame({"cls": frame["cls"], "shape": shapes})

        few = sources.count() <= BROADCAST_ROWS
        texts = self.rows.join(F.broadcast(sources) if few else sources, "key").select("cls", "text")
        return texts.mapInArrow(in_slices(make, _SHAPES), "cls bigint, shape binary").dropDuplicates(["cls"])

    def sets(self, classes: DataFrame) -> DataFrame:
        wanted = durable(self.sources.join(classes.distinct(), "cls", "left_semi"))
        return stored(self._made(wanted, lambda found: found.tobytes()), "shingle-sets")


def _with_shapes(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(shapes.select(F.col("cls").alias(side), F.col("shape").alias(f"f{side}")), side)
    return pairs


def _verified(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """The rows (a, b, na, nb) that link, as (a, b). Sketches first; whole sets only for what they leave open."""
    least = F.pandas_udf(apart, "bigint")("fa", "fb")
    near = _with_shapes(pairs, texts.sketches).filter(least * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb")))
    near = durable(near.select("a", "b", "na", "nb"))
    if near.isEmpty():
        return near.select("a", "b")
    sets = texts.sets(near.select(F.col("a").alias("cls")).union(near.select("b")))
    dealt = _dealt(near)
    needed = dealt.select(F.col("task").alias("place"), F.col("a").alias("cls")).union(dealt.select("task", "b")).distinct()
    held = needed.join(sets, "cls").groupBy("place")
    return dealt.groupBy("task").cogroup(held).applyInPandas(_exact(percent), "a bigint, b bigint")


def _dealt(near: DataFrame) -> DataFrame:
    """a, b, na, nb, task: pairs of one component of the near ones meet in one task, which gets every set once.

    Sets are much longer than pairs, and a class is in many of these; joined to each pair they would be shuffled as often. A
    component whose sets are too many for a task is cut by the second class of its pairs.
    """
    named = components(near.select("a", "b")).withColumnRenamed("node", "a")
    pairs = near.join(named, "a", "left").withColumn("label", F.coalesce("label", "a"))
    ends = pairs.select("label", F.col("a").alias("cls"), F.col("na").alias("n")).union(pairs.select("label", "b", "nb")).distinct()
    weights = durable(ends.groupBy("label").agg(F.sum("n").alias("weight")))
    tasks = -(-(weights.agg(F.sum("weight")).first()[0] or 1) // HELD)
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("weight") / HELD))
    task = F.pmod(F.xxhash64("label", part), F.lit(tasks))
    return durable(pairs.join(weights, "label").select("a", "b", "na", "nb", task.alias("task")))


def _exact(percent: int):
    """Pairs of a task, and the sets of their classes, to the pairs that link."""

    def exact(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        shapes = sets.set_index("cls")["shape"]
        inter = shared(shapes.reindex(pairs["a"]), shapes.reindex(pairs["b"])).to_numpy()
        both = (pairs["na"] + pairs["nb"]).to_numpy()
        return pairs.loc[inter * 100 >= (both - inter) * percent, ["a", "b"]]

    return exact


def _compare(percent: int):
    """Pairs of cells that their sketches leave open: of different components, and of two blocks or of one.

    A task gets many cells at once, as most are small; ``PAIRS`` pairs are looked at together.
    """

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["group", "i", "j", "n"], ignore_index=True)
        counts = np.frombuffer(b"".join(frame["shape"]), np.uint8).reshape(-1, BINS)
        coarse = counts.reshape(len(frame), -1, COARSE).sum(axis=2, dtype=np.int16)
        label, block, names, size = (frame[c].to_numpy() for c in ("label", "block", "cls", "n"))
        cell = frame[["group", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(frame))
        found: list[np.ndarray] = []

        def look(p: np.ndarray, q: np.ndarray) -> None:
            # A cell of two blocks compares across them only; sizes ascend within a cell.
            open_ = (label[p] != label[q]) & (size[q] * percent <= size[p] * 100)
            open_ &= (block[p] != block[q]) | (cell[p, 1] == cell[p, 2])
            p, q = p[open_], q[open_]
            for ranges, many in ((coarse, PAIRS), (counts, FINE)):
                near = np.zeros(len(p), bool)
                for at in range(0, len(p), many):
                    a, b = p[at : at + many], q[at : at + many]
                    least = np.abs(ranges[a].astype(np.int16) - ranges[b]).sum(axis=1, dtype=np.int64)
                    near[at : at + many] = least * (100 + percent) <= (100 - percent) * (size[a] + size[b])
                p, q = p[near], q[near]
            swap = names[p] > names[q]
            a, b = np.where(swap, q, p), np.where(swap, p, q)
            found.append(np.unique(np.column_stack([names[a], names[b], size[a], size[b]]), axis=0))

        triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ps, qs, held = [], [], 0
        for a, b in zip(starts, ends):
            m = int(b - a)
            if m <= 64:
                if m not in triangles:
                    triangles[m] = np.triu_indices(m, 1)
                parts = [triangles[m]]
            else:
                parts = [(np.full(m - 1 - i, i), np.arange(i + 1, m)) for i in range(m - 1)]
            for p, q in parts:
                ps.append(p + a)
                qs.append(q + a)
                held += len(p)
                if held > PAIRS:
                    look(np.concatenate(ps), np.concatenate(qs))
                    ps, qs, held = [], [], 0
        if held:
            look(np.concatenate(ps), np.concatenate(qs))
        rows = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 4), np.int64)
        return pd.DataFrame(rows, columns=["a", "b", "na", "nb"])

    return compare


def _open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """group, cls, n, hub, label, blocks: the members of groups that are not connected yet, and the blocks of their group."""
    named = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("label", F.coalesce("label", "cls"))
    mixed = named.groupBy("group").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / MEMBERS).alias("blocks")
    )
    return named.join(mixed.filter("low <> high").select("group", "blocks"), "group")


def _cells(still: DataFrame) -> tuple[DataFrame, int]:
    """group, i, j, block, cls, n, label: the members of every cell with two labels or more; and how many rows these are."""
    dealt = still.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks"))
    columns = ["group", "i", "j", "block", "cls", "n", "label"]
    zero = F.lit(0).cast("bigint")
    alone = dealt.filter("blocks = 1").withColumns({"i": zero, "j": zero}).select(columns)
    ends = durable(dealt.filter("blocks > 1").groupBy("group", "block").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many")
    ))
    if ends.isEmpty():
        return alone, alone.count()
    one, two = (ends.select("group", *[F.col(c).alias(c + x) for c in ("block", "low", "high", "many")]) for x in "ij")
    open_ = one.join(two, "group").filter("blocki <= blockj AND least(lowi, lowj) <> greatest(highi, highj)")
    own = F.when(F.col("blocki") == F.col("blockj"), F.array("blocki")).otherwise(F.array("blocki", "blockj"))
    open_ = durable(open_.select("group", F.col("blocki").alias("i"), F.col("blockj").alias("j"), F.explode(own).alias("block")))
    rows = open_.join(ends, ["group", "block"]).agg(F.sum("many")).first()[0] or 0
    several = dealt.filter("blocks > 1").join(open_, ["group", "block"]).select(columns)
    return alone.unionByName(several), alone.count() + rows


def _link_classes(pairs: DataFrame, members: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """node, label of all classes that link with another."""
    links = durable(_verified(pairs, texts, percent))
    labels = components(links)
    # The star has tested the hub with every member, so only the others may be open.
    still = durable(_open_groups(members.filter("cls <> hub"), labels))
    if still.isEmpty():
        return labels
    members_of, rows = _cells(still)
    cells = members_of.join(texts.sketches, "cls")
    dealt_to = F.pmod(F.xxhash64("group", "i", "j"), F.lit(-(-rows // ROWS)))
    near = cells.withColumn("task", dealt_to).groupBy("task").applyInPandas(
        _compare(percent), "a bigint, b bigint, na bigint, nb bigint"
    )
    more = _verified(durable(near.distinct()), texts, percent)
    return components(links.unionByName(more))


def _labelled(docs: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """row_key, doc_id, n_shingles, cls, label (null without words); one row per row of ``docs``."""
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(
        row_key("doc_id", text).alias("key"), doc_id.isNotNull().cast("int").alias("named"),
        F.coalesce(doc_id, F.lit(0)).alias("doc_id"), F.col(text).alias("text"),
    )
    chars = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    # A word takes six characters or so and has less than one signature.
    bits = max(0, (int(chars) // 6 // OWNED).bit_length())
    sent = rows.mapInArrow(
        in_slices(_sender(n, percent, bits), _SENT),
        "owner int, sigs binary, places binary, classes binary, sizes binary, digests binary",
    )
    out = durable(sent.groupBy("owner").applyInPandas(_owner(percent), _OUT))
    digests = out.filter("kind = 0").select(
        F.col("k1").alias("row_key"), F.col("k2").alias("doc_id"), F.col("n1").alias("n_shingles"), F.col("k3").alias("cls")
    )
    pairs = durable(out.filter("kind = 1").select(
        F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("n1").alias("na"), F.col("n2").alias("nb")
    ).distinct())
    members = out.filter("kind = 2").select(
        F.col("k1").alias("group"), F.col("k2").alias("cls"), F.col("k3").alias("hub"), F.col("n1").alias("n")
    ).distinct()
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(members.select("cls")).distinct()
    sources = digests.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min("row_key").alias("key"))
    labels = _link_classes(pairs, members, Texts(rows, durable(sources), n), percent)

    joined = digests.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    return joined.withColumn("label", F.coalesce("label", "cls"))


def link(docs: DataFrame, n: int, percent: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, row_key; one row per row of ``docs``."""
    joined = _labelled(docs, n, percent, text)
    least = joined.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = joined.join(least, "label", "left")
    return linked.select(
        "doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "row_key",
    )


def one_of_each(docs: DataFrame, n: int, percent: int, text: str = "text") -> DataFrame:
    """One row of each group that links, over any number of links: of the smallest id, nulls last, then by the row key."""
    linked = durable(_labelled(docs, n, percent, text).filter("label IS NOT NULL").select("label", "doc_id", "row_key"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = linked.groupBy("label").agg(F.min(order)["row_key"].alias("kept"))
    gone = durable(linked.join(kept, "label").filter("row_key <> kept").select(F.col("row_key").alias("__row")).distinct())
    named = docs.withColumn("__row", row_key("doc_id", text))
    if not linked.groupBy("row_key").count().filter("count > 1").isEmpty():  # repeated rows; those without words all stay
        worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        named = named.filter(worded).dropDuplicates(["__row"]).unionByName(named.filter(~worded))
    return drop_matching(named, gone, "__row", gone.count()).select(docs.columns)
