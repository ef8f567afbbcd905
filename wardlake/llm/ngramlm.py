"""Scores of a bigram language model by deleted interpolation.

    P1(w)     = a * c(w) / N + (1 - a) / (V + 1)
    P2(w | u) = b(f) * c(u w) / c(u) + (1 - b(f)) * P1(w)

c counts the training tokens; f is the bucket of the frequency of the context u (powers of two); the context of a first
token is the start of the text. The weights are learned by expectation-maximisation on held-out counts: each training
document in turn is deleted from the counts, and its tokens are sorted into a histogram of likelihood ratios per bucket
(``STEPS`` steps per factor of two, so of bounded size for any corpus), which is all that the iterations need. A bucket
that only shows up with nothing deleted has the weight learned from all buckets together.

Counts of a corpus do not fit into a task, so they are exchanged: documents are packed into batches and stored; each
batch sends its distinct words and bigrams (64-bit hashes, sorted and packed, with their training counts) to the owners
of ranges of hashes; an owner adds up what the batches sent and answers each batch with the totals in the order of its
request. A batch then scores its documents by itself. A hot word is one number per batch.

Edge cases: null text counts as empty: one token, the end. Without training documents all counts are 0. A single
training document leaves no context to learn from, so its bigrams weigh nothing. Repeated rows
count and are scored as often as they occur. Null ids are allowed and belong to the training documents. Columns other
than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import WordHash, mix, pack_counts, pack_sorted, unpack_counts, unpack_sorted, words
from wardlake.session import durable

#: Characters of a batch; distinct n-grams that an owner is meant to hold.
BATCH, OWNED = 1 << 23, 1 << 22
#: Steps per factor of two of the shares of words and of pairs, and their range in powers of two.
WORD_STEPS, PAIR_STEPS, RANGE = 2, 4, 64
ROUNDS = 100

_STEP = np.uint64(0x9E3779B97F4A7C15)
_START, _END = np.uint64(0x5151A5A5C3C39797), np.uint64(0xD00DF00DBEEFCAFE)
_PACKED = "batch bigint, n_tokens bigint, train_tokens bigint, train_docs bigint, docs binary"


@dataclass
class Weights:
    """``word``: the weight a; ``pair``: b by bucket of the context frequency (bucket 0: frequency 1)."""

    tokens: int
    types: int
    docs: int
    word: float = 0.0
    pair: np.ndarray = field(default_factory=lambda: np.zeros(64))


def _pack(docs: list[tuple[int, int, int, bytes]]) -> bytes:
    head = np.array([(named, doc_id, train, len(body)) for named, doc_id, train, body in docs], np.int64)
    raw = len(docs).to_bytes(8, "little") + head.tobytes() + b"".join(d[3] for d in docs)
    return zstandard.ZstdCompressor(level=9).compress(raw)


def _unpack(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, np.int64, n * 4, 8).reshape(n, 4)
    ends = np.cumsum(head[:, 3]) + 8 + 32 * n
    return head, [raw[b - a : b] for a, b in zip(head[:, 3], ends)]


def pack_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (named, doc_id, train, text) to batches; each has a number made of the task and its place in it."""
    held, size, seq = [], 0, 0

    def batch() -> pd.DataFrame:
        counts = [len(words(text)) + 1 for *_, text in held]
        train = [c for c, row in zip(counts, held) if row[2]]
        docs = [(named, doc_id, train, (text or "").encode("utf-8", "replace")) for named, doc_id, train, text in held]
        number = (TaskContext.get().partitionId() << 24) + seq
        return pd.DataFrame({
            "batch": [number], "n_tokens": [sum(counts)], "train_tokens": [sum(train)],
            "train_docs": [len(train)], "docs": [_pack(docs)],
        })

    for frame in frames:
        for row in zip(frame["named"], frame["doc_id"], frame["train"], frame["text"]):
            held.append(row)
            size += len(row[3] or "")
            if size > BATCH:
                yield batch()
                held, size, seq = [], 0, seq + 1
    if held:
        yield batch()


@lru_cache(maxsize=1)
def word_hash() -> WordHash:
    """One per worker process, so that the batches of a task share what is known."""
    return WordHash(300_000)


@dataclass
class Tokens:
    """The tokens of a batch: document of each, and places of its word and its bigram among the distinct keys."""

    head: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray

    @property
    def first(self) -> np.ndarray:
        out = np.zeros(len(self.doc), bool)
        out[self.starts] = True
        return out


def tokens_of(packed: bytes, hashed: WordHash) -> Tokens:
    head, texts = _unpack(packed)
    parts, counts = [], []
    for text in texts:
        h = hashed(text.lower().split())
        parts += [h, np.array([_END])]
        counts.append(len(h) + 1)
    h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    counts = np.array(counts, np.int64)
    starts = np.cumsum(counts) - counts
    before = np.concatenate([[_START], h[:-1]]).astype(np.uint64) if len(h) else h
    before[starts] = _START
    one = np.uint64(1)
    word, pair = mix(h) & ~one, mix(mix(before) * _STEP + h) | one
    keys, places = np.unique(np.concatenate([word, pair]), return_inverse=True)
    return Tokens(head, starts, np.repeat(np.arange(len(counts)), counts), keys, places[: len(h)], places[len(h) :])


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _asker(bits: int):
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = word_hash()
        for frame in frames:
            for batch, docs in zip(frame["batch"], frame["docs"]):
                t = tokens_of(docs, hashed)
                train = t.head[t.doc, 2] == 1
                counts = np.bincount(t.word[train], minlength=len(t.keys)) + np.bincount(t.pair[train], minlength=len(t.keys))
                cuts = _cuts(t.keys, bits)
                rows = [
                    (owner, batch, pack_sorted(t.keys[a:b]), pack_counts(counts[a:b]))
                    for owner, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a
                ]
                yield pd.DataFrame(rows, columns=["owner", "batch", "keys", "counts"])

    return ask


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals per request of one owner; ``types``: the words it saw in training, named once."""
    asked = [unpack_sorted(x) for x in frame["keys"]]
    counts = np.concatenate([unpack_counts(x) for x in frame["counts"]])
    keys, places = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(places, weights=counts, minlength=len(keys)).astype(np.int64)
    types = int(((totals > 0) & (keys & np.uint64(1) == 0)).sum())
    cuts = np.cumsum([0, *map(len, asked)])
    # Counts are below 2**32 for any batch, totals need not be.
    packed = [
        zstandard.ZstdCompressor(level=1).compress(
            np.ascontiguousarray(totals[places[a:b]].view(np.uint8).reshape(-1, 8).T).tobytes()
        )
        for a, b in zip(cuts, cuts[1:])
    ]
    return pd.DataFrame({
        "batch": frame["batch"], "owner": frame["owner"], "totals": packed, "types": [types] + [0] * (len(asked) - 1),
    })


def _totals(answers: pd.DataFrame) -> np.ndarray:
    out = []
    for packed in answers.sort_values("owner")["totals"]:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).ravel())
    return np.concatenate(out) if out else np.empty(0, np.int64)


def word_chance(c: np.ndarray, tokens: np.ndarray | int, w: Weights) -> np.ndarray:
    return w.word * c / np.maximum(tokens, 1) + (1.0 - w.word) / (w.types + 1)


def bucket(frequency: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(frequency, 1)).astype(np.int64)


#: Logarithms are summed in whole parts of this size, so that the sums do not depend on their order.
PARTS = 1 << 16
_CELL = "bucket int, word int, pair int, n bigint, word_log bigint, pair_log bigint"


def _steps(share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Step of a share (0 for none at all, else from 1) and its logarithm."""
    some = share > 0
    log = np.log2(share, out=np.zeros(len(share)), where=some)
    return np.where(some, np.clip(np.floor(log * steps), -RANGE * steps, RANGE * steps - 1) + RANGE * steps + 1, 0).astype(np.int64), log


def _histogram(w: Weights):
    """Cells of the held-out tokens of a batch, their document deleted from the counts; bucket -1 where no context is left."""

    def histogram(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if batch.empty or answers.empty:
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype="float64") for c in _CELL.split(", ")})
        totals = _totals(answers)
        t = tokens_of(batch["docs"].iloc[0], word_hash())
        keep = t.head[t.doc, 2] == 1
        size = np.bincount(t.doc, minlength=len(t.head))

        def deleted(places: np.ndarray) -> np.ndarray:
            _, inverse, own = np.unique(t.doc * len(t.keys) + places, return_inverse=True, return_counts=True)
            return np.maximum(totals[places] - own[inverse], 0)

        word, pair = deleted(t.word), deleted(t.pair)
        context = np.concatenate([[0], word[:-1]])
        context[t.starts] = w.docs - 1
        word_step, word_log = _steps((word / np.maximum(w.tokens - size[t.doc], 1) * (w.types + 1))[keep], WORD_STEPS)
        pair_step, pair_log = _steps((pair / np.maximum(context, 1) * (w.types + 1))[keep], PAIR_STEPS)
        group = np.where(context > 0, bucket(context), -1)[keep]
        word_top, pair_top = 2 * RANGE * WORD_STEPS + 1, 2 * RANGE * PAIR_STEPS + 1
        cells, place, n = np.unique(
            ((group + 1) * word_top + word_step) * pair_top + pair_step, return_inverse=True, return_counts=True
        )
        return pd.DataFrame({
            "bucket": (cells // pair_top // word_top - 1).astype(np.int32), "n": n,
            "word": (cells // pair_top % word_top).astype(np.int32), "pair": (cells % pair_top).astype(np.int32),
            "word_log": np.bincount(place, np.rint(word_log * PARTS), len(cells)).astype(np.int64),
            "pair_log": np.bincount(place, np.rint(pair_log * PARTS), len(cells)).astype(np.int64),
        })

    return histogram


def learn(ratio: np.ndarray, n: np.ndarray) -> float:
    """The weight of the first of two components, by expectation-maximisation; ``ratio`` is first over second."""
    weight = 0.5
    for _ in range(ROUNDS):
        share = weight * ratio / (weight * ratio + 1.0 - weight)
        weight = min(max(float((share * n).sum() / n.sum()), 1e-6), 1.0 - 1e-6)
    return weight


def _fit(batches: DataFrame, answers: DataFrame, w: Weights) -> None:
    """Learn the weight of words, then those of pairs: of each bucket that has tokens, else of all buckets together."""
    parts = batches.select("batch", "docs").groupBy("batch").cogroup(
        answers.select("batch", "owner", "totals").groupBy("batch")
    ).applyInPandas(_histogram(w), _CELL)
    # At most 65 buckets of 257 by 513 steps, of which few are met.
    table = parts.groupBy("bucket", "word", "pair").agg(*[F.sum(c).alias(c) for c in ("n", "word_log", "pair_log")]).toPandas()
    n = table["n"].to_numpy(float)
    if not len(n):
        return
    word, pair = (np.where(table[c] > 0, 2.0 ** (table[f"{c}_log"].to_numpy(float) / PARTS / n), 0.0) for c in ("word", "pair"))
    w.word = learn(word, n)
    ratio = pair / (w.word * word + 1.0 - w.word)
    follows = (table["bucket"] >= 0).to_numpy()
    if follows.any():
        w.pair[:] = learn(ratio[follows], n[follows])
    for place, rows in table[follows].groupby("bucket").indices.items():
        w.pair[int(place)] = learn(ratio[follows][rows], n[follows][rows])


def _scorer(w: Weights):
    def score(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["named", "doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
        if batch.empty:
            return pd.DataFrame({c: pd.Series([], dtype="float64") for c in columns})
        totals = _totals(answers)
        t = tokens_of(batch["docs"].iloc[0], word_hash())
        word, pair = totals[t.word], totals[t.pair]
        context = np.concatenate([[0], word[:-1]])
        context[t.starts] = w.docs
        weight = np.where(context > 0, w.pair[bucket(context)], 0.0)
        chance = weight * pair / np.maximum(context, 1) + (1.0 - weight) * word_chance(word, w.tokens, w)
        base = np.log10((word + 0.5) / (w.tokens + 0.5 * (w.types + 1)))
        add = lambda x: np.add.reduceat(x, t.starts)  # noqa: E731  every document has a token
        return pd.DataFrame({
            "named": t.head[:, 0], "doc_id": t.head[:, 1], "train": t.head[:, 2],
            "n_tokens": np.bincount(t.doc, minlength=len(t.head)), "n_known": add((word > 0).astype(np.int64)),
            "base_score": add(base), "score": add(np.log10(chance)),
        })

    return score


def score(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows that are not held out."""
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(
        doc_id.isNotNull().cast("bigint").alias("named"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"),
        (~held_out).cast("bigint").alias("train"), F.col(text).alias("text"),
    )
    batches = durable(rows.mapInPandas(pack_batches, _PACKED))
    tokens, train_tokens, train_docs = (
        x or 0 for x in batches.agg(F.sum("n_tokens"), F.sum("train_tokens"), F.sum("train_docs")).first()
    )
    bits = (tokens // OWNED).bit_length()
    asked = batches.select("batch", "docs").mapInPandas(_asker(bits), "owner int, batch bigint, keys binary, counts binary")
    answers = durable(
        asked.groupBy("owner").applyInPandas(answer, "batch bigint, owner int, totals binary, types bigint")
    )
    w = Weights(train_tokens, answers.agg(F.sum("types")).first()[0] or 0, train_docs)
    if train_tokens:
        _fit(batches, answers, w)
    scored = batches.select("batch", "docs").groupBy("batch").cogroup(
        answers.select("batch", "owner", "totals").groupBy("batch")
    ).applyInPandas(
        _scorer(w), "named bigint, doc_id bigint, train bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(
        F.when(F.col("named") == 1, F.col("doc_id")).alias("doc_id"), (F.col("train") == 0).alias("held_out"),
        "n_tokens", "n_known", F.lit(train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
