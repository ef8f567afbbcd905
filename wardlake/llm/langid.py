"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything but letters becomes one space. All 1- to 4-grams of code points are hashed into
``BUCKETS`` classes and counted per language in every task; one shuffle adds the counts up. The log-probability matrix
(languages x buckets, at most ``MAX_CELLS`` numbers) is broadcast, and each task scores its texts as sparse rows:
gather the matrix at the hashed n-grams of the text and add up.

Edge cases: null text and text without a letter give ``und`` with score 0, so does a model without training rows.
Rows without a language train nothing. Repeated rows count and are scored as often as they occur; equal scores go to the
smaller language name. Very long texts are worked through in slices. Other columns are kept as they are; columns named
``lang_pred`` or ``score`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import mix
from wardlake.session import durable

BUCKETS = 1 << 15
ORDERS = 4
#: Bound of the broadcast matrix: 512 MB of doubles, about 2,000 languages.
MAX_CELLS = 1 << 26
UNKNOWN = "und"

_SLICE = 1 << 17
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log probability of each language
    weights: np.ndarray  # buckets x languages, log probabilities


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, slice by slice; every n-gram exactly once."""
    clean = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), _SLICE):
        piece = codes[start : start + _SLICE + ORDERS - 1].astype(np.uint64)
        own = min(_SLICE, len(codes) - start)
        h, parts = np.zeros(len(piece), np.uint64), []
        for n in range(1, ORDERS + 1):
            if len(piece) < n:
                break
            h = (h[: len(piece) - n + 1] + np.uint64(n)) * _STEP + piece[n - 1 :]
            parts.append(mix(h[:own]) >> np.uint64(64 - BUCKETS.bit_length() + 1))
        yield np.concatenate(parts).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (lang, bucket, n) of one task; bucket -1 counts documents."""

    held: dict[str, np.ndarray] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def add_up() -> None:
        for lang, parts in waiting.items():
            held[lang][1:] += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        waiting.clear()

    def rows() -> Iterator[pd.DataFrame]:
        add_up()
        for lang, counts in held.items():
            buckets = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": (buckets - 1).astype(np.int32), "n": counts[buckets]})
        held.clear()

    size = 0
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"]):
            if not has_letter(text):
                continue
            if lang not in held and len(held) >= 256:  # a bound on memory; the shuffle adds up all parts
                yield from rows()
            held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[0] += 1
            for buckets in grams(text):
                waiting.setdefault(lang, []).append(buckets)
                size += len(buckets)
                if size > 1 << 20:
                    add_up()
                    size = 0
    yield from rows()


def fit(train: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Learn from all rows of ``train`` that have a text and a language."""
    rows = train.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.dropna().mapInPandas(count_grams, "lang string, bucket int, n bigint")
    totals = durable(parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    known = totals.filter("bucket = -1").select("lang", "n").orderBy("lang").limit(MAX_CELLS // BUCKETS + 1).collect()
    if len(known) * BUCKETS > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS // BUCKETS} languages; the matrix would pass its bound")
    languages = sorted(r["lang"] for r in known)
    table = totals.filter("bucket >= 0").toPandas() if languages else pd.DataFrame({"lang": [], "bucket": [], "n": []})
    counts = np.zeros((BUCKETS, len(languages)))
    place = {name: i for i, name in enumerate(languages)}
    counts[table["bucket"].to_numpy(int), table["lang"].map(place).to_numpy(int)] = table["n"].to_numpy(float)
    documents = np.array([dict(known)[name] for name in languages], float)
    return Model(
        languages,
        np.log(documents / documents.sum()) if languages else documents,
        np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * BUCKETS),
    )


def score_texts(texts: pd.Series, model: Model) -> pd.DataFrame:
    names, scores = [], []
    for text in texts:
        if not model.languages or not has_letter(text):
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        logs = model.prior.copy()
        for buckets in grams(text):
            logs += model.weights[buckets].sum(axis=0)
        best = int(np.argmax(logs))
        names.append(model.languages[best])
        scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
    return pd.DataFrame({"lang_pred": names, "score": scores})


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (the posterior probability of the language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield score_texts(batch, shared.value)

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    named = docs.withColumn("__found", predicted(F.col(text)))
    return named.select(*[F.col(f"`{c}`") for c in kept], "__found.lang_pred", "__found.score")
