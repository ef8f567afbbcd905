"""The exact test of near pairs: every set goes to a task once, whatever the number of its pairs."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from wardlake.llm import jaccard


def test_pairs_of_a_component_meet_in_one_task(spark, monkeypatch):
    rows = [(1, b, 300, 300) for b in range(2, 40)] + [(2, b, 300, 300) for b in range(3, 40)] + [(50, 51, 300, 300)]
    near = spark.createDataFrame(rows, "a bigint, b bigint, na bigint, nb bigint")
    dealt = jaccard._dealt(near)
    assert sorted(map(tuple, dealt.select("a", "b", "na", "nb").collect())) == sorted(rows)
    assert dealt.filter("a < 50").select("task").distinct().count() == 1
    monkeypatch.setattr(jaccard, "HELD", 2_000)  # a component that is too large is cut
    cut = jaccard._dealt(near)
    assert sorted(map(tuple, cut.select("a", "b", "na", "nb").collect())) == sorted(rows)
    assert cut.select("task").distinct().count() > 1


def test_the_same_links_as_all_pairs(spark, monkeypatch):
    draw = random.Random(3)
    sets = {}
    for cls in range(60):
        if cls % 10:
            base = sets[cls - cls % 10]
            kept = draw.sample(sorted(base), len(base) - draw.randrange(12))
            sets[cls] = set(kept) | {draw.getrandbits(64) for _ in range(draw.randrange(12))}
        else:
            sets[cls] = {draw.getrandbits(64) for _ in range(60)}

    def packed(shape):
        rows = [(c, bytearray(shape(np.array(sorted(s), np.uint64)))) for c, s in sets.items()]
        return spark.createDataFrame(rows, "cls bigint, shape binary")

    class Texts:
        sketches = packed(lambda found: jaccard.sketch(found).tobytes())

        def sets(self, classes):
            return packed(lambda found: found.tobytes())

    pairs = [(a, b, len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sets, 2)]
    expected = {(a, b) for a, b, *_ in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert 20 < len(expected) < len(pairs) / 2
    for held in (1 << 18, 300):
        monkeypatch.setattr(jaccard, "HELD", held)
        got = jaccard._verified(spark.createDataFrame(pairs, "a bigint, b bigint, na bigint, nb bigint"), Texts(), 80)
        found = [tuple(r) for r in got.select(F.col("a"), F.col("b")).collect()]
        assert set(found) == expected and len(found) == len(expected)
