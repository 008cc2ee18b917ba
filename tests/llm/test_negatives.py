from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm.negatives import Block, mine_negatives, whole_vectors

VECTORS = "vec_id long, label int, vector array<long>"


def brute_force(rows: list[tuple], every: int, positives: int = 5, negatives: int = 10) -> list[tuple]:
    least: dict[int, tuple] = {}
    for i, label, vector in rows:
        if None not in (i, label, vector):
            least[i] = min(least.get(i, (label, vector)), (label, vector))

    def score(a, b):
        return sum(x * y for x, y in zip(least[a][1], least[b][1], strict=False))

    out = []
    for a in least:
        if a % every:
            continue
        scores = {b: score(a, b) for b in least if b != a}
        same = sorted((-s, b) for b, s in scores.items() if least[b][0] == least[a][0])[:positives]
        for p, b in same:
            other = sorted((-s, c) for c, s in scores.items() if least[c][0] != least[a][0] and -30 * p <= 100 * s <= -90 * p)
            out += [(a, b, k, c, -p, -s) for k, (s, c) in enumerate(other[:negatives], 1)]
    return sorted(out)


def compare(spark, rows: list[tuple], every: int = 10, **numbers) -> None:
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = mine_negatives(table, F.col("vec_id") % every == 0, **numbers)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, every, **numbers)


def random_rows(seed: int, count: int, width: int, spread: int = 60) -> list[tuple]:
    draw = np.random.default_rng(seed)
    vectors = (draw.normal(size=(count, width)) * spread * np.linspace(1, 0.1, width)).astype(int)
    return [(k, int(draw.integers(4)), v.tolist()) for k, v in enumerate(vectors)]


def test_windows_equal_brute_force(spark):
    compare(spark, random_rows(1, 700, 20), every=25)


def test_ties_and_a_vector_that_a_third_of_all_rows_hold(spark):
    rows = random_rows(2, 300, 9, 3)
    common = [6, 5, 4, 3, 2, 1, 1, 1, 1]
    rows = [(i, label, common if i % 3 == 0 else v) for i, label, v in rows]
    compare(spark, rows, every=20, positives=3, negatives=4)


def test_thresholds_fall_until_the_windows_are_full(spark, monkeypatch):
    import tillwise.llm.negatives as module

    monkeypatch.setattr(module, "SAMPLE", 40)  # first thresholds far off
    rows = random_rows(3, 600, 12)
    rows = [(i, 9 if i >= 597 else label, v) for i, label, v in rows]  # fewer rows of a label than positives
    compare(spark, rows, every=40)
    compare(spark, [(i, label if i else 9, v) for i, label, v in rows[:60]], every=60)


def test_odd_rows(spark):
    rows = [
        (0, 1, [1, 2, 3]), (0, 1, [1, 2, 3]), (10, 1, [1, 2]), (10, 2, [1, 2]), (11, 1, [3, 3, 3, 4]), (12, 2, []), (13, 2, [2, 1]),
        (None, 1, [1]), (14, None, [1, 1, 1]), (15, 1, None), (20, 2, [-1, -2, -3]), (21, 2, [0, 0, 0]), (22, 1, [1, 1, 1]),
        (23, 2, [2**40, 2**21, 1]), (24, 1, [2**21, 2**40, 1]), (30, 3, [5]), (-10, 2, [2, 2, 2]),
    ]
    compare(spark, rows)
    empty = spark.createDataFrame([], VECTORS)
    assert mine_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert mine_negatives(spark.createDataFrame(rows[:1], VECTORS), F.col("vec_id") == 7).count() == 0
    clashing = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit("of the table") for n in ("block", "kind", "windows", "score")})
    assert sorted(map(tuple, mine_negatives(clashing, F.col("vec_id") % 10 == 0).collect())) == brute_force(rows, 10)
    with pytest.raises(Exception, match="(?i)overflow|too (large|big)|out of bounds|convert"):
        huge = spark.createDataFrame([(0, 1, [2**62, 2**62]), (1, 1, [2**62, 2**62]), (2, 2, [1, 1])], VECTORS)
        mine_negatives(huge, F.col("vec_id") == 0).collect()


def test_components_and_labels_of_the_table(spark):
    rows = [(7, [0.5, -0.001], 9), (8, [float("nan"), 1.0], 1), (9, [1.0, None], 1), (10, [float("inf"), 0.0], 1), (11, None, 1), (14, [1.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, whole_vectors(table).collect())) == [(7, 0, [128, -1]), (14, None, [256])]


def test_the_index_leaves_dimensions_out_and_loses_no_pair():
    draw = np.random.default_rng(7)
    vectors = np.trunc(draw.normal(size=(2000, 64)) * np.linspace(60, 1, 64))
    block = Block(np.arange(2000), np.zeros(2000, int), vectors)
    anchors = vectors[:20]
    exact = anchors @ vectors.T
    for least in (np.full(20, 20_000.0), np.full(20, 60_000.0), np.full(20, -1e9), np.sort(exact, axis=1)[:, -5]):
        for k, (places, scores) in enumerate(block.pairs(anchors, least)):
            assert sorted(places.tolist()) == np.flatnonzero(exact[k] >= least[k]).tolist()
            assert (scores == exact[k, places]).all()
    touched = defaultdict(int)
    whole = Block.accumulate

    def counted(partial, mine, rows, lengths, chunk):
        touched[chunk] += int((lengths > chunk).sum())
        whole(partial, mine, rows, lengths, chunk)

    block.accumulate = counted
    list(block.pairs(anchors, np.sort(exact, axis=1)[:, -5]))
    assert touched[0] <= 2000 and max(touched) < 4 and touched[3] < 2000
