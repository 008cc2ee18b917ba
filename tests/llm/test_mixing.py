from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


from tillwise.llm.mixing import mixing_stage, sizes, source_targets, weighted_mix


def filled(source_sizes, weights, share, passes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in source_sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in source_sizes)
    weight = {name: weights[k % len(weights)] for k, name in enumerate(names)}
    total, full = share * sum(source_sizes.values()), set()
    while True:
        rest = sum(weight[n] for n in names if n not in full)
        level = (total - sum(passes * source_sizes[n] for n in full)) / rest if rest else 0
        over = {n for n in names if n not in full and level * weight[n] > passes * source_sizes[n]}
        if not over:
            return {n: passes * source_sizes[n] if n in full else level * weight[n] for n in names}
        full |= over


def test_targets_share_the_excess(spark):
    cases = [{"a": 100, "b": 5000, "c": 10, "é": 700, "z": 1, None: 300}, {"x": 7}, {"a": 0, "b": 10}]
    for sizes_ in cases:
        rows = spark.createDataFrame([(s, n) for s, n in sizes_.items()], "source string, size long")
        expected = filled(sizes_, (5, 2, 1), 1.5, 2)
        for row in source_targets(rows).collect():
            assert abs(row["target"] - expected[row["source"]]) < 1e-6
            assert row["source_size"] == sizes_[row["source"]]


def queue(rows, targets, source_sizes, budget):
    """One virtual clock over all queues."""
    order = defaultdict(list)
    for doc_id, source, size in rows:
        key = hashlib.md5(("mix" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
        order[source].append((key, doc_id is not None, doc_id, size))
    names = sorted((s for s in order if s is not None), key=lambda s: s.encode()) + [None] * (None in order)
    copies = []
    for rank, source in enumerate(names):
        sent = 0
        for place, (_, _, doc_id, size) in enumerate(sorted(order[source])):
            sent += size
            for turn in (0, 1):
                if targets[source]:
                    copies.append(((turn * source_sizes[source] + sent) / targets[source], rank, turn, place, doc_id, size))
    taken, used = Counter(), 0
    for _, _, _, _, doc_id, size in sorted(copies, key=lambda c: c[:4]):
        used += size
        if used <= budget:
            taken[doc_id] += size
    return taken


def test_the_mix_follows_virtual_finish_times(spark):
    import random

    draw = random.Random(6)
    rows = [(k, draw.choice(["a", "a", "a", "b", "c", None]), draw.randint(0, 40)) for k in range(900)]
    source_sizes = Counter()
    for _, source, size in rows:
        source_sizes[source] += size
    targets = filled(source_sizes, (5, 2, 1), 1.5, 2)
    taken = queue(rows, targets, source_sizes, 1.5 * sum(source_sizes.values()))
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(7)
    got = weighted_mix(frame).collect()
    assert {r["doc_id"]: r["times"] * r["size"] for r in got} == {k: taken[k] for k, _, _ in rows}
    for source, target in targets.items():
        words = sum(r["times"] * r["size"] for r in got if r["source"] == source)
        assert abs(words - target) <= 0.05 * target + 40
    assert all(r["times"] <= 2 for r in got)


def test_odd_rows_and_stage(spark, odd, clashing, empty):
    rows = weighted_mix(sizes(odd)).collect()
    assert len(rows) == odd.count() and {r["source"] for r in rows} == {"a", "b", "c", "é", None}
    mixed = mixing_stage(spark, clashing, "")
    assert mixed.columns == clashing.columns
    expected = Counter()
    for row in rows:
        expected[row["doc_id"]] += row["times"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +expected
    assert weighted_mix(sizes(empty)).count() == 0 and mixing_stage(spark, empty, "").count() == 0
