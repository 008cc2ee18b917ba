from __future__ import annotations

import random
import re

from tillwise.functions.components import components
from tillwise.llm.jaccard import jaccard_components, jaccard_stage


def brute(rows, width, percent):
    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return sorted((doc_id, len(sets[k]), least[root(k)]) for k, (doc_id, _) in enumerate(rows))


def copies(seed):
    """Groups of edited copies, a chain, shared passages, short texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(draw.randint(1, 6)))
    rows, passage = [], " ".join(word() for _ in range(25))
    for _ in range(6):
        base = [word() for _ in range(draw.randint(20, 120))]
        for _ in range(draw.randint(1, 14)):
            text = list(base)
            for _ in range(draw.randint(0, 6)):
                text[draw.randrange(len(text))] = word()
            rows.append(" ".join(text).upper() if draw.random() < 0.2 else "  ".join(text))
        rows.append(passage + " " + " ".join(word() for _ in range(40)))
    chain = [word() for _ in range(150)]
    for step in range(12):
        rows.append(" ".join(chain[step * 4 : step * 4 + 100]))
    rows += ["a", "A", "a b", "", " \n", "a b c", "a b c d", "x x x x x x", "x x x x"]
    draw.shuffle(rows)
    return [(7 * k + 3, text) for k, text in enumerate(rows)]


def test_links_match_brute_force(spark):
    for seed, width, percent in ((1, 4, 85), (2, 5, 80), (3, 4, 85)):
        rows = copies(seed)
        found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
        assert sorted(map(tuple, found.collect())) == brute(rows, width, percent)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 20)] + [(200, 201), (201, 200)]
    draw = random.Random(5)
    draw.shuffle(edges)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_stage(spark, odd, clashing, empty):
    found = jaccard_components(odd, 5, 80).collect()
    by_id = {r["doc_id"]: r["component_id"] for r in found}
    assert len(found) == odd.count()
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[4] == 4 and by_id[7] == by_id[8] == 7
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)
    kept = jaccard_stage(spark, clashing, "")
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12]
    assert sum(i is None for i in ids) == 3
    assert jaccard_components(empty).count() == 0 and jaccard_stage(spark, empty, "").count() == 0
