"""Connected components by stars against a search over the links."""

from __future__ import annotations

import random

from tillwise.functions.components import components


def test_components_of_chains_stars_and_random_links(spark):
    draw = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(100, 101 + k) for k in range(40)]
    links += [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(45)] + [(5, 5), (3, 2), (3, 2)]
    near: dict[int, set[int]] = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for node in sorted(near):
        if node not in expected:
            todo = [node]
            while todo:
                at = todo.pop()
                if at not in expected:
                    expected[at] = node
                    todo += near[at]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == expected and len(found) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
