from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tillwise.functions.lineage import written
from tillwise.llm.trie import BLOCK, numbered_turns, prefix_trie, rebuilt, running

CONVERSATIONS = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def originals(rows: list[tuple]) -> dict[int, list[tuple]]:
    """The turns of each conversation in order; equal turns go by the digest of role and text."""

    def place(row):
        _, turn, role, text = row
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        return (turn is not None, turn or 0, digest)

    found = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=place):
        found[row[0]].append((row[2] or "", row[3] or ""))
    return found


def rebuilt_by_hand(rows: list[tuple]) -> dict[int, list[tuple]]:
    own = originals(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))  # as in SQL, towards zero
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie_by_hand(conversations: dict[int, list[tuple]]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        size = len(path[-1][1].encode()) if path else 0
        saved[path] = (len(members[path]) - 1) * size + sum(saved[p] for p in below)
    out = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(conversations[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append(
            (min(ids), len(path), parent, len(ids), len(children[path]), leaves[path], saved[path],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def compare(spark, rows: list[tuple], parts: int = 5) -> None:
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(parts)
    turns, sizes = rebuilt(written(numbered_turns(table)))
    found = prefix_trie(turns, sizes).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == trie_by_hand(rebuilt_by_hand(rows))


def test_conversations_longer_than_many_blocks_with_shared_prefixes(spark):
    draw = random.Random(4)
    rows = []
    for c in range(30):
        shared = 5 * BLOCK + 3 if c % 3 == 0 else draw.randint(0, 12)
        length = shared + draw.randint(0, 3 * BLOCK)
        for t in range(length):
            text = f"é shared {t}" if t < shared else f"own {c} {t}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    compare(spark, rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "of no conversation"), (None, None, None, None),
        (0, None, "user", "first"), (0, 3, None, "x"), (0, 1, "user", None), (0, 1, "user", None), (0, 1, "a", "user"),
        (-7, 0, "user", "first"), (-7, 1, "user", ""), (-5, 0, "user", "first"),
        (3, 0, "1:", "u"), (8, 0, "1", ":u"), (9, None, None, None), (13, 0, "user", ""), (14, 1, "user", "z" * 3_000_000),
        (14, 2, "user", "z" * 3_000_000), (10, 1, "user", "z" * 3_000_000), (11, 0, "日本", "\U0001f600"),
    ]
    compare(spark, rows)
    compare(spark, [(1, 0, "user", "one turn of its own")])
    table = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie(*rebuilt(numbered_turns(table))).count() == 0


def test_a_third_of_all_conversations_are_one_and_one_holds_a_third_of_the_rows(spark):
    rows = [(5 * c, t, "user", f"same {t}") for c in range(150) for t in range(10)]
    rows += [(5 * c, t, "user", f"{c} {t}") for c in range(200, 260) for t in range(4)]
    rows += [(3001, t, "user", f"long {t % 7}") for t in range(900)]
    compare(spark, rows)


def test_running_folds_over_many_partitions(spark):
    draw = random.Random(2)
    rows = [(k % 3, k, draw.getrandbits(60)) for k in range(4000)]
    frame = spark.createDataFrame(rows, "g long, at long, v long").withColumn("s", F.lit(1).cast("bigint"))
    expected: dict[tuple, tuple] = {}
    held = defaultdict(int)
    for g, at, v in rows:
        held[g] ^= v
        expected[at] = held[g]
    found = running(frame, "g", ["at"], ["v"], "xor").collect()
    assert {r["at"]: r["v"] for r in found} == expected
    placed = running(frame, "g", ["at"], ["s"], "sum").collect()
    assert all(r["s"] == r["at"] // 3 + 1 for r in placed)
