from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tillwise.llm import fingerprints as fp


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_bins_hold_the_least_hash_and_empty_ones_borrow(spark):
    from conftest import prose

    texts = [prose(k, n) for k, n in ((1, 4), (2, 9), (3, 40), (4, 300), (5, 3000))] + ["", "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    hashes = fp.shingle_hashes(F.col("text"))
    lender = [[0] * fp.BINS for _ in range(fp.BINS)]
    pairs = spark.range(fp.BINS).crossJoin(spark.range(fp.BINS).withColumnRenamed("id", "other"))
    for row in pairs.select("id", "other", F.xxhash64("id", "other").alias("turn")).collect():
        lender[row["id"]][row["other"]] = row["turn"]
    found = frame.select("text", hashes.alias("all"), fp.densified(fp.least_by_bin(hashes)).alias("dense"), fp.as_text(fp.packed(F.col("text"))).alias("digits"))
    for row in found.collect():
        assert len(set(row["all"])) == len(shingles(row["text"]))
        least = {}
        for value in row["all"]:
            least[value >> fp.LOW] = min(value, least.get(value >> fp.LOW, value))
        for j, value in enumerate(row["dense"]):
            own = least[min(least, key=lambda i: lender[j][i])] if j not in least else least[j]
            assert value >> fp.LOW == j and value & fp.VALUE == own & fp.VALUE
        assert row["digits"] == "".join(f"{value % 16:x}" for value in row["dense"])


def test_likeness_estimates_similarity(spark):
    draw, rows = random.Random(2), []
    for k in range(150):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(60, 400))]
        other = [w if draw.random() > (k % 10) * 0.02 else "changed" for w in words]
        rows.append((" ".join(words), " ".join(other)))
    frame = spark.createDataFrame(rows, "a string, b string")
    both = frame.withColumns({"x": fp.packed(F.col("a")), "y": fp.packed(F.col("b"))})
    got = both.select("a", "b", fp.likeness(F.col("x"), F.col("y")).alias("near"), fp.likeness(F.col("x"), F.col("x")).alias("same"))
    errors = []
    for row in got.collect():
        assert row["same"] == 1.0 and 0 <= row["near"] <= 1
        errors.append(row["near"] - similarity(row["a"], row["b"]))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_edited_texts_match_brute_force(spark, odd, clashing, empty):
    from conftest import odd_rows, prose

    rows = [(9 * k - 40, prose(k, 3 + 7 * k) + " é日\U0001f600" * (k % 3)) for k in range(30)]
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows)
    for k, (doc_id, text) in enumerate(ordered):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + ordered[(k + 1) % len(ordered)][1][:quarter]
        assert got[doc_id]["n_chars"] == len(text)
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    same = defaultdict(set)
    found = fp.edited_fingerprints(clashing)
    assert found.count() == odd.count()
    texts = {row[0]: row[1] for row in odd_rows()}
    for row in found.collect():
        same[" ".join((texts[row["doc_id"]] or "").split())].add(row["fingerprint"])
    assert all(len(prints) == 1 for text, prints in same.items() if text != " ".join(texts[None] or "" ).strip())
    assert fp.edited_fingerprints(empty).count() == 0
    named = fp.fingerprints(odd.withColumn("fingerprint", F.lit(1)))
    assert named.columns == [*odd.columns, "fingerprint"] and named.count() == odd.count()
    alone = fp.edited_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1.0
