from __future__ import annotations

import random
import re

from conftest import prose
from pyspark.sql import functions as F

from tillwise.llm import passages
from tillwise.llm.passages import LEAST, cut_passages, passages_stage

WORD = r"[^\x20\x09-\x0D]+"


def brute(rows):
    """Words inside a window of LEAST words that stands at an earlier place."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = re.findall(WORD, text or "")
        cut = [False] * len(words)
        for i in range(len(words) - LEAST + 1):
            window = tuple(words[i : i + LEAST])
            if window in seen:
                cut[i : i + LEAST] = [True] * LEAST
            seen.add(window)
        out[doc_id] = cut
    return out


def own(k, seed, count):
    """Words that no other text has, so a repeat ends where the passage does."""
    return " ".join(f"{word}{k}" for word in prose(seed, count).split())


def planted(seed, copies=12):
    """Texts that share passages of 40 to 300 words at any place."""
    draw = random.Random(seed)
    shared = [prose(1000 * seed + k, n).split() for k, n in enumerate((40, 49, 50, 51, 60, 75, 76, 77, 120, 300))]
    rows = []
    for k in range(copies * len(shared)):
        words = own(k, 7000 * seed + k, draw.randint(0, 90)).split() + shared[k % len(shared)]
        words += own(k, 9000 * seed + k, draw.randint(0, 90)).split()
        rows.append((k, "".join(w + draw.choice([" ", "\n", "  "]) for w in words)))
    rows.append((5000, " ".join(shared[5] + prose(5, 30).split() + shared[5])))
    return rows


def compare(found, rows):
    expected = brute(rows)
    for row in found:
        words = re.findall(WORD, dict(rows)[row["doc_id"]] or "")
        cut = [False] * len(words)
        for span in row["spans"]:
            cut[span["first"] : span["last"]] = [True] * (span["last"] - span["first"])
        assert cut == expected[row["doc_id"]], row["doc_id"]
        assert row["n_words"] == len(words) and row["cut_words"] == sum(cut)
        assert re.findall(WORD, row["text"]) == [w for w, gone in zip(words, cut, strict=True) if not gone]


def test_planted_passages_match_brute_force(spark):
    for seed in (1, 2):
        rows = planted(seed)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        compare(cut_passages(frame).collect(), rows)


def test_a_passage_in_most_rows_crosses_partitions(spark, monkeypatch):
    monkeypatch.setattr(passages, "BORDER_ROWS", 5)
    hot = prose(77, 58)
    rows = [(k, own(k, 100 + k, k % 50) + " " + hot + " " + own(k, 900 + k, (7 * k) % 60)) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(cut_passages(frame).collect(), rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_edited_copies_match_brute_force(spark):
    """Each copy has a few words changed, so an earlier text that is not next in any order holds the passage."""
    draw, base = random.Random(5), prose(11, 110).split()
    rows = []
    for k in range(400):
        words = list(base)
        for at in draw.sample(range(len(words)), 2):
            words[at] = f"edit{draw.randint(0, 9)}"
        rows.append((k, " ".join(words)))
    compare(cut_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect(), rows)


def test_periodic_texts_match_brute_force(spark):
    rows = []
    for k in range(60):
        cycle = prose(200 + k % 6, 1 + k % 5 + 4 * (k % 3)).split()
        body = (cycle * 200)[k % 7 : k % 7 + 60 + 11 * (k % 8)]
        rows.append((k, " ".join([own(k, 300 + k, k % 30), *body, own(k, 400 + k, (5 * k) % 40)])))
    compare(cut_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), rows)


def test_clean_texts_stay_as_they_are(spark):
    line = prose(3, LEAST - 1)  # one word short of a passage, in every text
    rows = [(k, own(k, 50 + k, 60) + "\n" + line + "\n" + own(k, 150 + k, 60)) for k in range(40)]
    found = cut_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    compare(found, rows)
    assert all(r["cut_words"] == 0 and r["text"] == dict(rows)[r["doc_id"]] for r in found)


def test_lines_a_word_short_of_a_passage_stay(spark):
    line = prose(3, LEAST - 1)
    rows = [(k, own(k, 50 + k, 60) + "\n" + line + "\n" + own(k, 150 + k, 60)) for k in range(40)]
    compare(cut_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_neighbours_leave_little_to_the_exact_pass(spark):
    """Copies and shared lines are settled by comparing neighbours; edits are what stays open."""
    line = prose(8, 70)
    rows = [(k, own(k, k, 40) + " " + line + " " + own(k, 500 + k, 40)) for k in range(60)]
    rows += [(100 + k, prose(9, 400)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = passages.suffixes(docs)
    places = kept.groupBy("doc_id", F.shiftright("place", 32).alias("tag")).agg(
        F.collect_set(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))).alias("places")
    )
    found = passages.packed_texts(docs, "text", "tag").join(places, ["doc_id", "tag"])
    left = passages.contexts(found).coalesce(1).sortWithinPartitions(*passages.SORTED)
    result = passages.compared(left)
    windows = sum(len(re.findall(WORD, text)) - LEAST + 1 for _, text in rows)
    assert result.where("key is not null").count() < windows / 10
    compare(cut_passages(docs).collect(), rows)


def test_ids_of_text_nulls_among_them_and_a_text_of_some_megabytes(spark):
    shared = prose(21, 80)
    long = " ".join(own(k, 600 + k, 3000) for k in range(40)) + " " + shared + " " + own(99, 31, 200_000)
    assert len(long) > 1_500_000
    rows = [("b", "x " + shared), (None, shared + " y"), ("a", long), ("b", shared + " another text of the id")]
    found = cut_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    cut = {(r["doc_id"], r["n_words"]): r["cut_words"] for r in found}
    assert cut[None, 81] == 0 and sorted(v for k, v in cut.items() if k[0] is not None) == [80, 80, 80]


def test_odd_rows_and_stage(spark, odd, clashing, empty):
    found = {(r["doc_id"], r["text"]): r for r in cut_passages(odd).collect()}
    by_id = {}
    for (doc_id, text), row in found.items():
        by_id.setdefault(doc_id, row)
    assert cut_passages(odd).count() == odd.count()
    assert by_id[1]["cut_words"] == 0 and by_id[2]["cut_words"] == 120 and by_id[10]["cut_words"] == 0
    assert by_id[11]["cut_words"] == 70 and by_id[4]["text"] is None and by_id[9]["cut_words"] == 0
    staged = passages_stage(spark, clashing, "")
    assert staged.columns == clashing.columns and staged.count() == odd.count()
    row = staged.where("doc_id = 11").first()
    assert row["n_chars"] == len(row["text"]) and row["spans"] == "spans of the table"
    assert cut_passages(empty).count() == 0 and passages_stage(spark, empty, "").count() == 0
