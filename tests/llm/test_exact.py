from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import CLASHING, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwise.functions.lineage import written
from tillwise.llm.exact import Coded, decoded, exact_duplicates, golomb, without_duplicates


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, text_sha256) per row, sorted."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def compare(frame, rows: list[tuple]) -> None:
    found = [tuple(r) for r in frame.select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()]
    assert sorted((r[:4] for r in found), key=str) == brute_force(rows)
    kept = [r for r in found if r[4]]
    assert all(r[0] == r[1] for r in kept)
    assert sorted(r[3] for r in kept) == sorted({r[3] for r in found})


@given(st.sets(st.integers(0, (1 << 40) - 1), min_size=1, max_size=300), st.booleans())
@settings(max_examples=60, deadline=None)
def test_golomb_codes_come_back(values, crowded):
    width = 16 if crowded else 40
    sorted_values = np.unique(np.array([v % (1 << width) for v in values], np.uint64))
    code = golomb(sorted_values, width)
    assert decoded(code).tolist() == sorted_values.tolist()
    if len(sorted_values) > 50:
        assert 8 * (len(code.quotients) + len(code.remainders)) < len(sorted_values) * (width - np.log2(len(sorted_values)) + 3)


def test_codes_of_no_values():
    assert decoded(golomb(np.zeros(0, np.uint64), 20)).tolist() == []
    assert decoded(Coded(1, 0, b"\x80", b"")).tolist() == [0]


def test_odd_rows(spark, odd, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    compare(exact_duplicates(odd), rows)
    compare(exact_duplicates(clashing), rows)
    assert exact_duplicates(empty).count() == 0
    left = without_duplicates(clashing).collect()
    assert sorted(r["text"] or "" for r in left) == sorted({text or "" for _, text in rows})
    assert left[0].asDict().keys() >= set(CLASHING)
    assert without_duplicates(empty).columns == empty.columns


def test_a_text_with_a_third_of_all_rows_over_many_partitions(spark):
    rows = [(k, "the same text" if k % 3 == 0 else prose(k % 700, 12)) for k in range(3000)]
    table = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(23, "doc_id"))
    compare(exact_duplicates(table), rows)


def test_long_texts_are_compared_whole(spark):
    long = prose(5, 3000) * 150
    assert len(long) > 2_000_000
    rows = [(1, long), (2, long), (3, long + "x"), (4, "x" + long), (5, long[:-1]), (6, long)]
    compare(exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_normalised_texts_and_ids_of_other_types(spark):
    rows = [("a", "One"), ("b", "one"), ("c", "two"), (None, "ONE")]
    table = spark.createDataFrame(rows, "k string, body string")
    found = exact_duplicates(table, "k", "body", F.lower).collect()
    assert {r["k"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found} == {
        "a": ("b", 3, False), "b": ("b", 3, True), "c": ("c", 1, True), None: ("b", 3, False),
    }


def test_a_table_that_changes_is_an_error(spark):
    from tillwise.llm.exact import listed_by_part, numbered, picked

    table = spark.createDataFrame([(k, f"t{k}") for k in range(9)], "doc_id long, text string")
    other = F.xxhash64(F.concat("text", F.lit("!")))
    marks = table.select(numbered(table).alias("row"), other.alias("hash"))
    marks = marks.withColumn("part", F.expr("shiftright(row, 33)"))
    with pytest.raises(Exception, match="changed"):
        picked(table, F.col("text"), listed_by_part(marks), True).count()
