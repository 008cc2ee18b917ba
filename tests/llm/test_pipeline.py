from __future__ import annotations

import zlib

import corpus_pipeline
import pytest
from conftest import prose
from test_passages import brute

import __spark_entry__ as entry

NAMES = ("packing", "training_order", "chat_formatting", "language_id", "suffix_array_dedup", "quality_rules",
         "document_fingerprints", "source_mixing", "url_filters", "ngram_jaccard_join", "conversation_trie",
         "hard_negatives", "exact_dedup")


def test_every_operator_and_the_pipeline_are_registered():
    found = entry.queries()
    assert all(f"op{k}_{name}" in found for k, name in enumerate(NAMES, 1)) and "pipeline" in found
    assert [name for name, _ in corpus_pipeline.STAGES] == [NAMES[5], NAMES[9], NAMES[4], NAMES[7], NAMES[0]]


@pytest.fixture
def corpus(spark):
    shared = prose(1, 80)
    rows = [(k, prose(10 + k, 150), "en", "ab"[k % 2], 0) for k in range(40)]
    rows += [(100 + k, prose(10 + k, 150) + " more", "en", "a", 0) for k in range(10)]  # near copies
    rows += [(200 + k, prose(300 + k, 60) + " " + shared + " " + prose(500 + k, 60), "en", "c", 0) for k in range(8)]
    rows += [(300 + k, "buy now " * 60, "en", "a", 0) for k in range(4)]  # rejected
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def test_stages_act_on_what_the_stage_before_kept(spark, corpus):
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""))
        assert docs.columns == corpus.columns
        seen[name] = docs.collect()
    ids = {name: sorted(r["doc_id"] for r in rows) for name, rows in seen.items()}
    clean, hot = list(range(40)), list(range(200, 208))
    assert ids["quality_rules"] == clean + list(range(100, 110)) + hot
    assert ids["ngram_jaccard_join"] == ids["suffix_array_dedup"] == clean + hot
    before = [(r["doc_id"], r["text"]) for r in seen["ngram_jaccard_join"]]
    for row in seen["suffix_array_dedup"]:
        kept = sum(not gone for gone in brute(before)[row["doc_id"]])
        assert len(row["text"].split()) == kept and row["n_chars"] == len(row["text"])
    assert set(ids["source_mixing"]) <= set(clean + hot)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(p["start"] == 0 for p in pieces) == len(seen["source_mixing"])
    assert all(len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)


def test_run_on_a_folder_and_an_empty_table(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "full" / "documents.parquet"))
    corpus.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
