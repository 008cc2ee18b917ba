from __future__ import annotations

import re
from collections import Counter

import pytest
import zstandard

from tillwise.llm.quality import BANDS, limits, quality, quality_stage

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, inside = Counter(grams), set()
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            inside.update(range(i, i + 5))
    lines = text.split("\n")
    again = sum(bool(re.search(WORD, line)) and line in lines[:i] for i, line in enumerate(lines))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside), failed


def test_base_measures_match_brute_force(spark):
    texts = [
        "a b c d e f a b c d e x y",
        "line one\nline one\n\n\n  \nline one\nx",
        "The " * 40,
        "#*$ %&| <> \x0b\x0c\r\x1f",
        None,
        "",
        "a b c d e a b c d e a b c d e",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality(rows).collect()}
    for at, text in enumerate(texts):
        row = got[at]
        assert brute(text) == (
            row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]
        )
        assert not (row["base_failed"] and row["kept"])


def test_bands_reject_repetition_and_noise(spark):
    import random

    draw = random.Random(3)
    noise = " ".join("".join(chr(draw.randint(33, 126)) for _ in range(9)) for _ in range(400))
    words = [f"w{i}" for i in range(300)]
    loop = " ".join(f"{words[i % 40]}{i // 200}" for i in range(4000))
    from conftest import prose

    rows = spark.createDataFrame([(1, noise), (2, loop), (3, prose(9, 900))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality(rows).collect()}
    assert not got[1]["base_failed"] and not got[1]["kept"] and got[1]["ratio"] < limits(4000).least
    assert not got[2]["kept"] and got[2]["ratio"] > limits(20000).most
    assert got[3]["kept"]
    whole = noise.encode()
    assert got[1]["ratio"] == pytest.approx(len(whole) / len(zstandard.ZstdCompressor(level=3).compress(whole)))
    assert [b.size for b in BANDS] == sorted(b.size for b in BANDS)


def test_stage_keeps_columns_and_clean_rows(spark, odd, clashing, empty):
    from conftest import CLASHING

    kept = quality_stage(spark, clashing, "")
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 9, 10, 11, None}
    assert sum(r["doc_id"] == 2 for r in rows) == 2
    assert all(r[name] == f"{name} of the table" for r in rows for name in CLASHING)
    assert quality_stage(spark, empty, "").count() == 0
    assert quality(odd).count() == odd.count()


def test_chunks_decide_where_the_whole_text_fits(spark):
    """Good prose with noise inside: the whole ratio lies in its band, too many chunks do not."""
    import random

    from conftest import prose

    from tillwise.llm.quality import CHUNK_BYTES

    draw = random.Random(8)
    noise = lambda: " ".join("".join(chr(draw.randint(33, 126)) for _ in range(9)) for _ in range(CHUNK_BYTES // 10 + 1))[:CHUNK_BYTES]
    good = lambda k: (prose(k, 1500) + " ")[:CHUNK_BYTES]
    repeated = (prose(1, 30) + " x y z ") * 40
    mixed = "".join(noise() if k % 2 else good(k) + good(k)[: CHUNK_BYTES // 2] * 2 for k in range(12))
    texts = ["".join(good(k) for k in range(12)), mixed, repeated[:CHUNK_BYTES], prose(2, 400_000)]
    assert len(texts[3]) > 2_000_000
    rows = {r["doc_id"]: r for r in quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0]["n_chunks"] >= 11 and rows[0]["bad_chunks"] == 0 and rows[0]["kept"]
    band = limits(len(texts[1]))
    assert band.least <= rows[1]["ratio"] <= band.most
    assert rows[1]["bad_chunks"] >= 4 and not rows[1]["kept"]
    assert rows[2]["n_chunks"] == 0
    assert rows[3]["n_words"] == 400_000 and rows[3]["n_chunks"] > 400
