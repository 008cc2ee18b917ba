from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tillwise.llm import ordering
from tillwise.llm.packing import pack, packing_stage
from tillwise.llm.tokens import BatchEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids]


TEXTS = [
    "", None, "  ", "A'S don't I'LL 'sx 3rd 1½ Σας ΣΑΣ İ ﬁ é <|endoftext|>hi", "ÀÉ×÷ß ÿŸ µª", "日本語 テスト, ok\x1cz\x85y w",
    "''s 't_x__y #$%'re--", "naïvë x\ufeffy", "²³ 10,000 x²", "a\u00a0b\u2003c", "e\u0301 \u0301", "x\x00y \x7f", "'", "é ", "a×b",
]


def test_batch_encoder_equals_the_tokenizer():
    encoder = BatchEncoder(PATH)
    draw = random.Random(4)
    mixed = ["".join(draw.choice("aAzé É'9.ß<| \n日ñ×") for _ in range(draw.randint(0, 40))) for _ in range(300)]
    for texts in (TEXTS, mixed, mixed[::-1]):
        got = [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.string()))]
        assert got == [ids_of(text) for text in texts]
    assert list(encoder.encode(pa.array([], pa.string()))) == []


def check(rows, texts, length, keep_ids=True):
    """Every id in one piece, offsets gapless, lengths within bounds; returns the sequences' lengths."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append(row)
    assert set(pieces) == set(range(len(texts)))
    for doc_id, text in enumerate(texts):
        ids, at = np.array([*ids_of(text), 1], "<u4"), 0
        for row in sorted(pieces[doc_id], key=lambda r: r["start"]):
            content = ids[at : at + row["length"]].tobytes()
            assert row["start"] == at and row["doc_tokens"] == len(ids) and row["ids_crc32"] == zlib.crc32(content)
            if keep_ids:
                assert bytes(row["ids"]) == content
            at += row["length"]
        assert at == len(ids)
    lengths = []
    for held in sequences.values():
        at = 0
        for row in sorted(held, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= length
        lengths.append(at)
    return lengths


def test_every_id_is_packed_once_with_little_padding(spark):
    draw = random.Random(8)
    texts = [" ".join("abc" for _ in range(draw.choice([1, 5, 30, 63, 64, 65, 200, 700]))) for _ in range(400)] + TEXTS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 9):
        rows = pack(docs.repartition(parts), PATH, length=64, open_windows=5).collect()
        lengths = check(rows, texts, 64)
        padding = sum(64 - n for n in lengths if n & (n - 1))
        assert padding <= 0.25 * sum(lengths)  # at most SLACK of 64 places
    rows = packing_stage(spark, docs.repartition(3), "").collect()
    lengths = check(rows, texts, 2048, keep_ids=False)
    assert sum(2048 - n for n in lengths if n & (n - 1)) <= 0.01 * sum(lengths)


def test_merging_goes_on_over_several_rounds(spark, monkeypatch):
    from tillwise.llm import packing

    monkeypatch.setattr(packing, "FAN_IN", 2)
    texts = [" ".join(["abc"] * (k % 37)) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    check(pack(docs, PATH, length=32, open_windows=3).collect(), texts, 32)


def test_odd_rows_pack_and_empty_tables_do_not(spark, odd, clashing, empty):
    rows = pack(clashing, PATH, length=2048).collect()
    assert sum(r["start"] == 0 for r in rows) == odd.count()
    assert sum(r["start"] == 0 for r in rows if r["doc_id"] is None) == 3
    assert pack(empty, PATH).count() == 0


def test_slots_are_a_keyed_permutation():
    for total in (1, 2, 3, 16, 17, 1000, 40_001):
        found = ordering.slots(np.arange(total), total, key=5)
        assert sorted(found.tolist()) == list(range(total))
    one, two = (ordering.slots(np.arange(5000), 5000, key=k) for k in (1, 2))
    assert (one != two).mean() > 0.99 and abs(np.corrcoef(one, np.arange(5000))[0, 1]) < 0.05
    # A slot is found for each index on its own.
    assert one[1234] == ordering.slots(np.array([1234]), 5000, key=1)[0]


def test_shards_come_back_from_any_slot(spark, odd, empty, tmp_path):
    layout = ordering.materialise(odd, PATH, length=16, per_shard=50, folder=str(tmp_path / "shards"))
    rows = sorted(ordering.read_slots(spark, layout).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(layout.total))
    expected = []
    for row in odd.collect():
        ids = [*ids_of(row["text"]), 1]
        expected += [(row["doc_id"], k, ids[16 * k : 16 * k + 16]) for k in range(-(-len(ids) // 16))]
    got = [(r["doc_id"], r["part"], np.frombuffer(bytes(r["ids"]), "<u2").tolist()) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    sizes = [(tmp_path / "shards" / f"shard-{k:08d}.bin").stat().st_size for k in range(layout.shards)]
    assert all(size == 50 * layout.record.itemsize for size in sizes[:-1])
    part = sorted(ordering.read_slots(spark, layout, 77, 140).collect(), key=lambda r: r["slot"])
    assert part == rows[77:140]
    again = ordering.materialise(odd, PATH, length=16, per_shard=50, folder=str(tmp_path / "again"))
    assert sorted(ordering.read_slots(spark, again).collect(), key=lambda r: r["slot"]) == rows
    assert ordering.read_slots(spark, ordering.materialise(empty, PATH)).count() == 0
