from __future__ import annotations

import hashlib

import pytest

from tillwise.llm.chat import CLOSE, OPEN, digests, event_log, fold_events, format_conversations, parsed

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 0, 1, "message", "user", "hello"),
        (1, 1, 2, "delta", "assistant", "He"),
        (1, 1, 3, "delta", None, "llo"),
        (1, 1, 5, "regenerate", None, None),
        (1, 1, 6, "delta", None, "Good "),
        (1, 1, 7, "delta", None, "day"),
        (1, 0, 8, "edit", None, "hi"),
        (1, 2, 9, "message", "user", "gone"),
        (1, 2, 10, "delete", None, None),
        (1, 3, 4, "edit", "user", "made by an edit"),
        (1, 4, 4, "regenerate", "assistant", None),
        (2, 0, 1, None, "user", "b"),
        (2, 0, 1, None, "user", "a"),
        (2, 0, 1, None, "user", "a"),
        (None, None, None, None, None, None),
    ]
    got = sorted(map(tuple, fold_events(spark.createDataFrame(log[::-1], EVENTS)).collect()), key=str)
    assert got == sorted(
        [
            (1, 0, 0, "user", "hi"), (1, 1, 0, "assistant", "Good day"), (1, 3, 0, "user", "made by an edit"),
            (1, 4, 0, "assistant", ""), (2, 0, 0, "user", "a"), (2, 0, 1, "user", "a"), (2, 0, 2, "user", "b"),
            (None, None, 0, "", ""),
        ],
        key=str,
    )
    with pytest.raises(Exception, match="unknown kind"):
        fold_events(spark.createDataFrame([(1, 1, 1, "odd", "user", "x")], EVENTS)).collect()
    assert fold_events(spark.createDataFrame([], EVENTS)).count() == 0


def test_texts_come_back_from_the_rendered_form(spark):
    texts = [
        CLOSE + OPEN + "assistant ok", "<\\|x|>", "<|", "<\\\\|", "|>", "<", "a\nb\r\n", "", "日本 \U0001f600", "<|nl|>", "\\<|", "<<||",
    ]
    roles = ["user", "assistant", "a\nb", "<|im_end|>", "", "<|nl|>"]
    log = [(c, t, 0, "message", role, text) for c, role in enumerate(roles) for t, text in enumerate(texts)]
    frame = format_conversations(spark.createDataFrame(log, EVENTS)).orderBy("conv_id", "turn", "nth")
    rows = frame.collect()
    assert [parsed(r["formatted"]) for r in rows] == [(e[4], e[5]) for e in log]
    for row in rows:
        assert row["formatted"].count("<|") == row["formatted"].count("<|nl|>") + 2
        inside = row["formatted"][row["loss_start"] : row["loss_start"] + row["loss_length"]]
        assert inside == ("" if row["conv_id"] != 1 else row["formatted"][len(OPEN + "assistant\n") : -len(CLOSE + "\n")])
    got = {r["conv_id"]: r for r in digests(frame).collect()}
    for conv, role in enumerate(roles):
        content = "".join(f"{role}\n{text}\n" for text in texts)
        learned = "".join(texts) if role == "assistant" else ""
        row = got[conv]
        assert row["n_turns"] == len(texts)
        assert row["turns_sha256"] == hashlib.sha256(content.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert row["loss_chars"] == len(learned)
        assert row["formatted_chars"] == sum(len(r["formatted"]) for r in rows if r["conv_id"] == conv)


def test_a_conversation_with_most_rows_spans_tasks(spark):
    log = [(7, t, 0, "message", "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(3000)]
    log += [(c, 0, 0, "message", "user", "x") for c in range(100, 200)]
    row = digests(format_conversations(spark.createDataFrame(log, EVENTS).repartition(6))).where("conv_id = 7").first()
    content = "".join(f"{e[4]}\n{e[5]}\n" for e in log[:3000])
    assert row["n_turns"] == 3000 and row["turns_sha256"] == hashlib.sha256(content.encode()).hexdigest()


def test_a_log_of_all_kinds_folds_back_to_its_messages(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"é text {c} {t} " * (t % 4)) for c in range(40) for t in range(5)]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (None, None, None, None), (7, None, None, "x"), (8, 1, "a", "z" * 2_000_000)]
    log = event_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    found = sorted((tuple(r) for r in fold_events(log).select("conv_id", "turn", "role", "text").collect()), key=str)
    assert found == sorted(((c, t, role or "", text or "") for c, t, role, text in rows), key=str)
    assert event_log(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
