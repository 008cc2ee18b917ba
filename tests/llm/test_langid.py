from __future__ import annotations

import math
import os
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwise.llm.langid import (
    DOMAIN_WEIGHT,
    HOST_WEIGHT,
    MARK_WEIGHT,
    TEMPER,
    declared_language,
    fit,
    fuse,
    identify,
    text_scores,
    visible_text,
)

DATA = os.environ.get("TILLWISE_DATA", "/root/testdata/sf0.01")
PAGES = "page_id long, url string, html string, host long"


def test_held_out_accuracy_of_the_text_model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    langs, model = fit(docs, sample=40)
    held = docs.where("length(text) > 40")
    pages = held.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    scored = text_scores(pages, model, langs).join(held.withColumnRenamed("doc_id", "page_id"), "page_id")
    best = F.array(*map(F.lit, langs))[F.array_position("scores", F.array_max("scores")).cast("int") - 1]
    assert scored.select(F.avg((best == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_evidence_is_fused(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) > 800").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    page = lambda lang, mark: f"<html lang='{mark}'><script>the and of the</script><!-- the --><body>{texts[lang]}</body></html>"
    rows = [(k, f"https://h{k % 3}.example.com/{lang}/x{k}", page(lang, lang), 1) for k, lang in enumerate(list(texts) * 12)]
    rows += [(100 + k, f"https://de.only.example.org/{k}", page("de", "de"), 1) for k in range(20)]
    rows += [
        (200, "https://h1.example.com/fr/empty", "<html lang=fr></html>", 1),
        (201, "https://h1.example.com/es/", None, 1),
        (202, "https://de.only.example.org/new", "", 1),
        (203, None, page("fr", "xx"), 1),
        (204, None, None, None),
        (205, "https://h0.example.com/en/wrong", page("es", "en"), 1),
        (205, "https://h0.example.com/en/wrong", page("es", "en"), 1),
    ]
    pages = spark.createDataFrame(rows, PAGES).select("page_id", "url", "html", F.lit("x").alias("p0"), "host")
    found = identify(pages, docs, sample=60)
    assert found.count() == len(rows)
    got = {r["page_id"]: r for r in found.collect()}
    assert all(got[k]["lang"] == lang == got[k]["text_lang"] for k, lang in enumerate(list(texts) * 12))
    assert got[200]["lang"] == "fr" and got[201]["lang"] == "es" and got[202]["lang"] == "de"
    assert got[203]["lang"] == "fr" and got[203]["declared"] == "other" and got[203]["host"] == ""
    assert got[204]["declared"] == "none" and got[204]["lang"] in texts
    assert got[205]["lang"] == "es"  # a long text outweighs marks
    assert identify(pages.limit(0), docs, sample=5).count() == 0
    assert {r["lang"] for r in identify(pages, docs.limit(0)).collect()} == {"und"}


# The page expressions that the scan must equal, as they read; they take quadratic time.
TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)")
PIECES = ["<", ">", "script", "style", "</", "/", "!--", "-->", "--", " ", "html", "lang", "=", "'", "en", "x", "SCRIPT ", "é", "\n", "_"]


@given(st.lists(st.sampled_from(PIECES), max_size=40))
@settings(max_examples=1500, deadline=None)
def test_one_pass_reads_what_the_expressions_read(pieces):
    html = "".join(pieces)
    assert visible_text(html) == TAGS.sub(" ", html)
    found = DECLARED.search(html)
    assert declared_language(html) == (found[1].lower() if found else None)


@pytest.mark.parametrize("piece", ["<", "<!--", "<script>", "<html ", "</script ", "<style", "<html lang", "<script></script", "lang= "])
def test_hostile_pages_take_time_in_proportion(piece):
    html = piece * (5_000_000 // len(piece))
    start = time.process_time()
    visible_text(html)
    declared_language(html)
    assert time.process_time() - start < 10


def by_hand(rows, langs):
    """Marks, counts, priors and posteriors in plain Python; rows are (page_id, url, declared, scores)."""
    weigh = lambda logs: [math.exp(x - max(logs)) / sum(math.exp(y - max(logs)) for y in logs) for x in logs]
    n, pages = range(len(langs)), []
    for page_id, url, declared, scores in rows:
        found = re.search("://([^/?#]*)", url or "")
        host = found[1].lower() if found else ""
        segment = re.search(r"://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|\Z|[?#])", url or "")
        label, last = re.match(r"([a-z]{2})\.", host), re.search(r"\.([a-z]{2})\Z", host.split(":")[0])
        places = [m[1].lower() for m in (segment, label, last) if m]
        address = next((p for p in places if p in langs), "none")
        domain = ".".join(re.sub(":[0-9]*$", "", host).split(".")[-2:])
        logs = [s * TEMPER for s in scores]
        pages.append({"id": page_id, "host": host, "domain": domain, "declared": declared, "address": address, "logs": logs, "p": weigh(logs)})

    def sums(key, value):
        mine = [p["p"] for p in pages if p[key] == value]
        return [sum(x[k] for x in mine) for k in n], len(mine)

    def mark_logs(key):
        held = {v: sums(key, v)[0] for v in {p[key] for p in pages}}
        totals = [sum(h[k] for h in held.values()) for k in n]
        return {v: [math.log((h[k] + MARK_WEIGHT) / (totals[k] + MARK_WEIGHT * len(held))) for k in n] for v, h in held.items()}

    declared, address = mark_logs("declared"), mark_logs("address")
    whole = [sum(p["p"][k] for p in pages) for k in n]
    out = []
    for p in pages:
        (host, host_n), (domain, domain_n) = sums("host", p["host"]), sums("domain", p["domain"])
        logs = []
        for k in n:
            own = p["p"][k]
            every = (whole[k] - own + 1) / (len(pages) - 1 + len(langs))
            wide = (domain[k] - own + DOMAIN_WEIGHT * every) / (domain_n - 1 + DOMAIN_WEIGHT)
            near = (host[k] - own + HOST_WEIGHT * wide) / (host_n - 1 + HOST_WEIGHT)
            logs.append(math.log(max(near, 1e-9)) + p["logs"][k] + declared[p["declared"]][k] + address[p["address"]][k])
        shares = weigh(logs)
        out.append((p["id"], p["host"], p["declared"], p["address"], max(zip(shares, langs, strict=True))[1], max(shares)))
    return out


def test_fusion_equals_brute_force(spark):
    draw, langs = random.Random(3), ["de", "en", "fr"]
    hosts = ["www.example.com", "de.example.com", "shop.example.fr", "a.b.example.org:8080", "one.net", "EN.example.net"]
    rows = []
    for k in range(400):
        url = f"https://{hosts[0] if k % 3 == 0 else draw.choice(hosts)}/{draw.choice(['', 'de/', 'fr-CA/x', 'en', 'zz/', 'page?en'])}"
        scores = [draw.uniform(-60, 0) for _ in langs]
        rows.append((k, url, draw.choice(["none", "other", *langs]), scores))
    rows += [(900, None, "none", [0.0, 0.0, 0.0]), (900, None, "none", [0.0, 0.0, 0.0]), (None, "", "none", [-1.0, -1.0, -1.0])]
    scored = spark.createDataFrame(rows, "page_id long, url string, declared string, scores array<double>")
    columns = ["page_id", "host", "declared", "address", "lang", "confidence"]
    found = sorted((tuple(r) for r in fuse(scored, langs).select(*columns).collect()), key=str)
    wanted = sorted(by_hand(rows, langs), key=str)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert all(abs(f[5] - w[5]) < 1e-9 for f, w in zip(found, wanted, strict=True))


def test_equal_posteriors_go_to_the_later_name_and_there_may_be_many_languages(spark):
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopq"]
    pages = spark.createDataFrame([(1, None, ""), (2, None, None)], "page_id long, url string, html string")
    labelled = spark.createDataFrame([(k, "same words for all", name) for k, name in enumerate(names)], "doc_id long, text string, lang string")
    rows = identify(pages, labelled).collect()
    assert {(r["lang"], r["text_lang"]) for r in rows} == {(max(names), max(names))}
    assert all(abs(r["confidence"] - 1 / len(names)) < 1e-9 for r in rows)


def test_a_long_page_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "der die das und ist nicht " * 40, "de"), (2, "the and of to in that " * 40, "en")], "doc_id long, text string, lang string")
    html = "<p>the and of that <!-- der die das -->" * 60_000
    pages = spark.createDataFrame([(1, "http://a.b/", html, 5)], "page_id long, url string, html string, p int")
    pages = pages.withColumns({n: F.lit("x") for n in ("host", "domain", "scores", "logs", "sums", "n", "k", "share")})
    row = identify(pages, docs.withColumns({"_place": F.lit(9), "slot": F.lit(1), "n": F.lit(1)})).first()
    assert row["lang"] == row["text_lang"] == "en"
