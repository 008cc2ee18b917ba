from __future__ import annotations

import pytest

from tillwise.llm.urls import HostRule, Pattern, compiled, filter_urls, rules_by_token

URLS = [
    "http://a.net/x", "http://net/", "http://xnet/", "http://net", "HTTP://A.NET/en/", "https://example.net/en/1?x#y",
    "https://www.example.net/en", "https://example.net/EN/1", "http://example.com/de/", "http://x.example.com/de/?",
    "http://notexample.com/de/", "http://b.org/fr/z", "http://b.org/fr", "no scheme", "", None, "a://b://c.net/d",
    "http://user@net/", "http://h.net:80/", "http://.net/", "http://x.test/casino/1", "http://x.test/casinos/1",
    "http://x.test/wp-login.php", "http://x.test/?sessionid=3", "http://x.net/casino/", "://", "http://x.xxx",
    "http://x.test/a\nb", "http://x.test/" + "a/" * 3000 + "torrent/",
]
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def brute(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_host_rules_match_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    blocked = {"http://x.test/casino/1", "http://x.test/casinos/1", "http://x.test/wp-login.php", "http://x.test/?sessionid=3", "http://x.xxx", URLS[-1]}
    for row in filter_urls(pages).collect():
        host, path, rule, verdict = brute(row["url"])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule), row["url"]
        assert row["verdict"] == (verdict or ("block" if row["url"] in blocked else "allow")), row["url"]


def test_many_rules_are_filed_by_rare_tokens(spark):
    hosts = [HostRule("block" if k % 2 else "allow", f"h{k}.example", f"/p{k % 7}/") for k in range(300)]
    rules = compiled(hosts, [Pattern(("p1", "zz"), "/p1/zz")])
    filed = rules_by_token(rules, {"example": 10_000, "p1": 50, **{f"p{k}": 60 for k in range(7)}})
    assert "example" not in filed and max(map(len, filed.values())) == 1
    urls = [f"http://{sub}h{k}.example/p{p}/q" for k in range(0, 300, 13) for p in range(7) for sub in ("", "www.", "x")]
    pages = spark.createDataFrame([(u, "kept") for u in urls], "url string, rank string")
    for row in filter_urls(pages, hosts, ()).collect():
        host, path = row["url"][7:].split("/", 1)
        fit = [r for r in hosts if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        assert row["verdict"] == (fit[0].verdict if fit else "allow") and row["rank"] == "kept"
    with pytest.raises(ValueError, match="literal token"):
        compiled([], [Pattern((), ".")])


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, host string, rule long")
    out = filter_urls(pages)
    assert out.count() == 0 and out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert filter_urls(pages, (), ()).count() == 0


@pytest.mark.parametrize(
    ("url", "is_blocked"),
    [
        ("http://h.com/casino", True), ("/casino?x=1", True), ("http://h.com/a/POKER#a", True), ("http://h.com/mycasino/", False),
        ("http://h.com/casinoroyale", False), ("http://casino.h.com", True), ("http://h.com/free-bets-today", True),
        ("http://h.com/free/bets", True), ("http://h.com/bets/free", False), ("http://h.com/?q=cheap+pills", True),
        ("http://h.com/cheap/red/pills", False), ("http://h.com/wp-login.php", True), ("http://h.com/wp-login.phps", False),
    ],
)
def test_patterns_see_whole_words_wherever_they_end(spark, url, is_blocked):
    row = filter_urls(spark.createDataFrame([(url,)], "url string"), ()).first()
    assert row["verdict"] == ("block" if is_blocked else "allow")


def test_a_long_rule_list_is_a_table_with_the_same_verdicts(spark, monkeypatch):
    from tillwise.llm import urls as module

    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS * 3)], "page_id long, url string, _judged_url string, _best string")
    planned = {(r["page_id"], *r) for r in filter_urls(pages).collect()}
    hosts = [*module.HOST_RULES, *(HostRule("block", f"h{k}.example.invalid") for k in range(30_000))]
    pages = pages.unionByName(spark.createDataFrame([(900, "https://www.h29999.example.invalid/a", "x", "y")], pages.schema))
    rows = {(r["page_id"], *r) for r in filter_urls(pages, hosts).collect()}
    assert {r for r in rows if r[0] != 900} == planned
    assert next(r for r in rows if r[0] == 900)[-2:] == ("h29999.example.invalid/", "block")
    monkeypatch.setattr(module, "PLAN_RULES", 0)
    assert {(r["page_id"], *r) for r in filter_urls(pages.where("page_id < 900")).collect()} == planned
