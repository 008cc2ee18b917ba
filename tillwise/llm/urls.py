"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any URL it matches must contain. A
rule is filed under its rarest token, counted over the URLs at hand; a URL fetches the rules
filed under its own tokens and only those run. Everything is a DataFrame expression: one pass
counts the rules' tokens, one judges the URLs without a shuffle. A rule list of hundreds of
thousands is a table instead: the tokens of each distinct URL are joined with the rules' tokens.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm.quality import free_prefix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules travel inside the plan at most; more of them are a table that URL tokens are joined with.
PLAN_RULES = 2_000


class HostRule(NamedTuple):
    """Verdict for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"


class Pattern(NamedTuple):
    """A block rule: whole tokens that a URL must contain, and the expression that decides."""

    tokens: tuple[str, ...]
    regex: str


# The rules of the registered query.
HOST_RULES = (
    HostRule("block", "net"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
# Parameter: what is blocked where no host rule fits. The expressions see the URL with A-Z lower-cased.
# Words of general block lists (gambling, betting, pills, adult, piracy), whole words of a URL.
WORDS = """
casino casinos poker roulette blackjack jackpot baccarat sportsbook sportsbooks bookmaker bookmakers
viagra cialis levitra kamagra tramadol xanax
porn porno pornos hentai camgirls escorts milf milfs
torrent torrents warez keygen keygens
""".split()
#: Two words next to each other, with any separators between them.
PHRASES = (
    ("free", "bet"), ("free", "bets"), ("bonus", "bets"), ("sports", "betting"), ("online", "slots"), ("free", "spins"),
    ("cheap", "pills"), ("diet", "pills"), ("buy", "pills"), ("cheap", "meds"), ("payday", "loans"), ("replica", "watches"),
)
EDGE, LAST = r"(^|[^a-z0-9])", r"([^a-z0-9]|\z)"
PATTERNS = (
    *(Pattern((word,), EDGE + word + LAST) for word in WORDS),
    *(Pattern(pair, EDGE + "[^a-z0-9]+".join(pair) + LAST) for pair in PHRASES),
    Pattern(("xxx",), r"://([^/?#]*\.)?xxx([.:/?#]|\z)"),
    Pattern(("wp", "login", "php"), r"/wp-login\.php([?#]|\z)"),
    Pattern(("cgi", "bin"), r"/cgi-bin(/|\z)"),
    Pattern(("sessionid",), r"[?&;]sessionid="),
    Pattern(("phpsessid",), r"[?&;]phpsessid="),
    Pattern(("jsessionid",), r"[?&;]jsessionid="),
    Pattern(("adclick",), EDGE + "adclick" + LAST),
    Pattern(("doubleclick", "net"), r"://([^/?#]*\.)?doubleclick\.net([:/?#]|\z)"),
)
TOKEN = "[^a-z0-9]+"


class Rule(NamedTuple):
    tokens: tuple[str, ...]
    regex: str
    subject: str  # "place": host and path; "url": the URL with A-Z lower-cased
    rank: int  # the length of a host rule; 0 for a pattern
    name: str
    verdict: str


def tokens_of(text: str) -> list[str]:
    return [token for token in re.split(TOKEN, text.translate(str.maketrans(UPPER, LOWER))) if token]


def literal(text: str) -> str:
    """The text as an expression that matches it alone (in Java and RE2 syntax)."""
    return "".join(c if c.isalnum() or c in "/_" else f"\\x{{{ord(c):x}}}" for c in text)


def compiled(host_rules: Sequence[HostRule], patterns: Sequence[Pattern]) -> list[Rule]:
    """All rules with their literal tokens.

    The last token of a path prefix may go on in the URL, so it is no literal token unless a
    separator follows. A rule without any literal token is refused.
    """
    rules = []
    for rule in host_rules:
        host = rule.host.translate(str.maketrans(UPPER, LOWER))
        whole = re.sub("[A-Za-z0-9]+$", "", rule.path)
        tokens = tokens_of(host) + tokens_of(whole)
        regex = rf"^([^/]*\.)?{literal(host)}{literal(rule.path)}" if rule.path else rf"^([^/]*\.)?{literal(host)}(/|\z)"
        name = host + rule.path
        rules.append(Rule(tuple(tokens), regex, "place", len(name), name, rule.verdict))
    for pattern in patterns:
        rules.append(Rule(pattern.tokens, pattern.regex, "url", 0, "", "block"))
    if bare := [rule for rule in rules if not rule.tokens]:
        raise ValueError(f"rules without a literal token: {bare}")
    return rules


def lowered(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def parts_of(address: Column) -> dict[str, Column]:
    return {
        "host": lowered(F.regexp_extract(address, "://([^/?#]*)", 1)),
        "path": F.regexp_extract(address, "://[^/?#]*([^?#]*)", 1),
    }


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lowered(F.coalesce(url, F.lit(""))), TOKEN))


def token_counts(urls: DataFrame, url: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs each of the given tokens occurs (one row per token comes to the driver)."""
    found = F.array_intersect(url_tokens(F.col(url)), F.array(*[F.lit(t) for t in tokens]))
    rows = urls.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {row["token"]: row["count"] for row in rows}


def rules_by_token(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Every rule under the one of its tokens that the fewest URLs have."""
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(sorted(rule.tokens), key=lambda token: counts.get(token, 0))
        filed.setdefault(rarest, []).append(rule)
    return filed


def fetched_rules(tokens: Column, filed: dict[str, list[Rule]]) -> Column:
    """The rules filed under any of the URL's tokens, from a constant hash table of small maps."""
    row = lambda r: F.struct(
        F.lit(r.regex).alias("regex"), F.lit(r.subject == "place").alias("place"),
        F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"),
    )
    size = max(1, len(filed) // 4)
    buckets: list[list[str]] = [[] for _ in range(size)]
    for token in sorted(filed):
        buckets[zlib.crc32(token.encode()) % size].append(token)
    held = {token: F.array(*map(row, rules)) for token, rules in filed.items()}
    none = F.create_map(F.lit(" "), next(iter(held.values())))  # no token holds a blank
    table = F.array(
        *[F.create_map(*[x for t in bucket for x in (F.lit(t), held[t])]) if bucket else none for bucket in buckets]
    )
    found = F.transform(tokens, lambda t: F.get(table, (F.crc32(t) % size).cast("int"))[t])
    return F.flatten(F.filter(found, lambda rules: rules.isNotNull()))


def best_match(matching: DataFrame) -> DataFrame:
    """(_url, _best): the match that decides, of (_url, rank, verdict, name)."""
    return matching.groupBy("_url").agg(F.max(F.struct("rank", "verdict", "name")).alias("_best"))


def judged_by_table(urls: DataFrame, place: Column, rules: Sequence[Rule]) -> DataFrame:
    """(_url, _best) of the distinct URLs (_url) that any rule matches; ``place`` is host and path of a URL."""
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(k, r.regex, r.subject == "place", r.rank, r.name, r.verdict) for k, r in enumerate(rules)],
        "number int, regex string, is_place boolean, rank int, name string, verdict string",
    )
    tokens = spark.createDataFrame([(k, t) for k, r in enumerate(rules) for t in set(r.tokens)], "number int, token string")
    exploded = urls.select("_url", F.explode(url_tokens(F.col("_url"))).alias("token"))
    met = exploded.join(tokens.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = F.struct(F.coalesce("count", F.lit(0)), "token")
    filed = tokens.join(met, "token", "left").groupBy("number").agg(F.min_by("token", rarest).alias("token"))
    fetched = exploded.join(filed.join(table, "number"), "token")
    subject = F.when(F.col("is_place"), place).otherwise(lowered(F.col("_url")))
    return best_match(fetched.where(F.rlike(subject, F.col("regex"))))


def filter_urls(
    pages: DataFrame,
    host_rules: Sequence[HostRule] = HOST_RULES,
    patterns: Sequence[Pattern] = PATTERNS,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Add host, path, rule and verdict to every row (columns of these names are replaced).

    The longest host rule that fits decides, at equal length "block" before "allow"; else any
    pattern that matches blocks; else the default holds. A null URL, and one without "://", has
    empty host and path; patterns are run on what there is. Repeated rows are judged alike. URLs of
    any length are judged whole. Any number of rules is taken; a long list is joined, not planned.
    """
    rules = compiled(host_rules, patterns)
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    parts, own = parts_of(address), free_prefix(pages.columns, "_judged_")
    base = pages.select(*[f"`{c}`" for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    if not rules:
        return base.withColumns(parts | {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    if len(rules) > PLAN_RULES:
        urls = pages.select(address.alias("_url")).distinct()
        found = judged_by_table(urls, F.concat(*parts_of(F.col("_url")).values()), rules)
        found = found.withColumnsRenamed({"_url": own + "url", "_best": own + "best"})
        judged = base.withColumns(parts | {own + "url": address}).join(found, own + "url", "left").drop(own + "url")
    else:
        tokens = sorted({token for rule in rules for token in rule.tokens})
        counts = token_counts(pages, url, tokens)
        fetched = fetched_rules(url_tokens(address), rules_by_token(rules, counts))
        place, whole = F.concat(*parts.values()), lowered(address)
        matching = F.filter(fetched, lambda r: F.rlike(F.when(r["place"], place).otherwise(whole), r["regex"]))
        best = F.array_max(
            F.transform(
                matching,
                lambda r: F.struct(r["rank"].alias("rank"), r["verdict"].alias("verdict"), r["name"].alias("name")),
            )
        )
        judged = base.withColumns(parts | {own + "best": best})
    return judged.select(
        "*",
        F.when(F.col(own + "best.rank") > 0, F.col(own + "best.name")).alias("rule"),
        F.coalesce(own + "best.verdict", F.lit(default)).alias("verdict"),
    ).drop(own + "best")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).drop("url")


def sql_rules() -> str:
    """The same verdicts in SQL, every rule tried on every URL."""
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
        f"THEN '{r.verdict} {r.host}{r.path}'"
        for r in sorted(HOST_RULES, key=lambda r: -len(r.host + r.path))
    )
    blocked = " OR ".join(f"regexp_matches(lowered, '{p.regex}')" for p in PATTERNS)
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS lowered,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, CASE {fits} END AS hit FROM parts)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1) WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


QUERIES = {"op9_url_filters": op9_url_filters}
ORACLES = {"op9_url_filters": sql_rules()}
