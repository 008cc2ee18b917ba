"""Language identification by Bayesian fusion of evidence.

For every page the likelihood of its text under byte trigram models is combined with what its
markup declares, with the language mark in its address, and with a prior for its host. The priors
and the reliability of the marks are counted over all pages by grouped aggregation: a host's prior
is smoothed by its domain's, the domain's by that of all pages, and a page does not count for its
own prior. Only ids, marks and one likelihood per language are shuffled, not the pages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwise.functions.lineage import written
from tillwise.llm.hot import join_by_size
from tillwise.llm.words import MIX_A, raw_bytes, slices, small

# Parameters. The model is fitted on so many labelled texts of each language, taken by the hash of
# their id; text evidence counts a trigram as TEMPER of an independent one.
SAMPLE = 1000
FEATURES = 1 << 14
TEMPER = 0.1
HOST_WEIGHT, DOMAIN_WEIGHT, MARK_WEIGHT = 5.0, 20.0, 1.0

WORD = re.compile(r"\w")
ENDINGS = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
HTML = re.compile(r"(?i)<html\b")
LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]+)")


def declared_language(html: str) -> str | None:
    """The lang attribute of the first html tag that has one. A tag is looked through once."""
    start = HTML.search(html)
    while start:
        end = html.find(">", start.end())
        found = LANG.search(html, start.end(), end if end >= 0 else len(html))
        if found or end < 0:
            return found[1].lower() if found else None
        start = HTML.search(html, end)
    return None


def visible_text(html: str) -> str:
    """The page without scripts, styles, comments and tags, each a blank; one pass over it.

    What is never closed is text from its first character on; an end that does not follow one
    opening follows no later one either, so it is looked for once.
    """
    pieces: list[str] = []
    missing: set[str] = set()
    kept, at = 0, html.find("<")
    while at >= 0:
        end = -1
        for name, ending in ENDINGS.items():
            after = at + 1 + len(name)
            if name in missing or html[at + 1 : after].lower() != name or WORD.match(html, after):
                continue
            closed = ending.search(html, after)
            end = closed.end() if closed else -1
            if not closed:
                missing.add(name)
        if end < 0 and "comment" not in missing and html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
            if end < 3:
                missing.add("comment")
                end = -1
        if end < 0:
            end = html.find(">", at) + 1
            if not end:
                break
        pieces += (html[kept:at], " ")
        kept = end
        at = html.find("<", end)
    return "".join([*pieces, html[kept:]])


def trigram_slots(data: np.ndarray) -> np.ndarray:
    """A feature number for each three bytes in a row, ASCII letters lower-cased, other ASCII blank."""
    fold = np.arange(256, dtype=np.uint64)
    fold[:128] = 32
    fold[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    fold[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    x = fold[data]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    mixed = ((x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]) * np.uint64(MIX_A)
    return (mixed >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, slot, n) over (lang, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in small(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = totals.setdefault(lang, np.zeros(FEATURES, np.int64))
                held += np.bincount(trigram_slots(np.frombuffer((text or "").encode(), np.uint8)), minlength=FEATURES)
        for lang, held in totals.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(held[at])], names=["lang", "slot", "n"]
            )

    pieces = labelled.select("lang", "text").mapInArrow(counted, "lang string, slot bigint, n bigint")
    return pieces.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each feature under each of them.

    From at most ``sample`` rows of (doc_id, text, lang) per language, the least hashes of the id
    (ties by id and text; equal rows together), for all languages at once; only ids and hashes are
    shuffled. Rows without a language are not labelled.
    """
    known = docs.select("lang", "doc_id", "text").where("lang is not null")
    place = F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id", F.xxhash64("text").alias("of_text"))
    placed = known.select("lang", place.alias("place"))
    sizes = written(placed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    # The least hashes of a language lie under four times its share of them, by far.
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("n"))
    few = placed.join(F.broadcast(sizes), "lang").where(F.col("place.hash") <= share * 2.0**64 - 2.0**63)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("place")))
    limits = written(ranked.where(F.col("rank") <= sample).groupBy("lang").agg(F.max("place").alias("limit")))
    rows = trigram_counts(known.join(F.broadcast(limits), "lang").where(place <= F.col("limit"))).collect()
    langs = sorted(row["lang"] for row in sizes.collect())
    number = {lang: k for k, lang in enumerate(langs)}
    counts = np.full((max(1, len(langs)), FEATURES), 0.5)
    for row in rows:
        counts[number[row["lang"]], row["slot"]] += row["n"]
    return langs or ["und"], np.log(counts / counts.sum(axis=1, keepdims=True))


def text_scores(pages: DataFrame, model: np.ndarray, langs: Sequence[str]) -> DataFrame:
    """(page_id, url, declared, scores): one log likelihood per language from the visible text.

    ``declared`` is the primary part of the lang attribute of html, "other" if it is no known
    language, "none" without one. A null page has no text and declares none.
    """
    ids = pages.schema["page_id"]
    schema = StructType([ids, *StructType.fromDDL("url string, declared string, scores array<double>").fields])
    columns = np.ascontiguousarray(model.T)
    names = set(langs)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            marks: list[str] = []
            texts: list[str] = []
            for value in batch.column(2):
                html = value.as_py() or ""
                mark = declared_language(html) or "none"
                marks.append(mark if mark in names or mark == "none" else "other")
                texts.append(visible_text(html))
            scores: list[list[float]] = []
            for _, piece in slices(pa.array(texts, pa.string())):
                data, bounds = raw_bytes(piece)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    counts = np.bincount(trigram_slots(data[a:b]), minlength=FEATURES)
                    at = np.flatnonzero(counts)
                    scores.append((counts[at] @ columns[at]).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks, pa.string()), pa.array(scores, pa.list_(pa.float64()))],
                names=schema.names,
            )

    return pages.select("page_id", "url", "html").mapInArrow(scored, schema)


def address_mark(url: Column, langs: Sequence[str]) -> Column:
    """The language that the address names: a first path segment, a first host label or the last."""
    host = F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1))
    places = [
        F.lower(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|\z|[?#])", 1)),
        F.regexp_extract(host, r"^([a-z]{2})\.", 1),
        F.regexp_extract(host, r"\.([a-z]{2})\z", 1),
    ]
    known = [F.when(place.isin(list(langs)), place) for place in places]
    return F.coalesce(*known, F.lit("none"))


def normalised(logs: Column) -> Column:
    """An array of log weights as probabilities."""
    shares = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shares, lambda x: x / F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))


def summed(pages: DataFrame, key: str) -> DataFrame:
    """(key, sums, n): the text posteriors ``p`` of a key's pages, added up per language."""
    each = pages.select(key, F.posexplode("p").alias("k", "share")).groupBy(key, "k").agg(
        F.sum("share").alias("share"), F.count(F.lit(1)).alias("n")
    )
    sums = F.transform(F.array_sort(F.collect_list(F.struct("k", "share"))), lambda x: x["share"])
    return each.groupBy(key).agg(sums.alias("sums"), F.max("n").alias("n"))


def mark_likelihoods(pages: DataFrame, mark: str, langs: Sequence[str]) -> DataFrame:
    """(mark, logs): log P(mark | language) from the text posteriors of all pages.

    A mark is a language or one of two other words, so there are few.
    """
    seen = {row[mark]: row["sums"] for row in summed(pages, mark).collect()}
    totals = [sum(held[k] for held in seen.values()) for k in range(len(langs))]
    weight = MARK_WEIGHT * len(seen)
    logs = [
        (value, [math.log((held[k] + MARK_WEIGHT) / (totals[k] + weight)) for k in range(len(langs))])
        for value, held in sorted(seen.items())
    ]
    return pages.sparkSession.createDataFrame(logs, f"{mark} string, {mark}_logs array<double>")


def leading(shares: Column, langs: Sequence[str]) -> Column:
    """The language of the largest share; of equal ones the later name."""
    named = F.zip_with(shares, F.lit(list(langs)), lambda s, lang: F.struct(s.alias("share"), lang.alias("lang")))
    return F.array_max(named)["lang"]


def fuse(scored: DataFrame, langs: Sequence[str]) -> DataFrame:
    """(page_id, host, declared, address, text_lang, lang, confidence) from ``text_scores``."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    marked = scored.withColumns({"host": host, "address": address_mark(url, langs)})
    domain = F.substring_index(F.regexp_replace("host", ":[0-9]*$", ""), ".", -2)
    tempered = marked.withColumn("text_logs", F.transform("scores", lambda x: x * TEMPER))
    pages = written(
        tempered.withColumns({"domain": domain, "p": normalised(F.col("text_logs"))}).drop("scores", "url")
    )
    marks = [mark_likelihoods(pages, mark, langs) for mark in ("declared", "address")]
    whole = summed(pages.withColumn("all", F.lit(0)), "all").first()
    totals, count = (whole["sums"], whole["n"]) if whole else ([0.0] * len(langs), 0)
    hosts = written(summed(pages, "host").withColumnsRenamed({"sums": "host_sums", "n": "host_n"}))
    domains = written(summed(pages, "domain").withColumnsRenamed({"sums": "domain_sums", "n": "domain_n"}))
    placed = written(join_by_size(pages, hosts, ["host"], F.col("host_n"), count))
    joined = join_by_size(placed, domains, ["domain"], F.col("domain_n"), count)
    for side, name in zip(marks, ("declared", "address"), strict=True):
        joined = joined.join(F.broadcast(side), name)

    def smoothed(total: Column, own: Column, rows: Column, wider: Column, weight: float) -> Column:
        return (total - own + weight * wider) / (rows - 1 + weight)

    each = F.arrays_zip("p", F.lit(totals).alias("totals"), "host_sums", "domain_sums", "text_logs", "declared_logs", "address_logs")

    def evidence(x: Column) -> Column:
        own = x["p"]
        every = (x["totals"] - own + 1) / F.lit(float(count - 1 + len(langs)))
        wide = smoothed(x["domain_sums"], own, F.col("domain_n"), every, DOMAIN_WEIGHT)
        near = smoothed(x["host_sums"], own, F.col("host_n"), wide, HOST_WEIGHT)
        return F.log(F.greatest(near, F.lit(1e-9))) + x["text_logs"] + x["declared_logs"] + x["address_logs"]

    weighed = joined.withColumn("logs", F.transform(each, evidence)).withColumn("shares", normalised(F.col("logs")))
    return weighed.select(
        "page_id",
        "host",
        "declared",
        "address",
        leading(F.col("p"), langs).alias("text_lang"),
        leading(F.col("shares"), langs).alias("lang"),
        F.array_max("shares").alias("confidence"),
    )


def identify(pages: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The language of every row of (page_id, url, html), from models of (doc_id, text, lang).

    Columns: page_id, host, declared, address, text_lang (text alone), lang (all evidence) and
    confidence. Null and empty pages are judged by the rest of the evidence; a null address has
    host "" and no mark; repeated rows are judged alike; an empty table gives an empty one. Of
    equally likely languages the later name is taken. Pages are read whole, one at a time, in time
    in proportion to their length. Other columns are not read, so their names may clash. There may
    be any number of languages that a list can hold; without any labelled text it is "und".
    """
    langs, model = fit(labelled, sample)
    return fuse(text_scores(pages, model, langs), langs)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(pages, docs)


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
