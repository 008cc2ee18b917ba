"""N-gram Jaccard join by prefixes under several global token orders.

Two sets are linked when their similarity reaches a threshold. The sets of a linked pair must
share a token among their first few under every global order of the tokens. The first order is
by rising frequency, so the prefixes hold rare tokens and their lists are short; the others are
the rising and the falling order of the token hashes. Only pairs that pass every order are
verified by their whole sets.

What keeps the work in proportion to the input:

- equal sets are one class, so copies never meet each other;
- a class with more tokens of its own than a linked pair can differ by is out at once. Most texts
  go this way, first by a fixed share of the hash space, the rest by all their tokens;
- the classes on a token's list are first compared with the list's class of the rarest-token
  count (its hub), not with each other. Only members that are in different components after
  that meet, and only where their positions leave room for enough common tokens. So nothing is
  capped and no link between different components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.components import components
from tillwise.functions.lineage import written
from tillwise.llm.texts import packed_texts, unpacked
from tillwise.llm.words import shingle_sets, small

# Parameter: the share of the hash space in the first filter, as a multiple of 1 - threshold.
SHARE = 1.4


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def needed(size: Column, percent: int) -> Column:
    """Tokens that any linked set has in common with a set of this size."""
    return F.floor((size * percent + 99) / 100)


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, short) per row of (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, digests = [], []
            for tokens in shingle_sets(batch.column(1), width):
                sizes.append(len(tokens))
                digests.append(digest_of(tokens))
            short = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(short)],
                names=["doc_id", "n_shingles", "digest", "short"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc_id {kind}, n_shingles bigint, digest binary, short bigint")


def sampled_tokens(docs: DataFrame, width: int, share: float) -> DataFrame:
    """(token, short) for the tokens in the lowest share of the hash space; copies in a batch once."""
    below = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            seen: set[bytes] = set()
            held, owners, count = [], [], 0
            for tokens in shingle_sets(batch.column(0), width):
                digest = digest_of(tokens)
                if digest in seen:
                    continue
                seen.add(digest)
                part = tokens[: np.searchsorted(tokens, below, "right")]
                held.append(part)
                owners.append(np.full(len(part), np.frombuffer(digest, np.int64, 1)[0]))
                count += len(part)
                if count > 200_000:
                    yield token_batch(held, owners)
                    held, owners, count = [], [], 0
            if count:
                yield token_batch(held, owners)

    return docs.select("text").mapInArrow(rows, "token bigint, short bigint")


def token_batch(held: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(owners))], names=["token", "short"]
    )


def token_sets(picked: DataFrame, width: int) -> DataFrame:
    """(digest, n, tokens) of the packed texts (text, digest) whose set has that digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            wanted = batch.column(1).to_pylist()
            digests, sets, count = [], [], 0
            for digest, tokens in zip(wanted, shingle_sets(unpacked(batch.column(0)), width), strict=True):
                if digest_of(tokens) != digest:
                    continue  # another row of the same doc_id
                digests.append(digest)
                sets.append(tokens.view(np.int64))
                count += len(tokens)
                if count > 500_000:
                    yield set_batch(digests, sets)
                    digests, sets, count = [], [], 0
            if digests:
                yield set_batch(digests, sets)

    return picked.select("text", "digest").mapInArrow(rows, "digest binary, n bigint, tokens array<bigint>")


def set_batch(digests: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets], np.int64)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(sets))
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(digests, pa.binary()), pa.array(sizes), lists], names=["digest", "n", "tokens"]
    )


def own_tokens(rows: DataFrame, owner: str) -> DataFrame:
    """(owner, own): how many tokens each owner has that no other has."""
    alone = rows.groupBy("token").agg(F.min(owner).alias("_a"), F.max(owner).alias("_b"))
    return alone.where("_a = _b").groupBy(F.col("_a").alias(owner)).agg(F.count(F.lit(1)).alias("own"))


def close_sets(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, digest, n, tokens) of the classes that may have a link, one row each."""
    may_differ = F.col("n_shingles") - needed(F.col("n_shingles"), percent)
    share = min(1.0, SHARE * (100 - percent) / 100)
    own = own_tokens(sampled_tokens(docs, width, share), "short")
    # Classes whose short digests are equal by chance are never ruled out.
    clashes = classes.groupBy("short").agg((F.count(F.lit(1)) > 1).alias("clash"))
    first = (
        classes.join(clashes, "short")
        .join(own, "short", "left")
        .where(F.col("clash") | (F.coalesce("own", F.lit(0)) <= may_differ))
        .select("doc_id", "digest")
    )
    sets = written(
        token_sets(packed_texts(docs, "text", "_tag").join(first, "doc_id"), width)
        .dropDuplicates(["digest"])
        .withColumn("node", F.monotonically_increasing_id())
    )
    own = own_tokens(sets.select(F.explode("tokens").alias("token"), "node"), "node")
    return written(
        sets.join(own, "node", "left")
        .where(F.coalesce("own", F.lit(0)) <= F.col("n") - needed(F.col("n"), percent))
        .drop("own")
    )


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, rare, low, high): the prefix of each set under the three orders."""
    tokens = sets.select(F.explode("tokens").alias("token"), "node")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = (
        tokens.join(counts, "token")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ordered"))
    )
    length = (F.col("n") - needed(F.col("n"), percent) + 1).cast("int")
    return sets.join(by_rarity, "node").select(
        "node",
        "n",
        F.slice("ordered", 1, length).alias("rare"),
        F.slice("tokens", 1, length).alias("low"),
        F.slice("tokens", F.col("n").cast("int") - length + 1, length).alias("high"),
    )


def fits(percent: int) -> Column:
    """Whether the entries (pos, n) and (pos2, n2) leave room for enough common tokens."""
    room = 1 + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    return (small * 100 >= large * percent) & (room * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)


def verified(pairs: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share tokens in their prefixes under the other orders and are similar."""
    side = lambda name: heads.select(
        F.col("node").alias(name), F.col("low").alias(f"low_{name}"), F.col("high").alias(f"high_{name}")
    )
    passed = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(F.arrays_overlap("low_a", "low_b") & F.arrays_overlap("high_a", "high_b"))
        .select("a", "b")
    )
    whole = lambda name: sets.select(F.col("node").alias(name), F.col("tokens").alias(f"tokens_{name}"))
    both = passed.join(whole("a"), "a").join(whole("b"), "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def linked_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, label): the components of the sets under all their links."""
    heads = written(prefixes(sets, percent))
    entries = written(
        heads.select("node", "n", F.posexplode("rare").alias("at", "entry"))
        .where("entry.df > 1")
        .select(F.col("entry.token").alias("token"), (F.col("at") + 1).alias("pos"), "node", "n")
    )
    hubs = entries.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("hub"))
    stars = (
        entries.join(hubs, "token")
        .select("*", F.col("hub.pos").alias("pos2"), F.col("hub.n").alias("n2"))
        .where((F.col("node") != F.col("hub.node")) & fits(percent))
        .select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    links = written(verified(stars, heads, sets, percent))
    labels = components(links)
    placed = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("token").agg(F.min("label").alias("_l"), F.max("label").alias("_h"))
    open_lists = placed.join(mixed.where("_l < _h").select("token"), "token")
    other = open_lists.select(
        "token", F.col("pos").alias("pos2"), F.col("node").alias("node2"), F.col("n").alias("n2"),
        F.col("label").alias("label2"),
    )
    across = (
        open_lists.join(other, "token")
        .where((F.col("label") < F.col("label2")) & fits(percent))
        .select(F.col("node").alias("a"), F.col("node2").alias("b"))
        .distinct()
    )
    more = written(verified(across, heads, sets, percent))
    return components(links.union(more)) if more.take(1) else labels


def jaccard_components(
    docs: DataFrame, width: int = 4, percent: int = 85, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Texts are linked when 100 * |common| >= ``percent`` * |union| of their sets of ``width``-word
    windows, A-Z lower-cased; a shorter text is one window. Null, empty and blank texts have no
    window and no link. Rows with a null id are returned with a null component and link nothing;
    rows that share an id are separate texts. ``component_id`` is the least id reachable by links.
    Texts of any length are read whole; a task holds the set of one long text at a time.
    """
    source = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = written(set_rows(source, width))
    classes = written(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest", "short", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    sets = close_sets(source, classes, width, percent)
    labels = linked_classes(sets, percent).join(sets.select("node", "digest"), "node")
    grouped = labels.join(classes.select("digest", "doc_id"), "digest")
    least = grouped.groupBy("label").agg(F.min("doc_id").alias("least"))
    linked = grouped.join(least, "label").select("digest", "least")
    of_class = classes.join(linked, "digest", "left").select(
        "digest", F.coalesce("least", "doc_id").alias("class_component")
    )
    return rows.join(of_class, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id"),
    )


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five words, 0.8) the least id stays.

    Of rows that repeat an id and a text one stays; rows that share an id only are judged alike;
    rows with a null id stay.
    """
    found = jaccard_components(docs, width=5, percent=80)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(*docs.columns).union(docs.where("doc_id is null"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs)


SQL = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lowered),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.m AS component_id
FROM sets s JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) r ON r.a = s.doc_id
"""

QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
ORACLES = {"op10_ngram_jaccard_join": SQL}
