"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order. A document's virtual finish time is
the words its source has sent up to and including it, divided by the source's target. All queues
are merged by that time with a global range sort, and the merged order is cut at the total budget.
Repeats are further passes over the queue. Only ids, sources and sizes are sorted, not texts, and
running totals are taken per range partition, so a source with most of the rows is spread over all
tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.lineage import written
from tillwise.functions.ranking import running_totals

WORD = r"[^\x20\x09-\x0D]+"
# Parameters: weights of the sources in their order, the budget as a share of all words, and how
# often a document may be taken.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES
) -> DataFrame:
    """(source, rank, source_size, target) for every source of (source, size).

    Sources stand by code point, null last, and take the weights in turn. The targets share
    ``share`` times all sizes by weight; a target stops at ``passes`` times its source's size and
    the excess goes to the others by weight. The level of the water is the largest over all k of
    what is left by the k sources that fill first, divided by the weight of the others.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running_totals(totals, order, {"rank": F.lit(1).cast("bigint")})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    known = written(ranked.withColumn("weight", weight.cast("bigint")))
    most = F.col("source_size") * passes
    filling = running_totals(
        known.withColumn("_full", most / F.col("weight")),
        [F.col("_full"), F.col("rank")],
        {"_taken": most, "_weight": F.col("weight")},
    )
    size, every = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = F.lit(float(size) * share) - (F.col("_taken") - most)
    level = filling.agg(F.max(left / (F.lit(every) - (F.col("_weight") - F.col("weight"))))).first()[0] or 0.0
    target = F.least(most.cast("double"), F.lit(float(level)) * F.col("weight"))
    return known.select("source", "rank", "source_size", target.alias("target"))


def weighted_mix(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = SEED
) -> DataFrame:
    """(doc_id, source, size, source_size, target, times) for every row of (doc_id, source, size).

    ``times`` is how often the mix takes the row whole, from 0 to ``passes``. The order inside a
    source is that of the md5 of seed and id, so reruns agree; rows that repeat an id follow each
    other. A null source is a source of its own, a null size is 0 and a null id a key like any
    other. An empty table gives an empty mix.
    """
    rows = written(sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")))
    targets = written(source_targets(rows, weights, share, passes))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    queued = running_totals(
        placed.drop("_source").withColumn("_key", key),
        [F.col("_key"), F.col("doc_id"), F.col("size")],
        {"sent": F.col("size"), "place": F.lit(1).cast("bigint")},
        by=["rank"],
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "rank", "place"]
    copies = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    finish = (F.col("turn") * F.col("source_size") + F.col("sent")) / F.col("target")
    timed = written(copies.withColumn("finish", F.when(F.col("target") > 0, finish)).where("finish is not null"))
    merged = running_totals(
        timed.select(*columns, "turn", "finish"),
        [F.col("finish"), F.col("rank"), F.col("turn"), F.col("place")],
        {"_upto": F.col("size")},
    )
    budget = float(targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * min(share, passes)
    taken = merged.withColumn("_in", (F.col("_upto") <= F.lit(budget)).cast("int"))
    mixed = taken.groupBy(*columns).agg(F.sum("_in").cast("int").alias("times"))
    idle = queued.where("not target > 0").select(*columns, F.lit(0).alias("times"))
    return mixed.union(idle).drop("rank", "place")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as many times as the mix takes it; the columns stay.

    Rows that share id, source and size are told apart by the order of their texts, in one task.
    Texts of any length are taken whole.
    """
    same = W.partitionBy("doc_id", "source", "size")
    times = weighted_mix(sizes(docs)).where("times > 0").select("doc_id", "source", "size", "times")
    times = times.withColumn("_nth", F.row_number().over(same.orderBy(F.desc("times"))))
    names = {name: f"_{name}_of_mix" for name in ("doc_id", "source", "size", "times")}
    times = times.withColumnsRenamed(names)
    sized = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc")).select(
        "_doc", "_doc.doc_id", "_doc.source", words_in(F.col("_doc.text")).alias("size")
    )
    numbered = sized.withColumn("_nth", F.row_number().over(same.orderBy("_doc.text")))
    on = [F.col(name).eqNullSafe(F.col(names[name])) for name in ("doc_id", "source", "size")]
    chosen = numbered.join(times.withColumnRenamed("_nth", "_nth_of_mix"), [*on, F.col("_nth") == F.col("_nth_of_mix")])
    copies = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(names["times"]))))
    return copies.select("_doc.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mix = weighted_mix(sizes(docs))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
known AS (SELECT *, ([5, 2, 1])[1 + (rank - 1) % 3]::BIGINT AS weight FROM ranked),
filling AS (
  SELECT *, (sum(2 * source_size) OVER o - 2 * source_size)::DOUBLE AS taken, sum(weight) OVER o - weight AS filled
  FROM known WINDOW o AS (ORDER BY 2 * source_size / weight, rank ROWS UNBOUNDED PRECEDING)),
total AS (SELECT sum(source_size)::DOUBLE AS size, sum(weight) AS weights FROM known),
level AS (SELECT max((size * 1.5::DOUBLE - taken) / (weights - filled)::DOUBLE) AS level FROM filling, total),
targets AS (
  SELECT source, rank, source_size, least(2 * source_size::DOUBLE, level * weight::DOUBLE) AS target FROM known, level),
queued AS (
  SELECT s.*, t.rank, t.source_size, t.target,
    sum(size) OVER (PARTITION BY t.rank ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent,
    row_number() OVER (PARTITION BY t.rank ORDER BY key, doc_id, size) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (turn * source_size + sent)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest([0, 1]) AS turn) WHERE target > 0),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, turn, place ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
mixed AS (
  SELECT rank, place, sum(CASE WHEN upto <= (SELECT size FROM total) * 1.5::DOUBLE THEN size ELSE 0 END) AS taken
  FROM merged GROUP BY 1, 2)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(m.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN mixed m ON q.rank = m.rank AND q.place = m.place
"""

QUERIES = {"op8_source_mixing": op8_source_mixing}
ORACLES = {"op8_source_mixing": SQL}
