"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.lineage import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the least node it reaches.

    Every round hangs neighbours under the least node they know, so a chain shrinks to its
    square root or less per round and a star is done at once. Nodes without a link are not
    returned; an empty table of links gives an empty table.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    )
    before = None
    while True:
        both = edges.select(a.alias("u"), b.alias("v")).union(edges.select(b.alias("u"), a.alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        )
        under = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(under, "b").select(F.col("m").alias("a"), a.alias("b")).where("a < b")
        edges = written(small.union(under.select(F.col("m").alias("a"), "b")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(a.alias("node"), a.alias("label")).distinct()
    return edges.select(b.alias("node"), a.alias("label")).union(roots)
