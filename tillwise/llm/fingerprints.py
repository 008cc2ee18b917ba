"""Document fingerprints: one-permutation MinHash in DataFrame expressions only.

The hashes of a text's word shingles fall into bins by their high bits; every bin keeps its least
hash. An empty bin borrows from a full one: for each empty bin the full bins stand in a random
order of its own, the same for all texts, and the first lends (optimal densification: lenders are
equally likely and independent between bins). Of each bin the low bits are kept, packed into
longs. Two fingerprints agree by chance in one bin of ``2 ** BITS``, which the likeness corrects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.lineage import written
from tillwise.functions.ranking import row_positions

# Parameters: words of a shingle, bins (a power of two), bits kept of each, longs of the fingerprint.
WIDTH = 5
BINS, BIN_BITS = 128, 7
BITS = 4
LONGS = BINS * BITS // 64
LOW = 63 - BIN_BITS  # a hash has 63 bits: the bin, then the value
VALUE = (1 << LOW) - 1
ONES = sum(1 << (BITS * k) for k in range(64 // BITS))  # the lowest bit of each field of a long


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bin_of(value: Column) -> Column:
    return F.shiftrightunsigned(value, LOW)


def shingle_hashes(text: Column) -> Column:
    """63-bit hashes of the five-word windows; a shorter text is one window, also one of no words."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    hashed = F.transform(words, lambda word: F.xxhash64(word))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WIDTH)
        each = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(*[w[i + k] for k in range(WIDTH)]), 1))
        return F.when(F.size(w) >= WIDTH, each).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(w), 1)))

    return let(hashed, windows)


def least_by_bin(hashes: Column) -> Column:
    """The least hash of each bin that has any, in the order of the bins."""
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(s[F.greatest(i - 1, F.lit(0))])))
    return let(F.sort_array(hashes), first)


def densified(least: Column) -> Column:
    """One value for every bin: its own least hash, else one lent."""

    def filled(full: Column) -> Column:
        empty = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")), F.transform(full, bin_of))
        lent = lambda j: F.array_min(
            F.transform(full, lambda x: F.struct(F.xxhash64(j, bin_of(x)).alias("turn"), x.alias("value")))
        )["value"]
        borrowed = F.transform(empty, lambda j: F.shiftleft(j, LOW).bitwiseOR(lent(j).bitwiseAND(F.lit(VALUE))))
        return F.sort_array(F.concat(full, borrowed))

    return let(least, filled)


def packed(text: Column) -> Column:
    """The fingerprint of a text (never null) as longs, low bits of the first bin first in line."""
    fields = 64 // BITS

    def pack(dense: Column) -> Column:
        join = lambda held, x: F.shiftleft(held, BITS).bitwiseOR(x.bitwiseAND(F.lit(2**BITS - 1)))
        return F.transform(
            F.sequence(F.lit(0), F.lit(LONGS - 1)),
            lambda g: F.aggregate(F.slice(dense, g * fields + 1, fields), F.lit(0).cast("bigint"), join),
        )

    return let(densified(least_by_bin(shingle_hashes(text))), pack)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for k in (1, 2):  # any of the four bits into the lowest
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(F.lit(ONES)))

    differ = F.aggregate(F.zip_with(one, other, differing), F.lit(0), lambda held, x: held + x)
    chance = 2.0**-BITS
    share = 1 - differ / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every text as hex digits (null: that of the empty text); no shuffle.

    Equal texts have equal fingerprints, and so have all texts without words. A column of that
    name is replaced. A long text is read whole: its window hashes are one array of the task.
    """
    return docs.withColumn(name, as_text(packed(F.coalesce(F.col(f"`{text}`"), F.lit("")))))


def successors(docs: DataFrame) -> DataFrame:
    """(next_id, doc_id, need): every id, the one before it in rising order (null first; the last
    comes before the first), and a quarter of the longest text of the one before."""
    quarter = F.floor(F.max(F.char_length("text")) / 4).cast("int")
    ids = written(docs.groupBy("doc_id").agg(quarter.alias("need")))
    placed = written(row_positions(ids, [F.col("doc_id")]))
    before = placed.withColumn("Position", F.col("Position") % F.lit(max(1, placed.count())) + 1)
    after = placed.select(F.col("doc_id").alias("next_id"), "Position")
    return written(before.join(after, "Position").select("next_id", "doc_id", "need"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Compare every text of (doc_id, text) with an edited copy and with the next document.

    The edited copy has the last quarter of its code points replaced by the first as many of the
    next document, by rising id; null ids come first, after the last comes the first. Where rows
    share an id the one of the least text hash stands for it. Null text is empty. One row per row.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = successors(base).select("next_id", F.col("doc_id").alias("before_id"), "need")
    base = base.withColumn("own", packed(F.col("text")))
    same_id = F.col("doc_id").eqNullSafe(F.col("next_id"))
    lent = base.join(order, same_id).select(
        "before_id", F.xxhash64("text").alias("_hash"), F.struct(F.expr("substring(text, 1, need)").alias("head"), "own").alias("next")
    )
    lent = lent.groupBy("before_id").agg(F.min_by("next", "_hash").alias("next"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    joined = base.join(lent, F.col("doc_id").eqNullSafe(F.col("before_id"))).withColumns(
        {"n_chars": F.char_length("text").cast("bigint"), "_quarter": quarter}
    )
    edited = joined.withColumn(
        "edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - _quarter), substring(next.head, 1, _quarter))")
    ).withColumn("changed", packed(F.col("edited")))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next.own")).alias("near_next"),
    )


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op7_document_fingerprints": op7_document_fingerprints}
ORACLES: dict[str, str] = {}
