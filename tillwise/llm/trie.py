"""The prefix trie of conversations: ROLLUP over positional columns of turn ids.

A conversation is cut into blocks of ``BLOCK`` turns, one row each: the node that its earlier
blocks end at (two 64-bit hashes, folded over all turns before), then the turn ids in columns.
One ROLLUP over these columns, within the node before, aggregates the prefixes of all lengths
together, in all blocks of all conversations; grouping_id tells their depth. So the number of
jobs does not depend on the longest conversation.

Sums over subtrees need only nodes with two members or more. Blocks hang under the node their
earlier block ends at; their sums are gathered by pointer doubling (as many rounds as the
logarithm of the largest number of shared blocks) and a second ROLLUP spreads them over the
nodes within each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwise.functions.lineage import written

# Parameters.
BLOCK = 8  # turn-id columns of a ROLLUP
HOT_SHARE = 1000  # parents of more than a thousandth of all nodes are broadcast: fewer than 1,000
CHUNK = 50_000  # ids joined before they move on to a digest

TURNS = [f"t{k}" for k in range(1, BLOCK + 1)]
NODE = ["depth", "n1", "n2"]
BEFORE = ["block", "k1", "k2"]


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of role and text, then the bytes of the text as 64 bits; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 16, "0")))


def text_bytes(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("bigint")


def running(rows: DataFrame, by: str, order: Sequence[str], names: Sequence[str], fold: str) -> DataFrame:
    """The rows with each column of ``names`` (longs) folded over its group up to and including the row.

    ``fold`` is ``sum`` or ``xor``. Rows are range-partitioned by group and order, so a group may
    span many tasks; each task folds its own rows, and what earlier tasks hold of the one group
    that a partition begins within, one row per partition at most, is broadcast.
    """
    accumulate, undo = (np.cumsum, np.subtract) if fold == "sum" else (np.bitwise_xor.accumulate, np.bitwise_xor)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("_part int, _at bigint").fields])
    places = [rows.columns.index(name) for name in names]
    group = rows.columns.index(by)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        owner, held, met = None, [0] * len(places), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, columns = batch.column(group), list(batch.columns)
            new = np.ones(len(keys), bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
            goes_on = keys[0].as_py() == owner
            starts = np.flatnonzero(new)
            each = np.cumsum(new) - 1
            for k, place in enumerate(places):
                values = columns[place].to_numpy()
                sums = accumulate(values)
                out = undo(sums, undo(sums, values)[starts][each])
                if goes_on:
                    first = each == 0
                    out[first] = out[first] + held[k] if fold == "sum" else out[first] ^ held[k]
                held[k] = out[-1]
                columns[place] = pa.array(out)
            owner = keys[-1].as_py()
            columns += [pa.array(np.full(len(keys), part, np.int32)), pa.array(np.arange(met, met + len(keys)))]
            met += len(keys)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    combine = F.sum if fold == "sum" else F.bit_xor
    placed = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    local = written(placed.mapInArrow(folded, schema))
    totals = local.groupBy("_part", by).agg(*[F.max_by(name, "_at").alias(f"_{name}") for name in names])
    earlier = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        "_part", by, *[combine(f"_{n}").over(earlier).alias(f"_{n}") for n in names], F.count("_part").over(earlier).alias("_n")
    ).where("_n > 0")
    joined = local.join(F.broadcast(before.drop("_n")), ["_part", by], "left")
    zero = F.lit(0).cast("bigint")
    whole = {
        n: F.col(n) + F.coalesce(f"_{n}", zero) if fold == "sum" else F.col(n).bitwiseXOR(F.coalesce(f"_{n}", zero))
        for n in names
    }
    return joined.select(*[whole.get(c, F.col(c)).alias(c) for c in rows.columns])


def numbered_turns(table: DataFrame) -> DataFrame:
    """(conv_id, position, turn_id) of (conv_id, turn, role, text): positions from 1 by turn, null first.

    Rows of one turn go by their turn id. Rows with a null conv_id belong to no conversation.
    """
    turns = table.where("conv_id is not null").select(
        "conv_id", "turn", turn_id(F.col("role"), F.col("text")).alias("turn_id"), F.lit(1).cast("bigint").alias("position")
    )
    return running(turns, "conv_id", ["turn", "turn_id"], ["position"], "sum").select("conv_id", "position", "turn_id")


def hashed(seed: int, position: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(seed), position.cast("bigint"), turn)


def folded_turns(seed: int) -> Column:
    """The hashes of a block's turns; none for the columns that hold none."""
    out = F.lit(0).cast("bigint")
    for k, name in enumerate(TURNS, 1):
        value = hashed(seed, F.col("block") * BLOCK + k, F.col(name))
        out = out.bitwiseXOR(F.when(F.col(name).isNotNull(), value).otherwise(F.lit(0).cast("bigint")))
    return out


def block_rows(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, block, k1, k2, t1..., n_turns): a row per conversation and block of turns."""
    slot = (F.col("position") - 1) % BLOCK
    blocks = turns.groupBy("conv_id", F.floor((F.col("position") - 1) / BLOCK).alias("block")).agg(
        *[F.max(F.when(slot == k, F.col("turn_id"))).alias(name) for k, name in enumerate(TURNS)]
    )
    none = sizes.where("n_turns = 0").select(
        "conv_id", F.lit(0).cast("bigint").alias("block"), *[F.lit(None).cast("binary").alias(name) for name in TURNS]
    )
    every = blocks.unionByName(none).withColumns({"k1": folded_turns(1), "k2": folded_turns(2)})
    summed = running(every, "conv_id", ["block"], ["k1", "k2"], "xor")
    before = {name: F.col(name).bitwiseXOR(folded_turns(seed)) for name, seed in (("k1", 1), ("k2", 2))}
    return summed.withColumns(before).join(sizes, "conv_id")


def rolled_up(rows: DataFrame, aggregates: dict[str, str]) -> DataFrame:
    """All prefixes of the rows' turn columns within their node before: ROLLUP with grouping_id.

    A prefix is kept where all of its columns hold a turn; no turn at all is the node before,
    which only the first block has as a node of its own (the root).
    """
    columns = ", ".join(TURNS)
    wanted = ", ".join(f"{expression} AS {name}" for name, expression in aggregates.items())
    found = rows.sparkSession.sql(
        f"SELECT block, k1, k2, {columns}, {BLOCK} - bit_count(grouping_id()) AS level, {wanted} "
        f"FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({columns})",
        rows=rows,
    )
    filled = sum((F.col(name).isNotNull().cast("int") for name in TURNS), F.lit(0))
    kept = found.where((filled == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))
    return kept.select(
        "*",
        (F.col("block") * BLOCK + F.col("level")).cast("bigint").alias("depth"),
        F.col("k1").bitwiseXOR(folded_turns(1)).alias("n1"),
        F.col("k2").bitwiseXOR(folded_turns(2)).alias("n2"),
    )


def trie_nodes(blocks: DataFrame) -> DataFrame:
    """Every node with its key, its parent's (p1, p2), its path, n_convs, conv_id and last text's bytes."""
    found = rolled_up(blocks, {"n_convs": "count(*)", "conv_id": "min(conv_id)"})
    last = F.coalesce(*[F.col(name) for name in reversed(TURNS)])

    def above(key: str, seed: int) -> Column:
        return F.when(F.col("depth") > 0, F.col(key).bitwiseXOR(hashed(seed, F.col("depth"), last)))

    return found.withColumns(
        {"p1": above("n1", 1), "p2": above("n2", 2), "bytes": F.coalesce(text_bytes(last), F.lit(0).cast("bigint"))}
    )


def block_sums(shared: DataFrame) -> DataFrame | None:
    """(depth, n1, n2, below_leaves, below_saved): for the nodes that blocks go on from, sums of all below.

    Blocks point at the block before; pointers double until all have reached the first.
    """
    deepest = shared.agg(F.max("block")).first()[0] or 0
    if not deepest:
        return None
    sums = shared.groupBy(*BEFORE).agg(F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    ends = shared.where(F.col("level") == BLOCK).select(
        (F.col("block") + 1).alias("block"), F.col("n1").alias("k1"), F.col("n2").alias("k2"),
        F.col("block").alias("b"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
    )
    heads = written(sums.join(ends, BEFORE, "left"))
    reach = 1
    while reach <= deepest:
        gathered = heads.where("u1 is not null").groupBy(
            F.col("b").alias("block"), F.col("u1").alias("k1"), F.col("u2").alias("k2")
        ).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        over = heads.select(
            F.col("block").alias("b"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
            F.col("b").alias("b_"), F.col("u1").alias("u1_"), F.col("u2").alias("u2_"),
        )
        none = F.lit(0).cast("bigint")
        added = heads.join(gathered, BEFORE, "left").select(
            *BEFORE, "b", "u1", "u2",
            (F.col("leaves") + F.coalesce("more_leaves", none)).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", none)).alias("saved"),
        )
        moved = added.where("u1 is not null").join(over, ["b", "u1", "u2"]).drop("b", "u1", "u2")
        moved = moved.withColumnsRenamed({"b_": "b", "u1_": "u1", "u2_": "u2"})
        heads = written(added.where("u1 is null").unionByName(moved))
        reach *= 2
    return heads.where("block > 0").select(
        (F.col("block") * BLOCK).alias("depth"), F.col("k1").alias("n1"), F.col("k2").alias("n2"),
        F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"),
    )


def subtree_sums(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """(depth, n1, n2, n_leaves, saved_tokens) of the nodes with two members or more.

    Below a node of one member there is one leaf and nothing to save.
    """
    shared = written(
        nodes.where("n_convs > 1")
        .join(children, NODE, "left")
        .withColumns(
            {
                "own_leaves": F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(F.col("lone")).cast("bigint"),
                "own_saved": (F.col("n_convs") - 1) * F.col("bytes"),
            }
        )
        .select(*NODE, *BEFORE, *TURNS, "level", "own_leaves", "own_saved")
    )
    below = block_sums(shared)
    if below is not None:
        none = F.lit(0).cast("bigint")
        shared = shared.join(below, NODE, "left").withColumns(
            {
                "own_leaves": F.col("own_leaves") + F.coalesce("below_leaves", none),
                "own_saved": F.col("own_saved") + F.coalesce("below_saved", none),
            }
        )
    found = rolled_up(shared, {"n_leaves": "sum(own_leaves)", "saved_tokens": "sum(own_saved)"})
    return found.select(*NODE, "n_leaves", "saved_tokens")


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, n1, n2, ends_sha256) of (depth, n1, n2, conv_id): ids joined in order, by commas.

    A digest is taken in order, so a node's ids pass through one task, as a stream of joined
    chunks that many tasks made.
    """
    keys = StructType([ends.schema[name] for name in NODE])
    pieces = StructType([*keys.fields, *StructType.fromDDL("first bigint, ids string").fields])
    digests = StructType([*keys.fields, *StructType.fromDDL("ends_sha256 string").fields])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            row = [*node, ids[0], ",".join(map(str, ids))]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=pieces.names)

        for batch in batches:
            for *key, conv in zip(*(batch.column(n).to_pylist() for n in (*NODE, "conv_id")), strict=True):
                if ids and (key != node or len(ids) >= CHUNK):
                    yield piece()
                    ids = []
                node = key
                ids.append(conv)
        if ids:
            yield piece()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], names=digests.names)

        for batch in batches:
            for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids")), strict=True):
                if key != node:
                    if node is not None:
                        yield row()
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node is not None:
            yield row()

    placed = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    chunks = placed.mapInArrow(joined, pieces)
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digested, digests)


def with_parents(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """The nodes with ``parent_conv_id``; parents of very many nodes are broadcast."""
    count = nodes.count()
    parents = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")).join(children.select(*NODE, "n_children"), NODE)
    parents = written(
        parents.select(
            (F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), "parent_conv_id", "n_children"
        )
    )
    keys = ["depth", "p1", "p2"]
    is_hot = F.col("n_children") > count // HOT_SHARE
    hot = F.broadcast(parents.where(is_hot).drop("n_children"))
    cold = parents.where(~is_hot).drop("n_children")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(nodes.schema["conv_id"].dataType))
    under = nodes.where("depth > 0")
    return root.unionByName(under.join(hot, keys)).unionByName(under.join(hot, keys, "left_anti").join(cold, keys))


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, position from 1 without gaps, turn_id), see ``turn_id``; ``sizes`` has
    (conv_id, n_turns) for every conversation, turnless ones too, which are members of the root
    alone. Turns are equal when their 128 bits of role and text and the bytes of the text are;
    nodes are told apart by 128 bits. Without conversations there is no node. Ids are not null;
    no id repeats in ``sizes``.
    """
    blocks = written(block_rows(turns, sizes))
    nodes = written(trie_nodes(blocks))
    children = written(
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2"))
        .agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    )
    last = F.greatest(F.floor((F.col("n_turns") - 1) / BLOCK), F.lit(0))
    ends = blocks.where(F.col("block") == last).select(
        F.col("n_turns").alias("depth"),
        F.col("k1").bitwiseXOR(folded_turns(1)).alias("n1"),
        F.col("k2").bitwiseXOR(folded_turns(2)).alias("n2"),
        "conv_id",
    )
    narrow = nodes.select(*NODE, "p1", "p2", "conv_id", "n_convs")
    found = (
        with_parents(narrow, children)
        .join(children.select(*NODE, "n_children"), NODE, "left")
        .join(subtree_sums(nodes, children), NODE, "left")
        .join(id_digests(ends), NODE, "left")
    )
    none = F.lit(0).cast("bigint")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", none).alias("n_children"),
        F.coalesce("n_leaves", none + 1).alias("n_leaves"),
        F.coalesce("saved_tokens", none).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of the rebuilt conversations of the query.

    Conversation c takes the first h turns of c - c % 5, h = crc32 of c in decimals % 9, then its
    own turns after its first h.
    """
    counts = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    head = (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h")
    convs = counts.select("conv_id", "n", head, (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    first = turns.where("position <= 8").withColumnRenamed("conv_id", "base")
    borrowed = convs.join(first, "base").where("position <= h").select("conv_id", "position", "turn_id")
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = turns.join(taken.select("conv_id", "h", "taken"), "conv_id").where("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "turn_id")
    rest = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return borrowed.unionByName(own), taken.select("conv_id", (F.col("taken") + rest).alias("n_turns"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null conv_id belong to no conversation; null roles and texts count as empty.

    c % 5 of a negative id has its sign, as in SQL.
    """
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns, sizes = rebuilt(written(numbered_turns(table)))
    return prefix_trie(turns, sizes)


SQL = r"""
WITH original AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT c, c - c % 5 AS base,
    xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
      lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)), 4294967295), 4294967295) % 9 AS h
  FROM original),
turns AS (
  SELECT v.c, 0 AS part, o.p, o.r, o.x FROM convs v JOIN original o ON o.c = v.base AND o.p <= v.h
  UNION ALL SELECT v.c, 1, o.p, o.r, o.x FROM convs v JOIN original o ON o.c = v.c AND o.p > v.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, r, x FROM turns),
paths AS (
  SELECT c, d, md5(string_agg(md5(length(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d)) AS k, strlen(x) AS b
  FROM placed
  UNION ALL SELECT c, 0, '', 0 FROM convs),
linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) = d AS last FROM paths),
nodes AS (
  SELECT d, k, any_value(up) AS up, any_value(b) AS b, min(c) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends
  FROM linked GROUP BY d, k),
children AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT nodes.*, coalesce(children.n, 0) AS below FROM nodes LEFT JOIN children USING (d, k)),
sums AS (
  SELECT l.d, l.k, sum(CASE WHEN w.below = 0 THEN 1 ELSE 0 END) AS leaves, sum((w.n - 1) * w.b) AS saved
  FROM whole w JOIN linked l ON l.c = w.conv_id AND l.d <= w.d GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.below AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN sums s USING (d, k) LEFT JOIN nodes p ON p.d = w.d - 1 AND p.k = w.up
"""

QUERIES = {"op11_conversation_trie": op11_conversation_trie}
ORACLES = {"op11_conversation_trie": SQL}
