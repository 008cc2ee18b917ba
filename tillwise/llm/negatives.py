"""Hard negatives by threshold joins in the manner of L2AP.

A search asks, per anchor and window, for the best rows of a window of scores. Rows are dealt to
blocks by the hash of their id, so a common vector spreads over all of them; anchors pass through
every block as a stream.

- A block keeps an inverted index: dimensions in falling order of their energy, in chunks, and for
  each chunk the rows that index it. A row leaves out its last chunks where their norm, times the
  anchor's, stays under the threshold: no pair reaches it by those alone.
- Partial scores are accumulated chunk by chunk. Half way, and at the end, pairs go whose partial
  score and remaining norms cannot reach the threshold; the others are completed exactly.
- Thresholds start high, from the scores of a bounded sample, and are lowered for the windows that
  are not full, down to the lower end of the window. So results are exact whatever the sample.

A task sends on only its best rows per window, never its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.lineage import written

# Parameters.
BLOCK_ROWS = 1 << 16  # rows of a block at most, on average
SAMPLE = 4096  # rows that set the first thresholds: least hashes of the ids
CHUNK = 8  # dimensions
ANCHORS = 32  # scored at once
LEAST = -(1 << 62)
STEP = 8  # a lower threshold lets in so many times the rows
EXACT = 2.0**53


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    values = column.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.float64)
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def widened(values: np.ndarray, width: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, width - values.shape[1]))) if values.shape[1] < width else values


class Block:
    """Rows with an inverted index over chunks of dimensions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.width = ids, labels, vectors.shape[1]
        self.order = np.argsort(-np.square(vectors).sum(0), kind="stable")
        self.vectors = vectors[:, self.order]
        self.most = float(np.abs(vectors).max(initial=0))
        self.rest = self.rests(self.vectors)

    def rests(self, vectors: np.ndarray) -> np.ndarray:
        """Norms of what is left from each chunk on (last: nothing), a hair over the exact ones."""
        chunks = [np.square(vectors[:, c : c + CHUNK]).sum(1) for c in range(0, vectors.shape[1], CHUNK)]
        energy = np.stack([*chunks, np.zeros(len(vectors))], axis=1)
        return np.sqrt(np.cumsum(energy[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)

    def pairs(self, anchors: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per anchor, (places, scores) of all rows with a score of ``least`` or more."""
        width = max(self.width, anchors.shape[1])
        if float(np.abs(anchors).max(initial=0)) * self.most * max(1, width) >= EXACT:
            yield from self.exact_pairs(anchors, least, width)
            return
        mine = widened(anchors, width)[:, : self.width][:, self.order]  # the block has zeros beyond its width
        rest = self.rests(mine)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = float(np.where(rest[:, 0] > 0, least / rest[:, 0], np.where(least > 0, np.inf, -np.inf)).min(initial=np.inf))
        indexed = (self.rest[:, :-1] >= ratio).sum(1)  # chunks that each row indexes: rests only fall
        by_length = np.argsort(-indexed, kind="stable")
        lengths = indexed[by_length]
        met = np.searchsorted(-lengths, 0)  # rows that index nothing are in no list
        rows, lengths = by_length[:met], lengths[:met]
        vectors, left = self.vectors[rows], self.rest[rows]
        partial = np.zeros((len(mine), met))
        chunks = self.rest.shape[1] - 1
        half = (chunks + 1) // 2
        for chunk in range(half):
            self.accumulate(partial, mine, vectors, lengths, chunk)
        upto = np.minimum(lengths, half)
        alive = partial + rest[:, upto] * left[np.arange(met), upto] >= least[:, None]
        if alive.mean() < 0.2 if alive.size else True:
            for k in range(len(mine)):
                places = np.flatnonzero(alive[k])
                begun = upto[places] * CHUNK
                tail = np.arange(self.width)[None, :] >= begun[:, None]
                scores = partial[k, places] + (vectors[places] * mine[k] * tail).sum(1)
                good = scores >= least[k]
                yield rows[places[good]], scores[good]
            return
        for chunk in range(half, chunks):
            self.accumulate(partial, mine, vectors, lengths, chunk)
        alive = partial + rest[:, lengths] * left[np.arange(met), lengths] >= least[:, None]
        for k in range(len(mine)):
            places = np.flatnonzero(alive[k])
            tail = np.arange(self.width)[None, :] >= lengths[places][:, None] * CHUNK
            scores = partial[k, places] + (vectors[places] * mine[k] * tail).sum(1)
            good = scores >= least[k]
            yield rows[places[good]], scores[good]

    @staticmethod
    def accumulate(partial: np.ndarray, mine: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, chunk: int) -> None:
        listed = np.searchsorted(-lengths, -chunk)  # the rows that index this chunk come first
        span = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
        partial[:, :listed] += mine[:, span] @ vectors[:listed, span].T

    def exact_pairs(self, anchors: np.ndarray, least: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Scores beyond 53 bits, with Python's integers."""
        back = np.empty_like(self.order)
        back[self.order] = np.arange(self.width)
        rows = [list(map(int, row)) for row in widened(self.vectors[:, back], width)]
        for anchor, low in zip(widened(anchors, width), least.tolist(), strict=True):
            mine = list(map(int, anchor))
            scores = [sum(map(int.__mul__, mine, row)) for row in rows]
            places = [k for k, score in enumerate(scores) if score >= low]
            yield np.array(places, np.int64), np.array([scores[k] for k in places], np.int64)


def searched(rows: DataFrame, asked: DataFrame, blocks: int, number: int, same: bool) -> DataFrame:
    """(anchor_id, window, vec_id, score): each block's best ``number`` rows per window.

    ``asked`` has (anchor_id, label, vector, windows), windows a list of (window, low, high,
    threshold); scores from the threshold to ``high`` count. ``same``: rows of the anchor's label,
    else of another one; never the anchor itself.
    """
    names = ["anchor_id", "window", "vec_id", "score"]
    here = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast(asked.schema["windows"].dataType)
    own = rows.select(here.alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "vector", none.alias("windows"))
    sent = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
        F.col("anchor_id").alias("id"), "label", "vector", "windows",
    )
    placed = own.unionByName(sent).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")

    def best(block: Block, anchors: list[dict], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        least = np.array([min(w["threshold"] for w in a["windows"]) for a in anchors], np.float64)
        for anchor, (places, scores) in zip(anchors, block.pairs(vectors, least), strict=True):
            fits = ((block.labels[places] == anchor["label"]) == same) & (block.ids[places] != anchor["id"])
            places, scores = places[fits], scores[fits].astype(np.int64)
            for window in anchor["windows"]:
                inside = np.flatnonzero((scores >= window["threshold"]) & (scores <= window["high"]))
                ids, values = block.ids[places[inside]], scores[inside]
                first = np.lexsort((ids, -values))[:number]
                out += [(anchor["id"], window["window"], i, v) for i, v in zip(ids[first].tolist(), values[first].tolist(), strict=True)]
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, held = None, None, []
        for batch in batches:
            places, kinds = (batch.column(k).to_numpy() for k in range(2))
            cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
                if first == last:
                    continue
                piece = batch.slice(first, last - first)
                if places[first] != now:
                    now, block, held = places[first], None, []
                if kinds[first] == 0:
                    held.append((piece.column(2).to_numpy(), piece.column(3).to_numpy(), matrix(piece.column(4))))
                    continue
                if block is None:
                    if not held:
                        continue
                    width = max(v.shape[1] for _, _, v in held)
                    block = Block(
                        np.concatenate([i for i, _, _ in held]),
                        np.concatenate([x for _, x, _ in held]),
                        np.concatenate([widened(v, width) for _, _, v in held]),
                    )
                    held = [held[0]]
                for start in range(0, piece.num_rows, ANCHORS):
                    some = piece.slice(start, ANCHORS)
                    columns = (some.column(k).to_pylist() for k in (2, 3, 5))
                    anchors = [{"id": i, "label": x, "windows": w} for i, x, w in zip(*columns, strict=True)]
                    yield from best(block, anchors, matrix(some.column(4)))

    return placed.mapInArrow(scored, "anchor_id bigint, window bigint, vec_id bigint, score bigint")


def ladders(rows: DataFrame, asked: DataFrame, count: int, number: int, same: bool) -> DataFrame:
    """(anchor_id, window, low, high, ladder) of (anchor_id, label, vector, window, low, high).

    A ladder has falling thresholds down to ``low``: by a bounded sample of the rows the first lets
    in four times the rows that fill a window, each further one ``STEP`` times more.
    """
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("label", "vector").toArrow()
    labels = picked["label"].to_numpy()
    sample = matrix(picked["vector"].combine_chunks()) if len(labels) else np.zeros((0, 0))
    first = max(1, -(-4 * number * len(labels) // max(1, count)))
    names = ["anchor_id", "window", "low", "high", "ladder"]

    def climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, ANCHORS):
                piece = batch.slice(start, ANCHORS)
                vectors = matrix(piece.column(2), sample.shape[1])
                scores = widened(sample, vectors.shape[1]) @ vectors.T
                columns = (piece.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
                for k, (anchor, label, window, low, high) in enumerate(zip(*columns, strict=True)):
                    mine = scores[(labels == label) == same, k]
                    mine = np.sort(mine[(mine <= high) & (mine >= low)])[::-1]
                    steps, at = [], first
                    while at <= len(mine):
                        steps.append(int(mine[at - 1]))
                        at *= STEP
                    out.append((anchor, window, low, high, [*dict.fromkeys(s for s in steps if s > low), low]))
            if out:
                types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "anchor_id bigint, window bigint, low bigint, high bigint, ladder array<bigint>"
    return asked.select("anchor_id", "label", "vector", "window", "low", "high").mapInArrow(climbed, kinds)


def best_in_windows(
    rows: DataFrame, anchors: DataFrame, windows: DataFrame, count: int, number: int, same: bool
) -> DataFrame:
    """(anchor_id, window, rank, vec_id, score): the first ``number`` rows of each window, exactly.

    ``windows`` has (anchor_id, window, low, high). Better scores come first, ties by id.
    """
    spark = rows.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BLOCK_ROWS))
    open_ = written(ladders(rows, anchors.join(windows, "anchor_id"), count, number, same))
    order = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    rung, done = 0, None
    while open_.limit(1).count():
        at = F.least(F.lit(rung), F.size("ladder") - 1)
        now = open_.withColumn("threshold", F.get("ladder", at))
        asked = anchors.join(
            now.groupBy("anchor_id").agg(F.collect_list(F.struct("window", "low", "high", "threshold")).alias("windows")),
            "anchor_id",
        )
        ranked = searched(rows, asked, blocks, number, same).withColumn("rank", F.row_number().over(order))
        found = written(ranked.where(F.col("rank") <= number))
        full = now.join(found.groupBy("anchor_id", "window").agg(F.max("rank").alias("met")), ["anchor_id", "window"], "left")
        is_full = (F.coalesce("met", F.lit(0)) >= number) | (F.col("threshold") <= F.col("low"))
        mine = found.join(full.where(is_full).select("anchor_id", "window"), ["anchor_id", "window"])
        done = mine if done is None else done.unionByName(mine)
        open_ = written(full.where(~is_full).select(*open_.columns))
        rung += 1
    if done is None:
        return spark.createDataFrame([], "anchor_id long, window long, rank int, vec_id long, score long")
    return done.select("anchor_id", "window", "rank", "vec_id", "score")


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has (vec_id, label, vector of whole numbers). An anchor's positives are its best
    ``positives`` other rows of its label; a positive's negatives the best ``negatives`` rows of
    other labels whose score is from ``low`` to ``high`` percent of the positive's. Ties go to the
    smaller id. Rows without id, label or vector take no part; of rows that share an id the one
    with the least label and vector does. A shorter vector ends in zeros. Scores beyond 64 bits are
    an error. Without anchors, or without rows of two labels, there is no row.
    """
    known = vectors.where("vec_id is not null and label is not null and vector is not null")
    rows = written(
        known.groupBy("vec_id")
        .agg(F.min(F.struct(F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"))).alias("own"))
        .select("vec_id", "own.label", "own.vector")
    )
    count = rows.count()
    anchors = written(rows.where(is_anchor).withColumnRenamed("vec_id", "anchor_id"))
    every = anchors.select("anchor_id", F.lit(0).cast("bigint").alias("window"), F.lit(LEAST).alias("low"), F.lit(-LEAST).alias("high"))
    found = best_in_windows(rows, anchors, every, count, positives, True)
    near = written(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    least, most = low * F.col("positive_score"), high * F.col("positive_score")
    hundred = F.lit(100).cast("bigint")
    windows = near.select(
        "anchor_id",
        F.col("positive_id").alias("window"),
        F.call_function("div", least + F.pmod(-least, hundred), hundred).alias("low"),
        F.call_function("div", most - F.pmod(most, hundred), hundred).alias("high"),
    ).where("low <= high")
    hard = best_in_windows(rows, anchors, windows, count, negatives, False)
    return hard.withColumnRenamed("window", "positive_id").join(near, ["anchor_id", "positive_id"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def whole_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the embeddings that take part, labels and components as the query has them."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return table.where(F.col("embedding").isNotNull() & finite).select("vec_id", moved.alias("label"), vector.alias("vector"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return mine_negatives(whole_vectors(table), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": SQL}
