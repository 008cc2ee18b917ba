"""Many boosted classifiers in the same passes over the rows.

A search fits one model per fold and setting. Here they grow together: a pass over the rows adds up,
for every model, the gradients and hessians of the log loss by open node, feature and bin; the sums
of a node meet in one task, which sends its best split to the driver. So a search takes as many
passes as its deepest model alone, rounds x depth, however many models there are. While a task can hold the
binned rows (a byte per feature), tasks grow whole models instead, by the same steps and without passes.

Trees take Newton steps with an L2 penalty of their leaves; a split needs a gain and a least hessian
on both sides. The rows keep one margin per model: a tree is applied once,
when its round is over, and the rows are kept by Spark until the next one; they are written every
``WRITTEN_EVERY`` rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import shared
from tillwise.functions.lineage import cut_lineage

# Parameters.
BINS = 32
PENALTY = 1.0
LEAST_HESSIAN = 1.0
LEAST_GAIN = 1e-6
WRITTEN_EVERY = 10
ROWS_PER_TASK = 5_000
ROWS_ALONE = 2_000_000  # that a task holds, a byte per feature, to grow models by itself
NODES_AT_ONCE = 256  # nodes whose sums are searched in one step


SPLIT = ["slot", "feature", "cut", "gain", "left_g", "left_h", "g", "h"]


class Model(NamedTuple):
    fold: int  # held out
    rate: float
    depth: int


class Trees(NamedTuple):
    """One tree per model; node i has the children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # -1 where a node is a leaf
    cut: np.ndarray  # bins up to this one go left
    value: np.ndarray  # step of the margin, the rate included

    @classmethod
    def empty(cls, models: int, depth: int) -> Trees:
        shape = (models, (2 << depth) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape))

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """(row, model): the leaf of each row in each model's tree, as far as it has grown."""
        rows, models = np.arange(len(bins))[:, None], np.arange(len(self.feature))
        at = np.zeros((len(bins), len(models)), np.int64)
        while True:
            feature = self.feature[models, at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(feature, 0)] > self.cut[models, at]
            at = np.where(inner, 2 * at + 1 + right, at)


def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature but the last; ``BINS`` numbers per feature at most."""
    shares = [k / BINS for k in range(1, BINS)]
    vector = vector_to_array("vector")
    found = rows.agg(*[F.percentile_approx(vector[k], shares, 10_000).alias(f"f{k}") for k in range(width)]).first()
    return [np.unique(np.array(edges or [], float)) for edges in found]


def binned(rows: DataFrame, label: Column, models: int, width: int) -> DataFrame:
    """(fold, label, bins, margins) with all margins at zero."""
    edges = bin_edges(rows, width)
    start = np.zeros(models).tobytes()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2)
            vectors = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), width)
            bins = np.stack([np.searchsorted(e, vectors[:, k]) for k, e in enumerate(edges)], axis=1).astype(np.uint8)
            columns = [pa.array([b.tobytes() for b in bins], pa.binary()), pa.array([start] * len(bins), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["fold", "label", "bins", "margins"])

    source = rows.select(F.col("Fold").cast("int").alias("fold"), label.cast("double").alias("label"), vector_to_array("vector").alias("v"))
    return source.mapInArrow(placed, "fold int, label double, bins binary, margins binary")


def unpacked(batch: pa.RecordBatch, models: Sequence[Model], grown: Sequence[Trees]) -> tuple[np.ndarray, ...]:
    """Folds, labels, bins and margins of a batch, the trees grown since the last copy applied."""
    rows = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(rows, -1)
    margins = np.frombuffer(b"".join(batch.column(3).to_pylist()), float).reshape(rows, len(models)).copy()
    every = np.arange(len(models))
    for trees in grown:
        margins += trees.value[every, trees.reached(bins)]
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), bins, margins


def best_splits(sums: np.ndarray) -> list[np.ndarray]:
    """Feature, bin, gain, left sums and whole sums of every node; ``sums`` are (node, g or h, feature, bin)."""
    left = np.cumsum(sums, axis=3)
    whole, left = left[:, :, 0, -1], left[:, :, :, :-1]
    right = whole[:, :, None, None] - left
    score = lambda s: s[:, 0] ** 2 / (s[:, 1] + PENALTY)
    gain = (score(left) + score(right) - score(whole)[:, None, None]) / 2
    gain = np.where((left[:, 1] >= LEAST_HESSIAN) & (right[:, 1] >= LEAST_HESSIAN), gain, -1.0).reshape(len(sums), -1)
    best, every = np.argmax(np.round(gain, 9), axis=1), np.arange(len(sums))
    feature, cut = np.divmod(best, left.shape[3])
    return [feature, cut, gain[every, best], *left[every, :, feature, cut].T, *whole.T]


def node_splits(
    state: DataFrame,
    models: Sequence[Model],
    grown: Sequence[Trees],
    now: Trees,
    open_nodes: Sequence[tuple[int, int]],
    tasks: int,
) -> list:
    """The best split of every open node (model, node), from one pass over the rows."""
    slots = np.full(now.feature.shape, -1)
    for slot, (model, node) in enumerate(open_nodes):
        slots[model, node] = slot
    folds, every = np.array([m.fold for m in models]), np.arange(len(models))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, label, bins, margins = unpacked(batch, models, grown)
            slot = np.where(fold[:, None] != folds, slots[every, now.reached(bins)], -1)
            chance = 1 / (1 + np.exp(-margins))
            row, model = np.nonzero(slot >= 0)
            mine, p = slot[row, model], chance[row, model]
            g, h = p - label[row], p * (1 - p)
            if total is None:
                total = np.zeros((2, bins.shape[1], len(open_nodes) * BINS))
            for k in range(bins.shape[1]):
                place = mine * BINS + bins[row, k]
                total[0, k] += np.bincount(place, g, total.shape[2])
                total[1, k] += np.bincount(place, h, total.shape[2])
        if total is not None:
            by_slot = total.reshape(2, -1, len(open_nodes), BINS).transpose(2, 0, 1, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(open_nodes))), pa.array([np.ascontiguousarray(x).tobytes() for x in by_slot], pa.binary())],
                names=["slot", "sums"],
            )

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(sums, float)
                held[slot] = held[slot] + values if slot in held else values
        slots = sorted(held)
        for start in range(0, len(slots), NODES_AT_ONCE):
            some = slots[start : start + NODES_AT_ONCE]
            found = best_splits(np.stack([held[slot] for slot in some]).reshape(len(some), 2, -1, BINS))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (some, *found)], names=SPLIT)

    parts = state.mapInArrow(summed, "slot bigint, sums binary")
    parts = parts.repartition("slot") if tasks > 1 else parts  # the sums of one task are whole
    kinds = "slot bigint, feature bigint, cut bigint, gain double, left_g double, left_h double, g double, h double"
    return parts.mapInArrow(chosen, kinds).collect()


def grow_trees(models: Sequence[Model], splits: Callable[[Trees, list[tuple[int, int]]], list]) -> Trees:
    """One tree per model, level by level; ``splits`` gives the best split of every open node (model, node)."""
    now = Trees.empty(len(models), max(m.depth for m in models))
    open_nodes = [(k, 0) for k in range(len(models))]
    while open_nodes:
        following = []
        for row in splits(now, open_nodes):
            model, node = open_nodes[row["slot"]]
            settings = models[model]
            step = lambda g, h: -settings.rate * g / (h + PENALTY)  # noqa: B023, E731
            now.value[model, node] = step(row["g"], row["h"])
            if row["gain"] <= LEAST_GAIN:
                continue
            now.feature[model, node], now.cut[model, node] = row["feature"], row["cut"]
            level = (node + 1).bit_length()  # of the children
            sides = (row["left_g"], row["left_h"]), (row["g"] - row["left_g"], row["h"] - row["left_h"])
            for child, (g, h) in enumerate(sides, 2 * node + 1):
                now.value[model, child] = step(g, h)
                if level < settings.depth and h >= 2 * LEAST_HESSIAN:
                    following.append((model, child))
        open_nodes = sorted(following)
    return now


def grow_round(state: DataFrame, models: Sequence[Model], grown: Sequence[Trees], tasks: int) -> Trees:
    """One more tree per model, all of them level by level in shared passes."""
    return grow_trees(models, lambda now, open_nodes: node_splits(state, models, grown, now, open_nodes, tasks))


def margins_alone(folds: np.ndarray, labels: np.ndarray, bins: np.ndarray, model: Model, rounds: int) -> np.ndarray:
    """The margin of every row under one model, grown here on the rows of the folds it does not hold out."""
    fit, margins = folds != model.fold, np.zeros(len(labels))
    by_feature = np.ascontiguousarray(bins.T)
    if not fit.any():
        return margins
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-margins))
        g, h = chance - labels, chance * (1 - chance)
        at = np.zeros(len(labels), np.int64)

        def further(now: Trees) -> None:
            """Rows go on below the nodes that were split."""
            feature = now.feature[0, at]  # noqa: B023
            inner = np.flatnonzero(feature >= 0)
            right = by_feature[feature[inner], inner] > now.cut[0, at[inner]]  # noqa: B023
            at[inner] = 2 * at[inner] + 1 + right  # noqa: B023

        def splits(now: Trees, open_nodes: list[tuple[int, int]]) -> list:
            further(now)
            slots = np.full(now.feature.shape[1], -1)
            slots[[node for _, node in open_nodes]] = np.arange(len(open_nodes))
            slot = np.where(fit, slots[at], -1)  # noqa: B023
            rows = np.flatnonzero(slot >= 0)
            base, ours_g, ours_h = slot[rows] * BINS, g[rows], h[rows]  # noqa: B023
            sums = np.empty((len(open_nodes), 2, len(by_feature), BINS))
            for k, feature in enumerate(by_feature):
                place = base + feature[rows]
                for side, weight in enumerate((ours_g, ours_h)):
                    sums[:, side, k] = np.bincount(place, weight, len(open_nodes) * BINS).reshape(-1, BINS)
            found = [column.tolist() for column in best_splits(sums)]
            return [dict(zip(SPLIT, (k, *line), strict=True)) for k, line in enumerate(zip(*found, strict=True))]

        now = grow_trees([model], splits)
        further(now)
        margins += now.value[0, at]
    return margins


def counts_alone(rows: DataFrame, label: Column, models: Sequence[Model], rounds: int, width: int) -> dict[int, tuple[int, int, int]]:
    """Model number -> hits, wrong and missed decisions on the rows it held out; a task grows whole models, the deepest first.

    The binned rows are written to the shared folder, a byte per feature, and every task reads all of them.
    """
    spark = rows.sparkSession
    folder = shared.shared_folder(spark, "bins")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [batch for batch in batches if batch.num_rows]
        if tables:
            yield pa.RecordBatch.from_arrays([pa.array([shared.save(folder, pa.Table.from_batches(tables))])], names=["path"])

    paths = sorted(r["path"] for r in binned(rows, label, 0, width).drop("margins").mapInArrow(kept, "path string").collect())
    order = sorted(range(len(models)), key=lambda k: -models[k].depth)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for place in batch.column(0).to_pylist():
                if table is None:
                    table = pa.concat_tables([shared.load(path) for path in paths])
                    folds, labels = table.column("fold").to_numpy(), table.column("label").to_numpy()
                    bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(folds), -1)
                number = order[place]
                held = folds == models[number].fold
                decided = margins_alone(folds, labels, bins, models[number], rounds)[held] > 0
                positive = labels[held] > 0.5
                counts = [int((a & b).sum()) for a, b in ((positive, decided), (~positive, decided), (positive, ~decided))]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (number, *counts)], names=["model", "hits", "wrong", "missed"])

    found = spark.range(0, len(models), 1, len(models)).mapInArrow(grown, "model bigint, hits bigint, wrong bigint, missed bigint")
    return {row["model"]: (row["hits"], row["wrong"], row["missed"]) for row in found.collect()}


def boosted_counts(rows: DataFrame, label: Column, models: Sequence[Model], rounds: int) -> dict[int, tuple[int, int, int]]:
    """Hits, wrong and missed decisions of every model on the rows it held out.

    As long as a task can hold the binned rows, tasks grow whole models and no pass is shared; more rows
    are spread over tasks and the models grow together, a pass per level.
    """
    rows = cut_lineage(rows.where(label.isNotNull()).select("Fold", "vector", label.alias("_label")))
    known = F.col("_label")
    count = rows.count()
    if not 0 < count <= ROWS_ALONE:
        return held_out_counts(boosted_margins(rows, known, models, rounds), models)
    width = rows.select(F.size(vector_to_array("vector")).alias("n")).first()["n"]
    return counts_alone(rows, known, models, rounds, width)


def boosted_margins(rows: DataFrame, label: Column, models: Sequence[Model], rounds: int) -> DataFrame:
    """(fold, label, margins): the margin of every row under every model, as float64 bytes.

    ``rows`` has ``vector`` and ``Fold``; rows without a label are left out. Each model is fitted
    on the rows of the folds it does not hold out.
    """
    known = rows.where(label.isNotNull())
    first = known.select(F.size(vector_to_array("vector")).alias("n")).first()
    width, count = (first["n"], known.count()) if first else (0, 0)
    state = cut_lineage(binned(known, label, len(models), width).coalesce(max(1, -(-count // ROWS_PER_TASK))))
    tasks = state.rdd.getNumPartitions() if count else 0
    kept, older = False, None
    for number in range(1, rounds + 1) if count else ():
        trees = grow_round(state, models, [], tasks)
        if older is not None:
            older.unpersist()
        following, older = moved(state, models, [trees]), state if kept else None
        if number % WRITTEN_EVERY == 0 or number == rounds:
            state, kept = cut_lineage(following), False
            if older is not None:
                older.unpersist()
                older = None
            tasks = state.rdd.getNumPartitions()
        else:
            state, kept = following.persist(), True
    return state.drop("bins")


def moved(state: DataFrame, models: Sequence[Model], grown: Sequence[Trees]) -> DataFrame:
    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margins = unpacked(batch, models, grown)[3]
                column = pa.array([m.tobytes() for m in margins], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], column], names=batch.schema.names)

    return state.mapInArrow(applied, state.schema)


def held_out_counts(margins: DataFrame, models: Sequence[Model]) -> dict[int, tuple[int, int, int]]:
    """Model number -> hits, wrong and missed decisions on the rows that it held out."""
    folds = np.array([m.fold for m in models])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), float).reshape(batch.num_rows, len(models))
            held = batch.column(0).to_numpy()[:, None] == folds
            positive, decided = (batch.column(1).to_numpy() > 0.5)[:, None], values > 0
            sums = [(held & a & b).sum(axis=0) for a, b in ((positive, decided), (~positive, decided), (positive, ~decided))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), *map(pa.array, sums)], names=["model", "hits", "wrong", "missed"])

    parts = margins.select("fold", "label", "margins").mapInArrow(counted, "model bigint, hits bigint, wrong bigint, missed bigint")
    found = parts.groupBy("model").agg(*[F.sum(n).alias(n) for n in ("hits", "wrong", "missed")]).collect()
    return {row["model"]: (row["hits"], row["wrong"], row["missed"]) for row in found}
