"""Random forests of all folds in the same passes over the rows.

A pass counts, for every tree, the drawn rows of both classes by open node, drawn feature and bin; the
counts of a tree meet in one task, which sends the best split of each open node to the driver. So all
folds take as many passes as a tree has levels. A task goes tree by tree, so that the counts it is
adding to stay small, and sends whole numbers: a forest does not depend on how the rows are spread.

As in Spark ML: Poisson(1) draws of the rows, the square root of the features drawn per node, Gini
gains, 32 bins and one weight per class. A row is drawn for a tree by its id alone, in every fold alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, exp, factorial, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.lineage import cut_lineage

# Parameters.
BINS = 32
SEED = 42
LEAST_GAIN = 1e-12
LEAST_ROWS, MOST_ROWS = 5_000, 500_000  # of a task
END = 255  # a cut that every bin is up to

#: Rows drawn so many times, by the first 16 bits of a hash.
DRAWN = np.searchsorted(np.cumsum([exp(-1) / factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


class Grown(NamedTuple):
    """Trees level by level; node p of a level has the nodes 2 p and 2 p + 1 of the next one as children."""

    feature: list[np.ndarray]  # (tree, node)
    cut: list[np.ndarray]  # bins up to this one go left; END where a node is a leaf or none
    counts: list[np.ndarray]  # (tree, node, class): the rows drawn; one level more

    def shares(self, weights: np.ndarray, depth: int) -> np.ndarray:
        """(tree, node of the last level): the positive share of the leaf on its way when trees are cut at a depth.

        Leaves that decide alike are joined, as Spark ML does.
        """
        weighted = [c * weights for c in self.counts[: depth + 1]]
        share = [w[..., 1] / np.maximum(w.sum(axis=2), 1e-300) for w in weighted]
        ends = [c == END for c in self.cut[:depth]] + [np.ones(share[depth].shape, bool)]
        for level in range(depth - 1, -1, -1):
            decided = share[level + 1] > 0.5
            alike = (decided[:, ::2] == decided[:, 1::2]) & ends[level + 1][:, ::2] & ends[level + 1][:, 1::2]
            ends[level] |= alike
        found, ended = share[0], ends[0]
        for level in range(1, depth + 1):
            above, over = np.repeat(found, 2, axis=1), np.repeat(ended, 2, axis=1)
            found, ended = np.where(over, above, share[level]), over | ends[level]
        return np.repeat(found, 1 << (len(self.cut) - depth), axis=1)

    def reached(self, tree: int, bins: np.ndarray, base: np.ndarray, level: int) -> np.ndarray:
        """The node of a level that each row comes to; ``base`` is where its bins start."""
        at = np.zeros(len(base), np.intp)
        for feature, cut in zip(self.feature[:level], self.cut[:level], strict=True):
            right = bins.take(base + feature[tree].astype(np.intp).take(at)) > cut[tree].take(at)
            at += at
            at += right
        return at


class Split(NamedTuple):
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray  # (node, class)
    whole: np.ndarray


def features_drawn(tree: int, level: int, width: int) -> np.ndarray:
    """(node, feature): the features that the nodes of a level may split on."""
    draw = np.random.default_rng([SEED, tree, level]).random((1 << level, width))
    return np.argsort(draw, axis=1)[:, : ceil(sqrt(width))]


def times_drawn(keys: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    z = keys + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return DRAWN.take((z ^ (z >> np.uint64(31))) >> np.uint64(48))


def bin_ends(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature but the last: between all values of a feature with few, else quantiles."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.array([])] * width
        for batch in batches:
            vectors = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            seen = [s if len(s) > BINS else np.unique(np.append(s, v)) for s, v in zip(seen, vectors.T, strict=True)]
        kept = [s[: BINS + 1].tolist() for s in seen]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(kept, pa.list_(pa.float64()))], names=["feature", "found"])

    found = rows.select("v").mapInArrow(few, "feature int, found array<double>").select("feature", F.explode("found").alias("value")).distinct()
    listed = {r["feature"]: np.sort(r["all"]) for r in found.groupBy("feature").agg(F.collect_list("value").alias("all")).collect()}
    shares = [k / BINS for k in range(1, BINS)]
    quantiles = rows.agg(*[F.percentile_approx(F.col("v")[k], shares, 10_000).alias(f"f{k}") for k in range(width)]).first()
    return [
        (listed[k][:-1] + listed[k][1:]) / 2 if len(listed[k]) <= BINS else np.unique(np.array(quantiles[k], float))
        for k in range(width)
    ]


def binned(rows: DataFrame, ends: Sequence[np.ndarray], tasks: int) -> DataFrame:
    """(fold, label, key, bins), written."""
    width = len(ends)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            bins = np.stack([np.searchsorted(e, vectors[:, k]) for k, e in enumerate(ends)], axis=1).astype(np.uint8)
            column = pa.array([b.tobytes() for b in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], column], names=["fold", "label", "key", "bins"])

    return cut_lineage(rows.mapInArrow(placed, "fold int, label int, key bigint, bins binary").repartition(tasks))


def block(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """Folds, labels, keys and bins (one row after the other) of a task's rows, ``MOST_ROWS`` on average at most."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return None
    fold, label, key = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
    bins = np.frombuffer(b"".join(x for b in held for x in b.column(3).to_pylist()), np.uint8)
    return fold, label.astype(np.intp), key.view(np.uint64), bins


def best_splits(counts: np.ndarray, drawn: np.ndarray, weights: np.ndarray) -> Split:
    """The best split of every node by Gini; ``counts`` are (drawn feature, node, bin, class). END: none gains."""
    left = [np.cumsum(np.ascontiguousarray(counts[..., c], float), axis=2) for c in (0, 1)]
    whole = [sums[0, :, -1] for sums in left]

    def pure(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        first, second = first * weights[0], second * weights[1]
        return (first * first + second * second) / np.maximum(first + second, 1e-300)

    left = [sums[:, :, :-1] for sums in left]
    right = [w[None, :, None] - sums for w, sums in zip(whole, left, strict=True)]
    scale = np.maximum(whole[0] * weights[0] + whole[1] * weights[1], 1e-300)
    gain = (pure(*left) + pure(*right) - pure(*whole)[:, None]) / scale[:, None]
    gain[(left[0] + left[1] == 0) | (right[0] + right[1] == 0)] = 0.0
    by_node, every = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1), np.arange(gain.shape[1])
    best = np.argmax(by_node, axis=1)
    place, cut = np.divmod(best, BINS - 1)
    chosen = np.stack([sums[place, every, cut] for sums in left], axis=1)
    return Split(drawn[every, place], np.where(by_node[every, best] > LEAST_GAIN, cut, END), chosen, np.stack(whole, axis=1))


def level_splits(state: DataFrame, grown: Grown, opened: np.ndarray, trees: int, weights: np.ndarray, width: int, tasks: int) -> dict[int, Split]:
    """Tree -> the best splits of its open nodes, from one pass over the rows. Tree t of fold f has the number f * trees + t."""
    level, folds, drawn = len(grown.cut), len(opened) // trees, ceil(sqrt(width))
    grown = Grown(grown.feature, grown.cut, [])  # what tasks need

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = block(batches)
        if whole is None:
            return
        fold, label, keys, bins = whole
        for number in range(trees):
            times = times_drawn(keys, number)
            rows = np.flatnonzero(times)
            of = fold.take(rows)
            for held in range(folds):
                tree = held * trees + number
                if not opened[tree].any():
                    continue
                mine = rows[of != held]
                base = mine * width
                slots = np.where(opened[tree], np.cumsum(opened[tree]) - 1, -1)
                slot = slots.take(grown.reached(tree, bins, base, level))
                if not opened[tree].all():
                    kept = np.flatnonzero(slot >= 0)
                    mine, base, slot = mine.take(kept), base.take(kept), slot.take(kept)
                features = features_drawn(tree, level, width)[opened[tree]]
                size = len(features) * BINS * 2
                place, weight, start = slot * (BINS * 2) + label.take(mine), times.take(mine).astype(float), features.T.copy()
                sums = np.empty((drawn, size))
                for k in range(drawn):
                    found = bins.take(base + start[k].take(slot)).astype(np.intp)
                    found += found
                    found += place
                    sums[k] = np.bincount(found, weight, size)
                sums = sums.astype(np.uint16 if sums.max() < 1 << 16 else np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree]), pa.array([sums.itemsize]), pa.array([sums.tobytes()], pa.binary())], names=["tree", "size", "counts"]
                )

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for tree, size, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(counts, np.uint16 if size == 2 else np.int64).astype(np.int64)
                held[tree] = held[tree] + values if tree in held else values
        for tree, counts in held.items():
            found = best_splits(counts.reshape(drawn, -1, BINS, 2), features_drawn(tree, level, width)[opened[tree]], weights)
            columns = [pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary()) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([tree]), *columns], names=["tree", *Split._fields])

    parts = state.mapInArrow(counted, "tree bigint, size bigint, counts binary")
    parts = parts.repartition("tree") if tasks > 1 else parts  # the counts of one task are whole
    rows = parts.mapInArrow(chosen, "tree bigint, " + ", ".join(f"{c} binary" for c in Split._fields)).collect()
    read = lambda x: np.frombuffer(x, np.int64)
    return {
        r["tree"]: Split(read(r["feature"]), read(r["cut"]), read(r["left"]).reshape(-1, 2), read(r["whole"]).reshape(-1, 2)) for r in rows
    }


def grow(state: DataFrame, folds: int, trees: int, depth: int, weights: np.ndarray, width: int, tasks: int) -> Grown:
    """The trees of all folds, each on the rows of the folds it does not hold out."""
    every = folds * trees
    grown, opened = Grown([], [], [np.zeros((every, 1, 2), np.int64)]), np.ones((every, 1), bool)
    for level in range(depth):
        feature, cut = np.zeros(opened.shape, np.uint8), np.full(opened.shape, END, np.uint8)
        below = np.zeros((every, 2 << level, 2), np.int64)
        found = level_splits(state, grown, opened, trees, weights, width, tasks) if opened.any() else {}
        for tree, split in found.items():
            nodes = np.flatnonzero(opened[tree])
            if not level:
                grown.counts[0][tree] = split.whole
            inner = split.cut != END
            nodes, split = nodes[inner], Split(*(x[inner] for x in split))
            feature[tree, nodes], cut[tree, nodes] = split.feature, split.cut
            below[tree, 2 * nodes], below[tree, 2 * nodes + 1] = split.left, split.whole - split.left
        grown.feature.append(feature)
        grown.cut.append(cut)
        grown.counts.append(below)
        opened = (below > 0).all(axis=2)  # a node of one class is a leaf
    return grown


def held_out_counts(
    state: DataFrame, grown: Grown, folds: int, trees: int, depths: Sequence[int], sizes: Sequence[int], weights: np.ndarray, width: int
) -> dict[tuple[int, int, int], tuple[int, int, int]]:
    """(fold, depth, number of trees) -> hits, wrong and missed of the rows held out; one pass for all."""
    shares = [grown.shares(weights, depth) for depth in depths]
    grown = Grown(grown.feature, grown.cut, [])  # what tasks need

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = block(batches)
        if whole is None:
            return
        fold, label, _, bins = whole
        for held in range(folds):
            mine = np.flatnonzero(fold == held)
            base, positive = mine * width, label.take(mine) == 1
            votes = np.zeros((len(depths), len(mine)))
            for number in range(trees):
                tree = held * trees + number
                leaf = grown.reached(tree, bins, base, len(grown.cut))
                for k in range(len(depths)):
                    votes[k] += shares[k][tree].take(leaf)
                if number + 1 in sizes:
                    decided = votes * 2 > number + 1
                    counts = [(d & positive).sum(axis=1) for d in (decided, ~decided)]
                    columns = ([held] * len(depths), depths, [number + 1] * len(depths), counts[0], (decided & ~positive).sum(axis=1), counts[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=names)

    names = ["fold", "depth", "trees", "hits", "wrong", "missed"]
    found = state.mapInArrow(counted, ", ".join(f"{n} bigint" for n in names))
    summed = found.groupBy(*names[:3]).agg(*[F.sum(n).alias(n) for n in names[3:]]).collect()
    return {(r["fold"], r["depth"], r["trees"]): (r["hits"], r["wrong"], r["missed"]) for r in summed}


def forest_counts(
    rows: DataFrame, key: str, label: str, folds: int, depths: Sequence[int], sizes: Sequence[int]
) -> dict[tuple[int, int, int], tuple[int, int, int]]:
    """Counts of the held-out rows by fold, depth and number of trees, from one forest a fold.

    ``rows`` has an id, ``vector``, ``Fold``, the label and ``Weight``, which is one number per class;
    rows without a label are left out.
    """
    known = cut_lineage(
        rows.where(F.col(label).isNotNull()).select(
            F.col("Fold").cast("int").alias("fold"), F.col(label).cast("int").alias("label"),
            F.xxhash64(key).alias("key"), vector_to_array("vector").alias("v"), "Weight",
        )
    )
    sums = known.groupBy("label").agg(F.max("Weight").alias("Weight"), F.count(F.lit(1)).alias("Rows"), F.max(F.size("v")).alias("Width"))
    classes = {r["label"]: r for r in sums.collect()}
    if not classes:
        return {}
    weights = np.array([classes[c]["Weight"] if c in classes else 1.0 for c in (0, 1)])
    count, width = sum(r["Rows"] for r in classes.values()), max(r["Width"] for r in classes.values())
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-count // LEAST_ROWS), max(cores, -(-count // MOST_ROWS)))
    state = binned(known.drop("Weight"), bin_ends(known, width), tasks)
    tasks = state.rdd.getNumPartitions()
    grown = grow(state, folds, max(sizes), max(depths), weights, width, tasks)
    return held_out_counts(state, grown, folds, max(sizes), depths, sizes, weights, width)
