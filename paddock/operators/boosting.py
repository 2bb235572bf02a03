"""Gradient-boosted regression trees for all walk-forward folds at once, and for the whole table with them.

Values become numbers of bins once, cut at quantiles.  Every row keeps one
prediction for each fold it trains, so one job serves the trees of all folds:
tasks sum gradients and counts by (fold, node, feature, bin), and the best
splits are read from these sums alone, whose size doesn't depend on the rows.
A job sums at the deepest nodes only, which the sums of the nodes above follow
from.  The driver keeps some rows and guesses from them how a tree goes on, so
that a job can sum for several levels; a guess that the sums of all rows don't
bear out costs another job, and never changes a split.

So many jobs are only worth their overhead for rows that one task can't hold.
While all cells together are below ``HELD`` bytes, tasks get them as a
broadcast and each grows all trees of one model by itself, in one job.

Rows live in blocks of numpy arrays, spread over the executors and kept in
memory or on their disks.  Every core gets some of a small table; a task takes
many blocks of a large one, one after the other, and hands on one sum.  Blocks
are written to the shared folder every ``CUT`` iterations, so a lost executor
costs some iterations of its blocks.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.functions.scalars import nan_to_null
from paddock.operators.ordering import exact_medians, melt
from paddock.operators.walkforward import running_medians
from paddock.session import cut_lineage, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block, rows that are worth a task, and tasks for a core.
BLOCK, LEAST, WAVES = 16_384, 1_024, 3
#: Rows times models that the driver guesses from, and trees after which it tries again when guesses failed.
GUIDE, RETRY = 131_072, 10
#: Bytes of cells up to which a task holds all of them and grows the trees of one model.
HELD = 64 << 20
#: Bytes of sums that meet on the driver without a step between.
DIRECT = 64 << 20
#: Trees that tasks add to the predictions of kept blocks, and trees between two writes of the blocks, a multiple of it.
PENDING, CUT = 1, 40
MISSING = 255


@dataclass(frozen=True)
class Settings:
    """Fixed values of the fit; a leaf keeps at least ``least_rows`` rows."""

    iterations: int = 600
    step: float = 0.05
    depth: int = 5
    bins: int = 64
    least_rows: int = 20


@dataclass
class Level:
    """A level of one tree per model: feature (-1: no split) and last bin to the left, by (model, node)."""

    feature: np.ndarray
    cut: np.ndarray


#: A block is a dict of arrays.  Rows alike in bins, in the first model that they train and in the fold that they validate have
#: the same predictions, so they are one cell: bins (by feature), first (cells are in this order), own (-1: no fold), count,
#: target (sum of its rows), pred (by model) and held_out (the prediction of its own fold).  Validated rows stay as they
#: are: row_cell and row_target.
Block = dict


def _nodes(bins: np.ndarray, levels: Sequence[Level], model: int) -> np.ndarray:
    """The node that each row is in below the levels; ``bins`` has one row per feature."""
    n = bins.shape[1]
    at, rows, flat = np.zeros(n, np.intp), np.arange(n), bins.reshape(-1)
    for level in levels:
        feature = level.feature[model].astype(np.intp)
        split = feature >= 0
        # No bin is behind the cut of a node without a split.
        cut = np.where(split, level.cut[model], MISSING).astype(np.uint8)
        here = (np.where(split, feature, 0) * n).take(at)
        here += rows
        right = flat.take(here) > cut.take(at)
        at *= 2
        at += right
    return at


def _filled(bins: np.ndarray, fill: np.ndarray) -> np.ndarray:
    return np.where(bins == MISSING, fill.astype(np.uint8)[:, None], bins)


def _sums(block: Block, levels: Sequence[Level], fills: np.ndarray, n_bins: int) -> np.ndarray:
    """Gradients and counts by (model, node, feature, bin), the nodes below ``levels``."""
    models, p = fills.shape
    nodes = 1 << len(levels)
    out = np.zeros((2, models, nodes, p, n_bins))
    for k in range(models):
        n = int(np.searchsorted(block["first"], k, "right"))
        if not n:
            continue
        bins = _filled(block["bins"][:, :n], fills[k])
        count = block["count"][:n]
        gradient = block["pred"][k, :n] * count - block["target"][:n]
        node = _nodes(bins, levels, k) * n_bins
        for j in range(p):
            here = node + bins[j]
            out[0, k, :, j] = np.bincount(here, gradient, nodes * n_bins).reshape(nodes, n_bins)
            out[1, k, :, j] = np.bincount(here, count, nodes * n_bins).reshape(nodes, n_bins)
    return out


def _by_depth(sums: np.ndarray, start: int) -> list[np.ndarray]:
    """The sums of the nodes of each depth from ``start`` to that of ``sums``: a node has the rows of its two children."""
    found = [sums]
    while found[0].shape[2] > 1 << start:
        found.insert(0, found[0][:, :, 0::2] + found[0][:, :, 1::2])
    return found


def _updated(block: Block, levels: Sequence[Level], values: np.ndarray, fills: np.ndarray, own_fills: np.ndarray) -> Block:
    """The block with one more tree in all its predictions."""
    pred, held_out = block["pred"].copy(), block["held_out"].copy()
    for k in range(len(fills)):
        n = int(np.searchsorted(block["first"], k, "right"))
        pred[k, :n] += values[k].take(_nodes(_filled(block["bins"][:, :n], fills[k]), levels, k))
        mine = np.flatnonzero(block["own"] == k)
        if len(mine):
            held_out[mine] += values[k].take(_nodes(_filled(block["bins"][:, mine], own_fills[k]), levels, k))
    return block | {"pred": pred, "held_out": held_out}


def best_splits(sums: np.ndarray, least_rows: int) -> tuple[Level, np.ndarray]:
    """The split of every node that lowers the squared error most, and (gradient, rows) of its two children.

    The first feature and the lowest bin win ties; a node without a useful
    split hands all its rows to its left child.
    """
    left = sums.cumsum(axis=4)
    whole = left[:, :, :, :1, -1:]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
    fit = (left[1] >= least_rows) & (right[1] >= least_rows)
    models, nodes, p, n_bins = gain.shape
    gain = np.where(fit, gain, -np.inf).reshape(models, nodes, -1)
    best = gain.argmax(axis=2)
    # Less than (1e-10)^2 a row, or than rounding can make, is no gain.
    least = np.maximum(1e-20 * whole[1], 1e-13 * whole[0] ** 2 / np.maximum(whole[1], 1.0))[:, :, 0, 0]
    useful = np.take_along_axis(gain, best[:, :, None], 2)[:, :, 0] > least
    level = Level(np.where(useful, best // n_bins, -1), best % n_bins)
    taken = np.take_along_axis(left.reshape(2, models, nodes, -1), best[None, :, :, None], 3)[..., 0]
    all_rows = whole[:, :, :, 0, 0]
    first = np.where(useful, taken, all_rows)
    return level, np.stack([first, all_rows - first], axis=-1).reshape(2, models, 2 * nodes)


def _same(a: Level, b: Level) -> bool:
    """Whether two levels part the rows alike."""
    return bool((a.feature == b.feature).all() and ((a.cut == b.cut) | (a.feature < 0)).all())


def _guessed(
    guide: Block, levels: list[Level], ahead: int, settings: Settings, fills: np.ndarray, n_bins: int, total: int
) -> list[Level]:
    """The levels and up to ``ahead`` that likely follow, never the last, judged by the rows of the guide."""
    least = max(1, round(settings.least_rows * guide["count"].sum() / total))
    out = list(levels)
    while len(out) < min(len(levels) + ahead, settings.depth - 1):
        level, _ = best_splits(_sums(guide, out, fills, n_bins), least)
        if not (level.feature >= 0).any():
            break
        out.append(level)
    return out


def _parted(bins: np.ndarray, node: np.ndarray, level: Level) -> np.ndarray:
    """The nodes of the rows below one more level; a comparison of all rows per split is cheaper than a lookup per row."""
    right = np.zeros(len(node), bool)
    for i, (feature, cut) in enumerate(zip(level.feature[0].tolist(), level.cut[0].tolist())):
        if feature >= 0:
            right |= (node == i) & (bins[feature] > cut)
    return node * 2 + right


def _scored(bins: np.ndarray, base: float, trees: Sequence[tuple[list[Level], np.ndarray]]) -> np.ndarray:
    """Predictions of one model's trees for complete rows; ``bins`` has one row per feature."""
    out = np.full(bins.shape[1], base)
    for levels, values in trees if bins.shape[1] else ():
        node = np.zeros(bins.shape[1], _node_kind(levels))
        for level in levels:
            node = _parted(bins, node, level)
        out += values[0][node]
    return out


def _node_kind(levels: Sequence) -> type:
    return np.uint8 if len(levels) <= 8 else np.int64


def _of_slots(bins: np.ndarray, slot: np.ndarray, slots: int, weights: Sequence[np.ndarray | None], n_bins: int) -> np.ndarray:
    """Sums of each weight (None: 1) by (weight, slot, feature, bin)."""
    out = np.zeros((len(weights), slots, len(bins), n_bins))
    first = slot * n_bins
    for j, own in enumerate(bins):
        here = first + own
        for kind, weight in enumerate(weights):
            out[kind, :, j] = np.bincount(here, weight, slots * n_bins).reshape(slots, n_bins)
    return out


def _smaller(level: Level, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of every child among the smaller ones of the splits (-1: none of them), and these."""
    split = np.flatnonzero(level.feature[0] >= 0)
    rows = children[1, 0].reshape(-1, 2)[split]
    small = 2 * split + (rows[:, 1] < rows[:, 0])
    slot = np.full(children.shape[2], -1, np.intp)
    slot[small] = np.arange(len(split))
    return slot, small


def _below(sums: np.ndarray, small: np.ndarray, of_small: np.ndarray) -> np.ndarray:
    """The sums of all children from those of their parents and of the smaller children: the larger ones have the rest."""
    rest = sums[:, 0, small // 2] - of_small
    rest[0][rest[1] == 0] = 0.0  # no rounding where there are no rows
    out = np.zeros((2, 1, 2 * sums.shape[2], *sums.shape[3:]))
    out[:, 0, 0::2] = sums[:, 0]
    out[:, 0, small], out[:, 0, small ^ 1] = of_small, rest
    return out


def _trees(bins: np.ndarray, count: np.ndarray, target: np.ndarray, base: float, settings: Settings, n_bins: int) -> list[tuple[list[Level], np.ndarray]]:
    """All trees of one model, whose cells are here with their features filled."""
    count = None if (count == 1).all() else count
    pred, kind = np.full(len(target), base), _node_kind(range(settings.depth))
    root = np.zeros(len(target), np.intp)
    at_root = _of_slots(bins, root, 1, [count], n_bins)
    trees: list[tuple[list[Level], np.ndarray]] = []
    for _ in range(settings.iterations):
        gradient = (pred if count is None else pred * count) - target
        node, levels, children = np.zeros(len(target), kind), [], None
        sums = np.stack([_of_slots(bins, root, 1, [gradient], n_bins), at_root])
        while len(levels) < settings.depth:
            if levels:
                slot, small = _smaller(levels[-1], children)
                rows = np.flatnonzero((slot >= 0)[node])
                weights = [gradient[rows], count if count is None else count[rows]]
                sums = _below(sums, small, _of_slots(bins.take(rows, axis=1), slot[node[rows]], len(small), weights, n_bins))
            level, split = best_splits(sums, settings.least_rows)
            if not (level.feature >= 0).any():
                break
            levels.append(level)
            children = split
            node = _parted(bins, node, level)
        if children is None:
            break
        gradients, rows = children
        values = np.where(rows > 0, -settings.step * gradients / np.maximum(rows, 1), 0.0)
        trees.append((levels, values))
        pred += values[0][node]
    return trees


def _gathered(blocks: Sequence[Block]) -> Block:
    """The cells and rows of all blocks in one."""
    starts = np.cumsum([0, *(len(b["count"]) for b in blocks)])
    shifted = [b | {"row_cell": b["row_cell"] + i} for b, i in zip(blocks, starts)]
    return {c: np.concatenate([b[c] for b in shifted], axis=-1) for c in blocks[0]}


def _one_model(
    whole: Block, k: int, base: float, fill: np.ndarray, own_fill: np.ndarray, settings: Settings, n_bins: int
) -> tuple[list[tuple[list[Level], np.ndarray]], np.ndarray, np.ndarray]:
    """Trees of a model, and targets and predictions of the rows that its fold validates."""
    mine = np.flatnonzero(whole["first"] <= k)
    trees = []
    if len(mine):
        trees = _trees(_filled(whole["bins"][:, mine], fill), whole["count"][mine], whole["target"][mine], base, settings, n_bins)
    rows = np.flatnonzero(whole["own"][whole["row_cell"]] == k)
    cells, cell = np.unique(whole["row_cell"][rows], return_inverse=True)
    pred = _scored(_filled(whole["bins"][:, cells], own_fill), base, trees)
    return trees, whole["row_target"][rows], pred[cell.reshape(-1)]


def _thinned(block: Block, start: int, step: int) -> Block:
    """Every ``step``-th cell of a block, without its rows."""
    return {c: np.ascontiguousarray(v[..., start % step :: step]) for c, v in block.items() if not c.startswith("row_")}


def _joined(blocks: Sequence[Block]) -> Block:
    """The cells of the blocks in one."""
    whole = {c: np.concatenate([b[c] for b in blocks], axis=-1) for c in blocks[0]}
    order = np.argsort(whole["first"], kind="stable")
    return {c: np.ascontiguousarray(v[..., order]) for c, v in whole.items()}


@dataclass
class Forest:
    """Trees of one model: features, last bins to the left and values of all trees, and the upper edges of bins."""

    base: float
    edges: list[np.ndarray]
    trees: list[tuple[list[Level], np.ndarray]]

    def score(self, values: np.ndarray) -> np.ndarray:
        """Predictions for complete rows of feature values."""
        bins = np.stack([np.searchsorted(e, values[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)
        return _scored(bins, self.base, self.trees)


@dataclass
class Fit:
    """``validation``: (event_key, target, pred) of the folds' rows; ``forest``: the model of the whole table."""

    validation: DataFrame
    forest: Forest


def _edges(train: DataFrame, features: Sequence[str], n_bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each feature but the last: quantiles, from the least value on; one row of bounded size."""
    shares = [i / n_bins for i in range(n_bins - 1)]
    cuts = [F.percentile_approx(nan_to_null(F.col(c).cast("double")), shares, 100 * n_bins).alias(c) for c in features]
    row = train.agg(*cuts).first()
    return [np.unique(np.array(row[c] or [], float)) for c in features]


def _fills(medians: DataFrame, keys: Sequence[int], features: Sequence[str], edges: list[np.ndarray]) -> np.ndarray:
    """Bin of the median of every feature by key, that of 0 where there is none; as many rows as folds times features."""
    known = {(r["event_key"], r["name"]): r["median"] for r in medians.collect()}
    found = [[np.searchsorted(e, known.get((k, c), 0.0), "left") for c, e in zip(features, edges)] for k in keys]
    return np.array(found, np.int64).reshape(len(keys), len(features))


def _blocks(train: DataFrame, features: Sequence[str], folds: np.ndarray, edges: list[np.ndarray], base: np.ndarray) -> RDD:
    """The rows as blocks; they train every fold behind their event, and the last model in any case."""
    return _cells(train, features, folds, edges).map(lambda block: _begun(block, base))


def _begun(block: Block, base: np.ndarray) -> Block:
    """The block with the predictions before the first tree."""
    own = block["own"]
    held_out = np.where(own >= 0, base[np.minimum(own, len(base) - 1)], 0.0)
    return block | {"pred": np.repeat(base[:, None], len(own), axis=1), "held_out": held_out}


def _cells(train: DataFrame, features: Sequence[str], folds: np.ndarray, edges: list[np.ndarray]) -> RDD:
    """The rows as blocks without predictions."""

    def pack(rows: list[pd.DataFrame]) -> pa.RecordBatch:
        table = pd.concat(rows)
        event = table["event_key"].to_numpy(dtype=np.int64, na_value=np.iinfo(np.int64).max)
        first = np.searchsorted(folds, event, "right")
        own = np.where(np.isin(event, folds), np.searchsorted(folds, event), -1)
        values = table[list(features)].to_numpy(dtype=float, na_value=np.nan)
        bins = np.stack([np.searchsorted(e, values[:, j], "left") for j, e in enumerate(edges)])
        bins[np.isnan(values).T] = MISSING
        cells, cell = np.unique(np.vstack([first, own, bins]).astype(np.int32), axis=1, return_inverse=True)
        cell, target = cell.reshape(-1), table["target"].to_numpy(dtype=float)
        n = cells.shape[1]
        block = {
            "bins": cells[2:].astype(np.uint8),
            "first": cells[0],
            "own": cells[1],
            "count": np.bincount(cell, minlength=n).astype(float),
            "target": np.bincount(cell, target, n),
            "row_cell": cell[own >= 0].astype(np.int32),
            "row_target": target[own >= 0],
        }
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.to_pandas())
            n += len(held[-1])
            if n >= BLOCK:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    rows, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-rows // LEAST), cores), min(-(-rows // BLOCK), WAVES * cores))
    packed = train.select("event_key", "target", *features).repartition(parts).mapInArrow(run, "block binary")
    return packed.rdd.map(lambda r: pickle.loads(r["block"]))


def _fit_in_tasks(
    spark: SparkSession, cells: RDD, keys: np.ndarray, base: np.ndarray, fills: np.ndarray, own_fills: np.ndarray, settings: Settings, n_bins: int
) -> tuple[DataFrame, list[tuple[list[Level], np.ndarray]]]:
    """The validation of the folds and the trees of the last model, a task per model."""
    models, names = len(base), keys.tolist()
    whole = spark.sparkContext.broadcast(_gathered(cells.collect()))  # at most HELD bytes

    def grown(k: int) -> tuple:
        trees, target, held_out = _one_model(whole.value, k, float(base[k]), fills[k], own_fills[k], settings, n_bins)
        return k, trees if k == models - 1 else None, target, held_out

    def results(model: tuple) -> Iterator[tuple[int, float, float]]:
        k, _, target, held_out = model
        return ((names[k], t, p) for t, p in zip(target.tolist(), held_out.tolist()))

    # Later folds have more rows, and go first.
    found = spark.sparkContext.parallelize(range(models - 1, -1, -1), models).map(grown).persist(StorageLevel.MEMORY_AND_DISK)
    validation = spark.createDataFrame(found.flatMap(results), "event_key int, target double, pred double")
    validation = cut_lineage(validation, "validation")
    last_trees = found.first()[1]
    found.unpersist()
    whole.destroy()
    return validation, last_trees


def fit(train: DataFrame, features: Sequence[str], folds: Sequence[int] = (), settings: Settings = Settings()) -> Fit:
    """Fit a model for each fold (an event, trained on the rows before it) and one on all labelled rows.

    ``train`` has event_key, target and the features.  Missing features are
    filled with the median of the fold's rows, those of a validated event with
    its own; a feature without any value is 0.  Rows without event train only
    the last model.
    """
    spark, context = train.sparkSession, train.sparkSession.sparkContext
    features, keys = list(features), np.array(sorted(folds), np.int64)
    train = cut_lineage(train.where("target IS NOT NULL").select("event_key", F.col("target").cast("double"), *features), "boost")
    edges = _edges(train, features, settings.bins)
    models = len(keys) + 1

    whole = train.withColumn("event_key", F.lit(0))
    last = _fills(exact_medians(melt(whole, ["event_key"], features), ["event_key", "name"]), [0], features, edges)
    fills, own_fills = last, last
    if len(keys):
        listed = spark.createDataFrame([(int(k),) for k in keys], "event_key int")
        fills = np.concatenate([_fills(running_medians(melt(train, ["event_key"], features), listed), keys, features, edges), last])
        validated = melt(train.join(listed, "event_key", "left_semi"), ["event_key"], features)
        own_fills = np.concatenate([_fills(exact_medians(validated, ["event_key", "name"]), keys, features, edges), last])

    # Mean target of each model's rows, from one row per event.
    per_event = train.groupBy("event_key").agg(F.sum("target").alias("s"), F.count("target").alias("n")).collect()
    base = np.zeros(models)
    for k in range(models):
        rows = [r for r in per_event if k == models - 1 or (r["event_key"] is not None and r["event_key"] < keys[k])]
        base[k] = sum(r["s"] for r in rows) / max(1, sum(r["n"] for r in rows))

    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    n_bins = max([len(e) for e in edges], default=0) + 1
    cells = _cells(train, features, keys, edges).persist(StorageLevel.MEMORY_AND_DISK)
    if 0 < cells.map(lambda b: sum(v.nbytes for v in b.values())).sum() <= HELD:
        validation, last_trees = _fit_in_tasks(train.sparkSession, cells, keys, base, fills, own_fills, settings, n_bins)
        cells.unpersist()
        return Fit(validation, Forest(float(base[-1]), edges, last_trees))

    blocks = cells.map(lambda b: _begun(b, base)).persist(StorageLevel.MEMORY_AND_DISK)
    parts = blocks.getNumPartitions()

    pending: list[tuple[list[Level], np.ndarray]] = []

    def grown(block: Block, new: list[tuple[list[Level], np.ndarray]]) -> Block:
        for levels, values in new:
            block = _updated(block, levels, values, fills, own_fills)
        return block

    def summed(levels: list[Level]) -> np.ndarray:
        new = list(pending)

        def whole(mine: Iterator[Block]) -> Iterator[np.ndarray]:
            out = None
            for block in mine:
                sums = _sums(grown(block, new), levels, fills, n_bins)
                out = sums if out is None else out + sums
            if out is not None:
                yield out

        size = 16 * models * (1 << len(levels)) * len(features) * n_bins
        sums = blocks.mapPartitions(whole)
        return sum(sums.collect()) if parts * size <= DIRECT else sums.treeReduce(np.add)

    total = sum(r["n"] for r in per_event)
    step = max(1, -(-blocks.map(lambda b: len(b["count"])).sum() * models // GUIDE))

    def spread(part: int, mine: Iterator[Block]) -> Iterator[Block]:
        return (_thinned(block, part + i, step) for i, block in enumerate(mine))

    guide = _joined(blocks.mapPartitionsWithIndex(spread).collect()) if total else None
    cells.unpersist()
    trees: list[tuple[list[Level], np.ndarray]] = []
    before, reach = None, 0
    for i in range(settings.iterations if total else 0):
        levels, children, more = [], None, True
        ahead = reach if i % RETRY else settings.depth
        while more and len(levels) < settings.depth:
            likely = _guessed(guide, levels, ahead, settings, fills, n_bins, total)
            start = len(levels)
            sums = summed(likely)
            if before is not None:
                before.unpersist()  # the new blocks are in place
                before = None
            for depth, at_depth in enumerate(_by_depth(sums, start), start):
                level, split = best_splits(at_depth, settings.least_rows)
                if more := bool((level.feature >= 0).any()):
                    levels.append(level)
                    children = split
                if not more or depth == len(likely) or not _same(level, likely[depth]):
                    break
            # As far as guesses held, and one level more; none if none held.
            ahead = depth - start + 1 if depth > start else 0
            reach = reach if start else ahead
        if children is None:
            break
        gradient, rows = children
        values = np.where(rows > 0, -settings.step * gradient / np.maximum(rows, 1), 0.0)
        # A model whose first split brings nothing is done: its mean gradient is 0 up to rounding.
        values[levels[0].feature[:, 0] < 0] = 0.0
        trees.append((levels, values))
        pending.append((levels, values))
        guide = _updated(guide, levels, values, fills, own_fills)
        if len(pending) == PENDING:
            before, blocks = blocks, blocks.map(lambda b, new=pending: grown(b, new)).persist(StorageLevel.MEMORY_AND_DISK)
            pending = []
            if len(trees) % CUT == 0:
                blocks.checkpoint()

    def results(block: Block) -> Iterator[tuple[int, float, float]]:
        last = grown(block, pending)
        cell = last["row_cell"]
        return zip(keys[last["own"][cell]].tolist(), last["row_target"].tolist(), last["held_out"][cell].tolist())

    validation = spark.createDataFrame(blocks.flatMap(results), "event_key int, target double, pred double")
    validation = cut_lineage(validation, "validation")
    blocks.unpersist()
    if before is not None:
        before.unpersist()
    one = [([Level(level.feature[-1:], level.cut[-1:]) for level in levels], values[-1:]) for levels, values in trees]
    return Fit(validation, Forest(float(base[-1]), edges, one))


def score(forest: Forest, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows, whose features are complete, with ``pred``."""
    names = list(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            yield batch.append_column("pred", pa.array(forest.score(values), pa.float64()))

    rows = rows.drop("pred").withColumns({c: F.col(c).cast("double") for c in names})
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("pred", T.DoubleType())]))
