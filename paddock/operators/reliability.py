"""How far predicted probabilities, intervals and distributions can be trusted."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.ordering import attach, totals_before, value_ranks
from paddock.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Steps of a calibration that one range takes at least.
STEPS = 1024
#: Probabilities are kept this far from 0 and 1 where a logarithm is taken.
EDGE = 1e-15


# -- probabilities -----------------------------------------------------------


def probability_scores(df: DataFrame, group: Sequence[str], p: str = "p", outcome: str = "outcome") -> DataFrame:
    """Rows, log loss and Brier score of each group; rows without probability or outcome don't count."""
    y, q = F.col(outcome).cast("double"), F.least(F.greatest(F.col(p), F.lit(EDGE)), F.lit(1 - EDGE))
    loss = -(y * F.log(q) + (1 - y) * F.log(1 - q))
    known = df.where(F.col(p).isNotNull() & F.col(outcome).isNotNull())
    return known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(loss).alias("log_loss"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier")
    )


def calibration_table(df: DataFrame, group: Sequence[str], bins: int = 10, p: str = "p", outcome: str = "outcome") -> DataFrame:
    """Mean probability and share of outcomes by bins of equal width, and the expected gap over all rows of the group."""
    known = df.where(F.col(p).isNotNull() & F.col(outcome).isNotNull())
    bin_of = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    table = known.groupBy(*group, bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_p"), F.avg(F.col(outcome).cast("double")).alias("share")
    )
    whole = Window.partitionBy(*group)
    gap = F.sum(F.col("rows") * F.abs(F.col("mean_p") - F.col("share"))).over(whole) / F.sum("rows").over(whole)
    return table.withColumn("expected_gap", gap)


def pooled(low: np.ndarray, high: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent blocks (least score, greatest score, rows, sum of outcomes) pooled until their means ascend."""
    out: list[list] = []
    for block in zip(low.tolist(), high.tolist(), n.tolist(), s.tolist()):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, top, rows, total = out.pop()
            out[-1][1:] = [top, out[-1][2] + rows, out[-1][3] + total]
    columns = list(zip(*out)) or [()] * 4
    return tuple(np.array(c) for c in columns)


def _pooled_ranges(placed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition is one range; blocks are handed on pooled, batch by batch.
        held = number = None
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(4)[0].as_py()
            new = [batch.column(c).to_numpy() for c in range(4)]
            held = pooled(*(new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new)]))
        if number is not None:
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            columns = [*held, np.full(len(held[0]), number)]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds)], ["low", "high", "n", "s", "_range"])

    ordered = placed.select("low", "high", "n", "s", F.spark_partition_id().alias("_range"))
    return ordered.mapInArrow(run, "low double, high double, n long, s long, _range int")


def isotonic(df: DataFrame, score: str = "p", outcome: str = "outcome") -> DataFrame:
    """Calibrated probabilities that never fall as the score rises: rows (low, high, n, value), one per step.

    ``outcome`` is 0 or 1.  Equal scores are counted first.  Pooling adjacent
    violators is associative: each range of scores is pooled by itself, then
    its blocks are dealt out in other ranges, until no two neighbours across
    ranges violate the order.
    """
    spark = df.sparkSession
    known = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    counts = known.groupBy(F.col(score).cast("double").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("s"))
    blocks = cut_lineage(counts.select("low", F.col("low").alias("high"), "n", "s"), "scores")
    size, most = blocks.count(), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    turn = 0
    while True:
        # Ranges of other bounds each time; a handful of blocks is one range.
        parts = min(most, -(-size // STEPS)) + (turn % 2 if size > STEPS else 0)
        ranges = blocks.repartitionByRange(max(1, parts), "low").sortWithinPartitions("low")
        blocks = cut_lineage(_pooled_ranges(ranges), "pooled")
        ends = blocks.groupBy("_range").agg(F.min_by(F.struct("s", "n"), "low").alias("first"), F.max_by(F.struct("s", "n"), "low").alias("last"))
        after = F.lead("first").over(Window.orderBy("_range"))  # one row a range
        crossing = ends.select("last", after.alias("after")).where("last.s * after.n >= after.s * last.n")
        if crossing.isEmpty():
            break
        left = blocks.count()
        if left == size:  # the bounds fell in the same place
            most = max(1, most // 2)
        size, turn = left, turn + 1
    return blocks.select("low", "high", "n", (F.col("s") / F.col("n")).alias("value"))


# -- intervals ---------------------------------------------------------------


def conformal_widths(residuals: DataFrame, group: Sequence[str], levels: Sequence[float], residual: str = "residual") -> DataFrame:
    """(group, level, width): the ceil((n + 1) * level)-th smallest absolute residual, null where there are too few.

    An interval of that width either side of a new prediction holds the target
    with probability ``level`` at least, if residuals are exchangeable.
    """
    sizes = residuals.where(F.col(residual).isNotNull()).select(*group, F.abs(F.col(residual)).alias("_size"))
    placed = value_ranks(sizes, list(group), "_size", total="_n")
    asked = placed.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    place = F.ceil((F.col("_n") + 1) * F.col("level").cast("decimal(9,6)")).cast("long")
    within = (F.col("before") < place) & (place <= F.col("before") + F.col("ties"))
    return asked.groupBy(*group, "level").agg(F.max(F.when(within, F.col("_size"))).alias("width"))


def with_intervals(predictions: DataFrame, widths: DataFrame, group: Sequence[str], pred: str = "pred") -> DataFrame:
    """Each prediction once a level, with ``low`` and ``high``; open ends where there were too few residuals."""
    joined = predictions.join(widths, list(group)) if group else predictions.crossJoin(F.broadcast(widths))  # a row a level
    wide = F.coalesce("width", F.lit(float("inf")))
    return joined.withColumns({"low": F.col(pred) - wide, "high": F.col(pred) + wide}).drop("width")


# -- distributions -----------------------------------------------------------


def quantile_edges(df: DataFrame, value: str, parts: int) -> DataFrame:
    """One row with ``edges``: the smallest values that at least 1/parts, 2/parts ... of the rows don't exceed."""
    placed = value_ranks(df.select(F.lit(0).alias("_all"), value), ["_all"], value, total="_n")
    last = F.col("before") + F.col("ties")

    def edge(i: int) -> Column:
        place = F.ceil(F.col("_n") * i / parts)
        return F.max(F.when((F.col("before") < place) & (place <= last), F.col(value)))

    return placed.agg(F.array_distinct(F.array(*[edge(i) for i in range(1, parts)])).alias("edges"))


def sketched_edges(df: DataFrame, group: Sequence[str], value: str, parts: int) -> DataFrame:
    """(group, sketch, edges): a mergeable sketch of the values of each group and its quantiles.

    Sketches of groups can be merged with ``kll_merge_agg_double`` without reading rows again.
    """
    sketch = F.call_function("kll_sketch_agg_double", F.col(value).cast("double")).alias("sketch")
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return df.where(F.col(value).isNotNull()).groupBy(*group).agg(sketch).withColumn(
        "edges", F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), shares)
    )


def stability_index(df: DataFrame, period: str, value: str, reference: object, parts: int = 10) -> DataFrame:
    """(period, rows, psi): population stability index of each period against the reference period.

    Bins lie between quantiles of the reference; a share of 0 counts as half a row.
    """
    known = df.where(F.col(value).isNotNull()).select(period, value)
    edges = quantile_edges(known.where(F.col(period) == F.lit(reference)), value, parts).scalar()
    binned = known.withColumn("_edges", edges).withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col(value))))
    counts = cut_lineage(binned.groupBy(period, "bin").agg(F.count(F.lit(1)).alias("n")), "bins")
    all_bins = counts.select("bin").distinct()  # at most ``parts``
    grid = counts.select(period).distinct().join(F.broadcast(all_bins)).join(counts, [period, "bin"], "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    whole = Window.partitionBy(period)
    shares = grid.select(period, "bin", n.alias("_n"), F.sum(n).over(whole).alias("rows")).withColumn(
        "share", F.greatest(F.col("_n"), F.lit(0.5)) / F.col("rows")
    )
    base = shares.where(F.col(period) == F.lit(reference)).select("bin", F.col("share").alias("_base"))
    term = (F.col("share") - F.col("_base")) * F.log(F.col("share") / F.col("_base"))
    return shares.join(base, "bin").groupBy(period).agg(F.max("rows").cast("long").alias("rows"), F.sum(term).alias("psi"))


def largest_gap(df: DataFrame, period: str, value: str, reference: object) -> DataFrame:
    """(period, ks): the greatest distance of the distribution functions of a period and the reference period, exact.

    One running sum serves both: a value adds its count in the reference times
    the rows of the period, and takes off its count in the period times the rows
    of the reference, all in whole numbers.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(period, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts, "counts")
    sizes = counts.groupBy(period).agg(F.sum("n").alias("rows"))  # one row a period
    base = counts.where(F.col(period) == F.lit(reference)).select("_v", F.col("n").alias("_base"))
    base_rows = F.coalesce(sizes.where(F.col(period) == F.lit(reference)).select("rows").scalar(), F.lit(0).cast("long"))
    own = counts.select(period, "_v", F.col("n").alias("_own"), F.lit(0).cast("long").alias("_base"))
    other = sizes.select(period).join(base).select(period, "_v", F.lit(0).cast("long").alias("_own"), "_base")
    both = own.union(other).groupBy(period, "_v").agg(F.sum("_own").alias("_own"), F.sum("_base").alias("_base"))
    wide = "decimal(38,0)"
    step = F.col("_base").cast("decimal(18,0)") * F.col("rows").cast("decimal(18,0)") - F.col("_own").cast("decimal(18,0)") * F.col("_base_rows").cast("decimal(18,0)")
    weighted = attach(both, sizes.withColumn("_base_rows", base_rows), [period], "inner").withColumn("_step", step.cast(wide))
    placed = totals_before(weighted, [period], "_v", "_step")
    gap = F.max(F.abs(F.col("before") + F.col("_step"))).cast("double")
    scale = F.max(F.col("rows").cast("double") * F.col("_base_rows").cast("double"))
    return placed.groupBy(period).agg((gap / F.nullif(scale, F.lit(0.0))).alias("ks"))
