"""Accuracy and ranking metrics of predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.operators.ordering import attach, first_places, totals_before, with_average_rank

TOP = 10


def mean_absolute_error(df: DataFrame, group: Sequence[str] = (), truth: str = "target", pred: str = "pred") -> DataFrame:
    return df.groupBy(*group).agg(F.avg(F.abs(F.col(truth) - F.col(pred))).alias("mae"))


def spearman(
    df: DataFrame, group: Sequence[str], truth: str = "target", pred: str = "pred"
) -> DataFrame:
    """Correlation of the average ranks of truth and prediction, per group."""
    both = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    ranked = with_average_rank(both, group, truth, "_truth_rank")
    ranked = with_average_rank(ranked, group, pred, "_pred_rank")
    # Twice a rank is a whole number, so the sums are exact in any order.
    x, y = (F.col("_truth_rank") * 2).cast("decimal(19,0)"), (F.col("_pred_rank") * 2).cast("decimal(19,0)")
    sums = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(x).cast("double").alias("sx"),
        F.sum(y).cast("double").alias("sy"),
        F.sum(x * x).cast("double").alias("sxx"),
        F.sum(y * y).cast("double").alias("syy"),
        F.sum(x * y).cast("double").alias("sxy"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = F.sqrt((n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy))
    return sums.select(*group, ((n * F.col("sxy") - sx * sy) / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def top_overlap(
    df: DataFrame, group: Sequence[str], row_id: Sequence[str], truth: str = "target", pred: str = "pred", n: int = TOP
) -> DataFrame:
    """Rows among both the first ``n`` by prediction and the first ``n`` by truth."""
    keys = [*group, *row_id]
    by_pred = first_places(df.where(F.col(pred).isNotNull()), group, [F.col(pred), *map(F.col, row_id)], n, "_p")
    by_truth = first_places(df.where(F.col(truth).isNotNull()), group, [F.col(truth), *map(F.col, row_id)], n, "_t")
    return by_pred.select(*keys).intersect(by_truth.select(*keys))


def top_hit_rate(
    df: DataFrame, group: Sequence[str], row_id: Sequence[str], truth: str = "target", pred: str = "pred", n: int = TOP
) -> DataFrame:
    """Overlap of the two top lists divided by ``n``, whatever the size of the group; 0 without truth."""
    hits = top_overlap(df, group, row_id, truth, pred, n).groupBy(*group).agg(F.count(F.lit(1)).alias("_hits"))
    groups = df.select(*group).distinct()
    rate = F.coalesce(F.col("_hits"), F.lit(0)) / F.lit(n)
    return groups.join(hits, list(group), "left").select(*group, rate.alias("hit_rate"))


def summary_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, mean, smallest, greatest and range."""
    x = F.col(value)
    return df.groupBy(*group).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"),
    )


def ndcg(graded: DataFrame, group: Sequence[str], n: int = 10, pred: str = "pred", target: str = "target") -> DataFrame:
    """Discounted gain of the first ``n`` by prediction over that of the best order, per group; null without any gain.

    A place is worth ``n + 1`` less the finishing position, or nothing; place
    ``r`` is discounted by log2(r + 1).  Rows of equal prediction share the mean
    discount of their places.
    """
    sums = [0.0]
    for r in range(1, n + 1):
        sums.append(sums[-1] + 1 / math.log2(r + 1))
    upto = F.array(*[F.lit(x) for x in sums])

    def discount(before: Column, ties: Column) -> Column:
        first, last = F.least(before, F.lit(n)), F.least(before + ties, F.lit(n))
        return (F.get(upto, last.cast("int")) - F.get(upto, first.cast("int"))) / ties

    gain = F.greatest(F.lit(n + 1) - F.col(target), F.lit(0)).cast("double")
    rows = graded.where(F.col(target).isNotNull() & F.col(pred).isNotNull())
    # What has no gain adds nothing, wherever it stands; predictions are counted before any join.
    counts = rows.groupBy(*group, pred).agg(F.count(F.lit(1)).alias("ties"), F.sum(gain).alias("_gain"))
    placed = totals_before(counts, list(group), pred, "ties")
    found = placed.groupBy(*group).agg(F.sum(F.col("_gain") * discount(F.col("before"), F.col("ties"))).alias("_found"))
    best = rows.groupBy(*group, (-gain).alias("_less")).agg(F.count(F.lit(1)).alias("ties"))
    best = totals_before(best, list(group), "_less", "ties", few=True)  # n + 1 gains at most for whole positions
    ideal = best.groupBy(*group).agg(F.sum(-F.col("_less") * F.col("ties") * discount(F.col("before"), F.col("ties"))).alias("_ideal"))
    return found.join(ideal, list(group)).select(*group, (F.col("_found") / F.nullif(F.col("_ideal"), F.lit(0.0))).alias("ndcg"))


def surprises(graded: DataFrame, group: Sequence[str], keys: Sequence[str], n: int = 3, pred: str = "pred", target: str = "target") -> DataFrame:
    """The ``n`` rows of each group whose target is farthest from the prediction, ties by ``keys``; ``gap`` is target less prediction."""
    gap = F.col(target) - F.col(pred)
    known = graded.where(gap.isNotNull()).withColumn("gap", gap)
    return first_places(known, list(group), [F.abs("gap").desc(), *[F.col(k) for k in keys]], n, "place")


def confident_and_wrong(
    df: DataFrame, group: Sequence[str], keys: Sequence[str], n: int = 10, sure: float = 0.8, p: str = "p", outcome: str = "outcome"
) -> DataFrame:
    """The ``n`` rows of each group that were predicted at ``sure`` or more and came out otherwise, the surest first."""
    chance = F.when(F.col(outcome) == 1, 1 - F.col(p)).otherwise(F.col(p))
    wrong = df.where(F.col(outcome).isNotNull()).withColumn("missed", chance).where(F.col("missed") >= sure)
    return first_places(wrong, list(group), [F.col("missed").desc(), *[F.col(k) for k in keys]], n, "place")


def baseline_gap(graded: DataFrame, group: Sequence[str], pred: str = "pred", target: str = "target") -> DataFrame:
    """Error of the predictions, that of the group's mean target for every row, and by how much it is larger."""
    known = graded.where(F.col(target).isNotNull() & F.col(pred).isNotNull())
    # One row a group; a hot group's rows meet its mean by a broadcast or a split join.
    means = known.groupBy(*group).agg(F.avg(target).alias("_mean"))
    errors = attach(known, means, list(group), "inner").groupBy(*group).agg(
        F.avg(F.abs(F.col(target) - F.col(pred))).alias("mae"), F.avg(F.abs(F.col(target) - F.col("_mean"))).alias("baseline")
    )
    return errors.withColumn("gap", F.col("baseline") - F.col("mae"))

