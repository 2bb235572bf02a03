"""Ridge regression for every walk-forward fold in one job.

A fold trains on all events before its validation event, so copying rows into
folds would multiply the table by the number of events.  Instead each event is
reduced once to the second moments of its rows, and a fold's normal equations
are the running sum of those moments over the earlier events.

Missing features are replaced by the median of the fold, which differs from
fold to fold.  With ``v`` the value or 0 and ``u`` the missing flag, an imputed
feature is ``v + median * u``: linear in (v, u), so the moments of (v, u, target, 1)
give the moments of the imputed features for any medians.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.ordering import attach, exact_medians, impute_medians, melt, totals_before

# Tasks get the functions themselves, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Events whose moments one task holds before it hands them on.
EVENTS_IN_TASK = 4096
# Ranges in which the values of a feature are counted; a fold reads the values of one or two of them.
RANGES = 1024


def event_moments(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per event, the sums of products of (values, missing flags, target, 1), flattened row by row."""
    names = list(features)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}

        def drain() -> pd.DataFrame:
            out = pd.DataFrame(
                {"event_key": list(sums), "moments": [m.ravel() for m in sums.values()]}
            ).astype({"event_key": "int32"})
            sums.clear()
            return out

        for batch in batches:
            batch = batch.sort_values("event_key", kind="stable")
            values = batch[names].to_numpy(dtype=float, na_value=np.nan)
            missing = np.isnan(values)
            rest = np.column_stack([batch["target"].to_numpy(dtype=float), np.ones(len(batch))])
            rows = np.hstack([np.where(missing, 0.0, values), missing, rest])
            keys, starts = np.unique(batch["event_key"].to_numpy(), return_index=True)
            for key, block in zip(keys, np.split(rows, starts[1:])):
                sums[int(key)] = sums.get(int(key), 0.0) + block.T @ block
            if len(sums) >= EVENTS_IN_TASK:
                yield drain()
        if sums:
            yield drain()

    labelled = train.where("target is not null and event_key is not null").select("event_key", "target", *names)
    parts = labelled.mapInPandas(partial, "event_key int, moments array<double>")
    return parts.select("event_key", F.posexplode("moments").alias("pos", "part")).groupBy("event_key", "pos").agg(
        F.sum("part").alias("own")
    )


def _counts_before_folds(counts: DataFrame, folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of ``n`` over the events before each fold, per key.

    The running sum of a key changes only at its own events, so each state is
    written out for the folds up to the key's next event: one output row per
    fold and key, rather than one per fold and earlier event.  The list of
    folds is as long as the calendar.
    """
    fold_list = folds.agg(F.array_sort(F.collect_list("event_key"))).scalar()
    by_event = Window.partitionBy(*by).orderBy("event_key")
    states = counts.select(
        *by,
        F.sum("n").over(by_event.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
        F.col("event_key").alias("_after"),
        F.lead("event_key").over(by_event).alias("_until"),
    ).withColumn("_folds", fold_list)
    after, until = F.col("_after"), F.col("_until")
    valid = F.filter("_folds", lambda fold: (fold > after) & (until.isNull() | (fold <= until)))
    return states.select(*by, "n", F.explode(valid).alias("_fold"))


def _numbered(long: DataFrame, ranges: int) -> DataFrame:
    """The rows with the number of the range of their feature's values in ``_range``; equal values share one.

    Ranges end at quantiles of all rows.  Their ends, so many per feature, are
    one small row each; a value is placed by halving the list of ends.
    """
    shares = [i / ranges for i in range(1, ranges)]
    ends = long.groupBy("name").agg(F.percentile_approx("value", shares, 10 * ranges).alias("ends")).collect()
    if not ends:
        return long.withColumn("_range", F.lit(0))
    listed = F.create_map(*[F.lit(x) for r in ends for x in (r["name"], sorted(set(r["ends"])))])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((ranges - 1).bit_length()))])

    def place(own: Column) -> Column:
        def further(at: Column, step: Column) -> Column:
            return F.when(F.get(own, at + step - 1) < F.col("value"), at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), further)

    # A lambda's argument is computed once, however often the lambda reads it.
    return long.withColumn("_range", F.get(F.transform(F.array(F.element_at(listed, F.col("name"))), place), F.lit(0)))


def running_medians(long: DataFrame, folds: DataFrame) -> DataFrame:
    """Exact median of every feature over all events before each fold.

    ``long`` has (event_key, name, value) and is read three times.  Values are
    counted by event and range; these counts alone, which don't grow with the
    rows, say which range holds the middle of a fold, and only the values of
    that range meet the fold.
    """
    placed = _numbered(long.where(F.col("event_key").isNotNull()), RANGES)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    sizes = placed.groupBy("event_key", "name", "_range").agg(F.count(F.lit(1)).alias("n"))
    per_fold = _counts_before_folds(sizes, folds, ["name", "_range"])
    ranges = totals_before(per_fold, ["_fold", "name"], "_range", "n", out="_first", total="_n", few=True)
    middle = ranges.where((F.col("_first") < high) & (F.col("_first") + F.col("n") >= low))
    # At most two ranges per fold and feature.
    chosen = middle.select("_fold", "name", "_range", F.col("_first").alias("_start"), "_n")
    group = ["_fold", "name", "_range"]
    values = (
        placed.join(F.broadcast(chosen), ["name", "_range"])
        .where("event_key < _fold")
        .groupBy(*group, "_start", "_n", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    exact = totals_before(values, group, "value", "n", few=True)
    first = F.col("_start") + F.col("before")

    def at(place):
        return F.max(F.when((first < place) & (place <= first + F.col("n")), F.col("value")))

    return exact.groupBy("_fold", "name").agg((at(low) / 2 + at(high) / 2).alias("median")).withColumnRenamed(
        "_fold", "event_key"
    )


def _median_arrays(medians: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per event with the medians in feature order, 0 for an all-null feature."""
    picks = [F.coalesce(F.max(F.when(F.col("name") == c, F.col("median"))), F.lit(0.0)) for c in features]
    return medians.groupBy("event_key").agg(F.array(*picks).alias("medians"))


def solve_ridge(moments: np.ndarray, medians: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights with the penalty on the weights only."""
    p = len(medians)
    to_features = np.hstack([np.eye(p), np.diag(medians)])
    n = moments[-1, -1]
    gram = to_features @ moments[: 2 * p, : 2 * p] @ to_features.T
    cross = to_features @ moments[: 2 * p, -2]
    mean_x = to_features @ moments[: 2 * p, -1] / n
    mean_y = moments[-2, -1] / n
    weights = np.linalg.solve(gram - n * np.outer(mean_x, mean_x) + alpha * np.eye(p), cross - n * mean_y * mean_x)
    return float(mean_y - mean_x @ weights), weights


def _solve(sums: DataFrame, medians: DataFrame, features: Sequence[str], alpha: float) -> DataFrame:
    """Coefficients per event from (event_key, pos, total) and the medians used in training, 0 where there is none."""
    side = 2 * len(features) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            solved = [
                solve_ridge(np.asarray(m, dtype=float).reshape(side, side), np.asarray(d, dtype=float), alpha)
                for m, d in zip(batch["moments"], batch["medians"])
            ]
            yield pd.DataFrame(
                {
                    "event_key": batch["event_key"],
                    "intercept": [s[0] for s in solved],
                    "weights": [s[1] for s in solved],
                }
            )

    # (2p+2)^2 numbers per event.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda s: s["total"])
    zeros = F.array(*[F.lit(0.0)] * len(features))
    packed = (
        sums.groupBy("event_key")
        .agg(ordered.alias("moments"))
        .join(_median_arrays(medians, features), "event_key", "left")
        .withColumn("medians", F.coalesce("medians", zeros))
    )
    return packed.mapInPandas(run, "event_key int, intercept double, weights array<double>")


def fold_coefficients(train: DataFrame, features: Sequence[str], folds: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Ridge coefficients for every fold, trained on all events before it."""
    before = Window.partitionBy("pos").orderBy("event_key").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        event_moments(train, features)
        .withColumn("total", F.sum("own").over(before))
        .where("total is not null")
        .join(folds, "event_key", "left_semi")
        .select("event_key", "pos", "total")
    )
    medians = running_medians(melt(train, ["event_key"], features), folds)
    return _solve(sums, medians, features, alpha)


def fit_ridge(train: DataFrame, features: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """One row (intercept, weights) for the whole training table, medians over all its rows."""
    whole = train.withColumn("event_key", F.lit(0))
    sums = event_moments(whole, features).withColumnRenamed("own", "total")
    medians = exact_medians(melt(whole, ["event_key"], features), ["event_key", "name"])
    return _solve(sums, medians, features, alpha).select("intercept", "weights")


def linear_score(features: Sequence[str], intercept: Column, weights: Column) -> Column:
    """Column expression of a linear prediction."""
    score = intercept
    for i, c in enumerate(features):
        score = score + F.col(c) * F.get(weights, F.lit(i))
    return score


def fold_predictions(
    train: DataFrame, features: Sequence[str], folds: DataFrame, alpha: float = 1.0
) -> DataFrame:
    """Validation rows of every fold with the prediction of the model trained before it.

    A validation event is imputed with its own medians, like any frame that is predicted.
    """
    validation = train.join(folds.select("event_key"), "event_key", "left_semi")
    filled = impute_medians(validation, ["event_key"], features)
    scored = attach(filled, fold_coefficients(train, features, folds, alpha), ["event_key"], "inner")
    return scored.withColumn("pred", linear_score(features, F.col("intercept"), F.col("weights"))).drop("intercept", "weights")


def fold_errors(predictions: DataFrame) -> DataFrame:
    """Mean absolute error of every fold that has labelled rows."""
    return (
        predictions.where("target is not null")
        .groupBy("event_key")
        .agg(F.avg(F.abs(F.col("target") - F.col("pred"))).alias("mae"))
    )


def mean_of_folds(errors: DataFrame) -> DataFrame:
    """Score of a candidate: the plain mean of its fold errors, null without folds."""
    return errors.agg(F.avg("mae").alias("mae"), F.count("mae").alias("folds"))
