"""Candidate models, their walk-forward scores and the choice between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from importlib.util import find_spec

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.scalars import row_mean
from paddock.operators import boosting
from paddock.operators.ordering import impute_medians
from paddock.operators.walkforward import (
    fit_ridge,
    fold_errors,
    fold_predictions,
    linear_score,
    mean_of_folds,
)

# Fixed value: penalty of the ridge weights.
RIDGE_ALPHA = 1.0


@dataclass(frozen=True)
class Candidate:
    """A model by name; a smaller priority wins when scores are equal."""

    name: str
    priority: int
    errors: Callable[[DataFrame, Sequence[str], DataFrame], DataFrame]
    predict: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]


def _one_group(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A frame imputed with its own medians."""
    return impute_medians(df.withColumn("_all", F.lit(0)), ["_all"], features).drop("_all")


# -- ridge -------------------------------------------------------------------


def ridge_errors(train: DataFrame, features: Sequence[str], folds: DataFrame) -> DataFrame:
    return fold_errors(fold_predictions(train, features, folds, RIDGE_ALPHA))


def ridge_predict(train: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    model = fit_ridge(train, features, RIDGE_ALPHA)
    # The model is one row, read as a scalar subquery.
    row = model.select(F.struct("intercept", "weights")).scalar()
    filled = _one_group(current, features).withColumn("_model", row)
    score = linear_score(features, F.col("_model.intercept"), F.col("_model.weights"))
    return filled.withColumn("pred", score).drop("_model")


# -- boosted trees -----------------------------------------------------------


class BoostedTrees:
    """Trees for all folds and for the whole table from one fit, which the prediction uses if it is of the same table."""

    def __init__(self, settings: boosting.Settings = boosting.Settings()):
        self.settings = settings
        self._known: tuple | None = None

    def _fit(self, train: DataFrame, features: Sequence[str], folds: Sequence[int]) -> boosting.Fit:
        found = boosting.fit(train, features, folds, self.settings)
        self._known = (train, list(features), found)
        return found

    def errors(self, train: DataFrame, features: Sequence[str], folds: DataFrame) -> DataFrame:
        # The list of folds is as long as the calendar.
        return fold_errors(self._fit(train, features, [r["event_key"] for r in folds.collect()]).validation)

    def predict(self, train: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
        same = self._known is not None and self._known[0] is train and self._known[1] == list(features)
        found = self._known[2] if same else self._fit(train, features, ())
        return boosting.score(found.forest, _one_group(current, features), features)


def _library(train: DataFrame, current: DataFrame, features: Sequence[str], regressor) -> DataFrame:
    pack = VectorAssembler(inputCols=list(features), outputCol="_x")
    labelled = _one_group(train, features).where("target is not null")
    model = regressor.fit(pack.transform(labelled.select(*features, "target")))
    scored = model.transform(pack.transform(_one_group(current, features)))
    return scored.withColumnRenamed("_y", "pred").drop("_x")


def _per_fold(train: DataFrame, features: Sequence[str], folds: DataFrame, regressor) -> DataFrame:
    """One distributed fit per fold; the fold list is as long as the calendar."""
    keys = [r["event_key"] for r in folds.orderBy("event_key").collect()]
    scored = [
        _library(train.where(F.col("event_key") < k), train.where(F.col("event_key") == k), features, regressor)
        for k in keys
    ]
    return fold_errors(reduce(DataFrame.unionByName, scored).select("event_key", "target", "pred"))


def _tree_candidate(name: str, priority: int, make: Callable[[], object]) -> Candidate:
    return Candidate(
        name,
        priority,
        lambda train, features, folds: _per_fold(train, features, folds, make()),
        lambda train, current, features: _library(train, current, features, make()),
    )


def _xgboost():
    from xgboost.spark import SparkXGBRegressor

    return SparkXGBRegressor(
        features_col="_x",
        label_col="target",
        prediction_col="_y",
        n_estimators=400,
        learning_rate=0.05,
        max_depth=5,
        subsample=0.9,
        colsample_bytree=0.9,
        random_state=42,
    )


def candidates(iterations: int = boosting.Settings.iterations) -> list[Candidate]:
    """Known models in priority order; one whose library is missing is left out."""
    found = []
    if find_spec("xgboost") is not None:
        found.append(_tree_candidate("xgboost", 0, _xgboost))
    trees = BoostedTrees(boosting.Settings(iterations=iterations))
    found.append(Candidate("hist_gradient_boosting", 1, trees.errors, trees.predict))
    found.append(Candidate("ridge", 2, ridge_errors, ridge_predict))
    return found


# -- choice ------------------------------------------------------------------


def leaderboard(
    train: DataFrame, features: Sequence[str], folds: DataFrame, models: Sequence[Candidate]
) -> DataFrame:
    """Walk-forward score of every candidate that has one, best first."""
    scores = [
        mean_of_folds(m.errors(train, features, folds)).select(
            F.lit(m.name).alias("name"), F.lit(m.priority).alias("priority"), "mae", "folds"
        )
        for m in models
    ]
    return reduce(DataFrame.unionByName, scores).where("mae is not null").orderBy("mae", "priority")


def best_model(board: DataFrame) -> DataFrame:
    """The candidate with the smallest score, the earlier priority on ties."""
    first = F.min_by(F.struct("name", "mae"), F.struct("mae", "priority"))
    return board.agg(first.alias("best")).select("best.name", "best.mae")


# -- heuristic ---------------------------------------------------------------


def heuristic(
    features: DataFrame, group: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Mean of the fallback columns, each filled with the median of its group; 0 without any value."""
    copies = [f"_{c}" for c in columns]
    doubled = features.withColumns({f"_{c}": F.col(c) for c in columns})
    filled = impute_medians(doubled, group, copies)
    pred = F.coalesce(row_mean([F.col(c) for c in copies]), F.lit(0.0))
    return filled.withColumn("pred", pred).drop(*copies)
