"""One-parameter sweeps of a prediction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.experiments import run_scores


def sweep_predictions(
    predict: Callable[..., DataFrame], base: dict[str, object], param: str, values: Sequence[object]
) -> DataFrame:
    """Predictions for every value of one parameter, tagged with the value; other parameters stay."""
    tagged = [
        predict(**{**base, param: value}).withColumn("param_value", F.lit(str(value))) for value in values
    ]
    return reduce(DataFrame.unionByName, tagged)


def sweep_scores(predictions: DataFrame) -> DataFrame:
    """Mean prediction per swept value."""
    return run_scores(predictions, key="param_value")
