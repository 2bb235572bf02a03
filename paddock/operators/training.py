"""Training frames: targets, joins with earlier results, walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.scalars import event_key
from paddock.operators.ordering import attach
from paddock.schemas import DRIVER, EVENT


def before_target(year: int, round_number: int) -> Column:
    """Keeps rounds that may be trained on: the target season stops before the target round."""
    return ~((F.col("year") == year) & (F.col("round_number") >= round_number))


def in_seasons(seasons: Sequence[int]) -> Column:
    return F.col("year").isin([int(y) for y in seasons])


def qualifying_targets(quali: DataFrame, event: Sequence[str] = EVENT, time: str = "q3_time") -> DataFrame:
    """Gap to the best third-segment time of the event; drivers without a time are dropped."""
    timed = quali.where(F.col(time).isNotNull())
    best = timed.groupBy(*event).agg(F.min(time).alias("_best"))
    return attach(timed, best, event, "inner").withColumn("target", F.col(time) - F.col("_best")).drop("_best")


def _with_event(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "event_year": F.col("year"),
            "event_round": F.col("round_number"),
            "event_key": event_key(F.col("year"), F.col("round_number")),
        }
    )


def qualifying_training(features: DataFrame, quali: DataFrame) -> DataFrame:
    """Practice features with the qualifying gap as target."""
    targets = qualifying_targets(quali).select(*DRIVER, "target")
    return _with_event(features.join(targets, list(DRIVER)))


def race_features(features: DataFrame, quali: DataFrame, standings: DataFrame | None = None) -> DataFrame:
    """Practice features with the qualifying position and, if given, the standing before the round."""
    positions = quali.select(*DRIVER, F.col("position").cast("double").alias("qualy_position"))
    joined = features.join(positions, list(DRIVER))
    if standings is not None:
        joined = joined.join(standings.select(*DRIVER, "position_start"), list(DRIVER), "left")
    return joined


def race_training(
    features: DataFrame, quali: DataFrame, race: DataFrame, standings: DataFrame | None = None
) -> DataFrame:
    """Race features with the finishing position as target."""
    finish = race.select(*DRIVER, F.col("position").cast("double").alias("target"))
    return _with_event(race_features(features, quali, standings).join(finish, list(DRIVER)))


def align(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """Exactly the wanted feature columns in the given order; absent ones are null."""
    known = set(df.columns)
    return df.select(*keep, *[(F.col(c) if c in known else F.lit(None)).cast("double").alias(c) for c in features])


def walk_forward_folds(events: DataFrame) -> DataFrame:
    """Validation events in order: each is predicted from all events before it.

    Training starts with a third of the events, at least three; fewer than four
    events give no fold.  The input has one row per event, so the single
    window over it is as long as the calendar.
    """
    ordered = Window.orderBy("event_key")
    everything = Window.partitionBy()
    numbered = events.select("event_key").where("event_key is not null").distinct().select(
        "event_key",
        (F.row_number().over(ordered) - 1).cast("bigint").alias("train_events"),
        F.count(F.lit(1)).over(everything).alias("_n"),
    )
    start = F.greatest(F.lit(3), F.floor(F.col("_n") / 3))
    return numbered.where((F.col("_n") >= 4) & (F.col("train_events") >= start)).select("event_key", "train_events")


def hash_split(df: DataFrame, keys: Sequence[str], train_percent: int = 80, seed: int = 7) -> DataFrame:
    """Mark rows for training by the first digits of an MD5 of their key.

    The mark depends on the key and the seed alone, so it survives
    repartitioning and lost tasks, which a random number per row does not.
    """
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *texts)), 1, 8)
    slot = F.conv(digits, 16, 10).cast("bigint") % 100
    return df.withColumn("in_train", slot < train_percent)
