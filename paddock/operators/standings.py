"""Championship standings before each round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.scalars import first_nonzero, points_for
from paddock.operators.ordering import attach, known, with_min_rank
from paddock.operators.practice import rounds_with_sessions


def race_points(races: DataFrame, season: Sequence[str] = ("source", "year")) -> DataFrame:
    """Points per driver and round; positions past the table or missing give no row."""
    scored = races.withColumn("points", points_for(F.col("position")))
    return known(scored, *season, "round_number", "driver_id", "points").groupBy(*season, "round_number", "driver_id").agg(F.sum("points").alias("points"))


def standings_before_round(
    calendar: DataFrame, races: DataFrame, season: Sequence[str] = ("source", "year")
) -> DataFrame:
    """Points and position of every driver before every round of the calendar.

    The running sum of a driver-season changes only at scoring rounds, so each
    state is written out for the rounds it is valid for: every output row comes
    from exactly one input row, rather than from all earlier races.  A season's
    list of rounds is as long as its calendar.
    """
    by_round = Window.partitionBy(*season, "driver_id").orderBy("round_number")
    states = race_points(races, season).select(
        *season,
        "driver_id",
        F.sum("points").over(by_round.rowsBetween(Window.unboundedPreceding, 0)).alias("points"),
        F.col("round_number").alias("_after"),
        F.lead("round_number").over(by_round).alias("_until"),
    )
    rounds = calendar.groupBy(*season).agg(F.collect_set("round_number").alias("_rounds"))
    after, until = F.col("_after"), F.col("_until")
    valid = F.filter("_rounds", lambda r: (r > after) & (until.isNull() | (r <= until)))
    totals = attach(states, rounds, season, "inner").select(
        *season, "driver_id", "points", F.explode(valid).alias("round_number")
    )
    # Distinct point totals of a season are few, whatever the number of drivers.
    ranked = with_min_rank(totals, [*season, "round_number"], "points", "position_start", descending=True, few=True)
    return ranked.select(*season, "round_number", "driver_id", "points", "position_start")


def standings_after_previous_round(meetings: DataFrame, sessions: DataFrame, championship: DataFrame) -> DataFrame:
    """Snapshot taken at the race of the round before; the first round has none."""
    races = rounds_with_sessions(meetings, sessions).where(F.col("session_name") == "Race")
    snapshot = championship.select(
        "session_key",
        F.col("driver_number").cast("string").alias("driver_id"),
        F.col("driver_number").cast("string").alias("driver_name"),
        first_nonzero(F.col("position_start"), F.col("position_current")).cast("double").alias("position_start"),
        "ord",
    )
    next_round = (F.col("round_number") + 1).alias("round_number")
    return attach(snapshot, races, ["session_key"], "inner").select(
        "source", "year", next_round, "driver_id", "driver_name", "position_start", "ord"
    )
