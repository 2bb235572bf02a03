"""All sources, seasons and rounds in one wide table, with coverage and notes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.scalars import event_key
from paddock.operators.ordering import attach, first_places
from paddock.schemas import DELTAS, DRIVER, EVENT, QUALIFYING_FEATURES, RANKS

# Order of the kinds within a round: a later kind decides the driver's name.
KINDS = ("practice", "qualifying", "race", "standings")

DATASET_COLUMNS = (
    "source",
    "event_name",
    "year",
    "round_number",
    "event_key",
    "driver_id",
    "driver_name",
    *QUALIFYING_FEATURES,
    "qualy_position",
    "qualy_q3_time",
    "race_position",
    "standings_position_start",
)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_rounds(calendar: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rounds of every source and season, all of them for None."""
    if n is None:
        return calendar
    kept = first_places(calendar, ["source", "year"], [F.col("round_number")], n, "_place")
    return kept.drop("_place")


def _tagged(frame: DataFrame, kind: str, wanted: Sequence[str]) -> DataFrame:
    """Rows of one kind in the common layout; ``ord`` decides which duplicate is the last."""
    known = set(frame.columns)
    order = F.col("ord") if "ord" in known else F.lit(0).cast("bigint")
    name = F.col("driver_name") if "driver_name" in known else F.lit(None).cast("string")
    values = [(F.col(c) if c in known else F.lit(None)).cast("double").alias(c) for c in wanted]
    return frame.where(F.col("driver_id").isNotNull()).select(
        *EVENT,
        F.col("driver_id").cast("string").alias("driver_id"),
        F.coalesce(name, F.col("driver_id").cast("string")).alias("driver_name"),
        F.lit(KINDS.index(kind)).alias("kind"),
        order.cast("bigint").alias("ord"),
        *values,
    )


def stack_kinds(
    practice: DataFrame, qualifying: DataFrame, race: DataFrame, standings: DataFrame
) -> DataFrame:
    """The four frames of every round under one another, tagged by kind."""
    return union_sources(
        [
            _tagged(practice, "practice", QUALIFYING_FEATURES),
            _tagged(qualifying.withColumnRenamed("position", "qualy_position"), "qualifying", ("qualy_position", "q3_time")),
            _tagged(race.withColumnRenamed("position", "race_position"), "race", ("race_position",)),
            _tagged(standings, "standings", ("position_start",)),
        ]
    )


def driver_universe(stacked: DataFrame) -> DataFrame:
    """Every driver of a round once, named by the last row of the last kind."""
    last = F.max_by("driver_name", F.struct("kind", "ord", "driver_name"))
    return stacked.groupBy(*DRIVER).agg(last.alias("driver_name"))


def _last_of(kind: str, cols: Sequence[str]) -> Column:
    """Values of the last row of one kind; rows of other kinds have no order and are ignored."""
    # Rows without an ordinal, or of the same one, are told apart by all their values.
    order = F.when(F.col("kind") == KINDS.index(kind), F.struct("ord", "driver_name", *cols))
    return F.max_by(F.struct(*cols), order).alias(kind)


def merge_kinds(stacked: DataFrame) -> DataFrame:
    """One row per driver and round with the values of all four kinds.

    A chain of left joins from the driver universe would shuffle five times;
    stacking and keeping the last row per kind needs one exchange.
    """
    grouped = stacked.groupBy(*DRIVER).agg(
        F.max_by("driver_name", F.struct("kind", "ord", "driver_name")).alias("driver_name"),
        _last_of("practice", QUALIFYING_FEATURES),
        _last_of("qualifying", ("qualy_position", "q3_time")),
        _last_of("race", ("race_position",)),
        _last_of("standings", ("position_start",)),
    )
    features = [
        F.col(f"practice.{c}").cast("int" if c in RANKS[:3] else "double").alias(c) for c in (*DELTAS, *RANKS)
    ]
    return grouped.select(
        *DRIVER,
        "driver_name",
        *features,
        F.col("qualifying.qualy_position").alias("qualy_position"),
        F.col("qualifying.q3_time").alias("qualy_q3_time"),
        F.col("race.race_position").alias("race_position"),
        F.col("standings.position_start").alias("standings_position_start"),
        *[F.col(k).isNotNull().alias(f"has_{k}") for k in KINDS],
    )


def dataset_rows(calendar: DataFrame, merged: DataFrame) -> DataFrame:
    """Wide dataset of the rounds in the calendar, fixed columns."""
    named = attach(merged, calendar.select(*EVENT, "event_name"), EVENT, "inner")
    return named.withColumn("event_key", event_key(F.col("year"), F.col("round_number"))).select(*DATASET_COLUMNS)


def dataset_order() -> list[Column]:
    keys = ("source", "year", "round_number", "qualy_position", "race_position", "driver_id")
    return [F.col(c).asc_nulls_last() for c in keys]


def coverage(calendar: DataFrame, merged: DataFrame) -> DataFrame:
    """Drivers and available kinds of every calendar round; rounds without data stay with zeros."""
    # Merged rows are unique per driver and round, so distinct drivers are plain rows.
    found = merged.groupBy(*EVENT).agg(
        F.count("driver_id").alias("drivers"),
        *[F.max(F.col(f"has_{k}").cast("int")).alias(f"{k}_available") for k in KINDS],
    )
    counts = ["drivers", *[f"{k}_available" for k in KINDS]]
    joined = calendar.select(*EVENT, "event_name").join(found, list(EVENT), "left").fillna(0, subset=counts)
    return joined.select(
        *EVENT,
        "event_name",
        "drivers",
        F.col("practice_available").alias("fp_available"),
        "qualifying_available",
        "race_available",
        "standings_available",
    )


def rounds_with(calendar: DataFrame, *frames: DataFrame) -> DataFrame:
    """Calendar rounds for which every frame has rows."""
    return reduce(lambda cal, f: cal.join(f.select(*EVENT).distinct(), list(EVENT), "left_semi"), frames, calendar)


def notes_of_coverage(covered: DataFrame) -> DataFrame:
    """One note per round and kind without rows, from the flags of ``coverage``: no table is read again."""
    flags = dict(zip(KINDS, ("fp_available", "qualifying_available", "race_available", "standings_available")))
    kinds = F.array(*[F.when(F.col(c) == 0, F.lit(k)) for k, c in flags.items()])
    place = F.concat_ws(" ", "source", F.col("year").cast("string"), F.lit("round"), F.col("round_number").cast("string"))
    return covered.select(F.explode(F.array_compact(kinds)).alias("stage"), *EVENT, place.alias("_place")).select(
        "stage", *EVENT, F.concat("_place", F.lit(": no "), "stage", F.lit(" data")).alias("message")
    )


def missing_notes(calendar: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """One note per calendar round and kind without rows."""
    notes = [
        calendar.join(f.select(*EVENT).distinct(), list(EVENT), "left_anti").select(
            F.lit(kind).alias("stage"),
            *EVENT,
            F.concat(
                F.col("source"),
                F.lit(" "),
                F.col("year").cast("string"),
                F.lit(" round "),
                F.col("round_number").cast("string"),
                F.lit(f": no {kind} data"),
            ).alias("message"),
        )
        for kind, f in frames.items()
    ]
    return union_sources(notes)


def summary(dataset: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows of the dataset and events of its coverage table, in one row."""
    rows = dataset.agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("events", covered.agg(F.count(F.lit(1))).scalar())
