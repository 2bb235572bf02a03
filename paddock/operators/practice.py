"""Practice laps and session results to per-driver features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from paddock.functions.scalars import first_filled, nan_to_null, row_mean, session_label, to_number
from paddock.operators.ordering import attach, keep_last, known, value_ranks
from paddock.schemas import EVENT, SESSIONS
from paddock.session import cut_lineage


def best_laps(laps: DataFrame, event: Sequence[str] = EVENT, time: str = "lap_time") -> DataFrame:
    """Fastest lap per driver and session; laps without driver, time or session are dropped."""
    cols = [*event, "session", "driver_id", time]
    return known(laps.select(*cols), *cols).groupBy(*event, "session", "driver_id").agg(F.min(time).alias("best_lap"))


def session_features(best: DataFrame, event: Sequence[str] = EVENT) -> DataFrame:
    """Gap to the fastest driver of the session and rank, ties sharing the smallest rank.

    ``best`` holds one row per driver and session.  Both columns depend on the
    lap time alone, so they are computed once per distinct time and joined back.
    ``best`` is read for both: write it first if it comes from all laps.
    """
    session = [*event, "session"]
    times = value_ranks(best, session, "best_lap", lowest="_fastest")
    scored = times.select(
        *session,
        "best_lap",
        (F.col("best_lap") - F.col("_fastest")).alias("delta"),
        (F.col("before") + 1).alias("rank"),
    )
    return attach(best, scored, [*session, "best_lap"], "inner")


def practice_wide(features: DataFrame, event: Sequence[str] = EVENT) -> DataFrame:
    """Three sessions side by side, one row per driver and event.

    The pivot is the full outer join of the sessions on driver and name, done
    in one exchange because (driver, session) is unique.
    """
    picks = []
    for label in SESSIONS:
        here = F.col("session") == label
        for col in ("delta", "rank"):
            picks.append(F.max(F.when(here, F.col(col))).alias(f"{label.lower()}_{col}"))
    return features.groupBy(*event, "driver_id", "driver_name").agg(*picks)


def practice_wide_by_joins(features: DataFrame, event: Sequence[str] = EVENT) -> DataFrame:
    """The same table by full outer joins; kept as a cross-check of the pivot."""
    keys = [*event, "driver_id", "driver_name"]
    wide = None
    for label in SESSIONS:
        low = label.lower()
        one = features.where(F.col("session") == label).select(
            *keys, F.col("delta").alias(f"{low}_delta"), F.col("rank").alias(f"{low}_rank")
        )
        wide = one if wide is None else wide.join(one, keys, "full")
    return wide


def with_row_means(wide: DataFrame) -> DataFrame:
    """Mean gap and mean rank over the sessions a driver took part in."""
    return wide.withColumns(
        {
            "fp_mean_delta": row_mean([F.col(f"{s.lower()}_delta") for s in SESSIONS]),
            "fp_mean_rank": row_mean([F.col(f"{s.lower()}_rank") for s in SESSIONS]),
        }
    )


def features_from_laps(
    laps: DataFrame, event: Sequence[str] = EVENT, time: str = "lap_time"
) -> DataFrame:
    """Laps to the wide practice table; the driver id doubles as the name.  Laps are read once."""
    return features_from_best(cut_lineage(best_laps(laps, event, time), "best"), event)


def features_from_best(best: DataFrame, event: Sequence[str] = EVENT) -> DataFrame:
    """Fastest laps per driver and session to the wide practice table."""
    scored = session_features(best, event)
    return with_row_means(practice_wide(scored.withColumn("driver_name", F.col("driver_id")), event))


# -- result tables keyed by session ------------------------------------------


def number_meetings(meetings: DataFrame) -> DataFrame:
    """Round numbers by start date within a season, missing dates first, input order on ties.

    A season holds a few dozen meetings, so the window is bounded by the calendar.
    """
    by_date = Window.partitionBy("source", "year").orderBy(F.coalesce("date_start", F.lit("")), "ord")
    return meetings.withColumn("round_number", F.row_number().over(by_date))


def find_meeting(
    meetings: DataFrame,
    year: int,
    round_number: int,
    meeting_name: str | None = None,
    country_name: str | None = None,
) -> DataFrame:
    """The meeting of a season by name, else by country, else by round; empty if there is none."""
    season = number_meetings(meetings.where(F.col("year") == year))
    if meeting_name:
        hit = season.where(F.col("meeting_name") == meeting_name)
    elif country_name:
        hit = season.where(F.col("country_name") == country_name)
    else:
        hit = season.where(F.col("round_number") == round_number)
    return hit.orderBy("ord").limit(1)


def required_meeting(
    meetings: DataFrame, year: int, round_number: int, meeting_name: str | None = None, country_name: str | None = None
) -> Row:
    """The one meeting that ``find_meeting`` finds; an error says what was asked for if there is none."""
    found = find_meeting(meetings, year, round_number, meeting_name, country_name).first()
    if found is None:
        asked = meeting_name or country_name or f"round {round_number}"
        raise LookupError(f"no meeting for {asked} in {year}")
    return found


def session_keys(sessions: DataFrame) -> DataFrame:
    """First session of every (meeting, session name)."""
    return sessions.groupBy("meeting_key", "session_name").agg(F.min_by("session_key", "ord").alias("session_key"))


def driver_names(drivers: DataFrame) -> DataFrame:
    """Acronym of every driver number in a session, the number where it has none; the last row counts."""
    number = F.col("driver_number").cast("string")
    named = drivers.where(number.isNotNull()).select(
        "session_key", number.alias("driver_id"), first_filled(F.col("name_acronym"), number).alias("driver_name"), "ord"
    )
    return keep_last(named, ["session_key", "driver_id"], ["ord"]).drop("ord")


def results_with_names(results: DataFrame, drivers: DataFrame) -> DataFrame:
    """Result rows by driver id, with the driver's name or else the id.

    A duration is a number of seconds or a list of three segment times.
    """
    keyed = results.select(
        "session_key",
        F.col("driver_number").cast("string").alias("driver_id"),
        to_number(F.col("position").cast("string")).alias("position"),
        nan_to_null(F.try_variant_get("duration", "$", "double")).alias("seconds"),
        nan_to_null(F.try_variant_get("duration", "$[2]", "double")).alias("q3_time"),
        "ord",
    )
    named = known(keyed, "driver_id").join(driver_names(drivers), ["session_key", "driver_id"], "left")
    return named.withColumn("driver_name", F.coalesce("driver_name", "driver_id"))


def rounds_with_sessions(meetings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with their source, season and round: a few rows per race weekend."""
    rounds = number_meetings(meetings).select(*EVENT, "meeting_key")
    return rounds.join(session_keys(sessions), "meeting_key")


def practice_from_results(
    meetings: DataFrame, sessions: DataFrame, results: DataFrame, drivers: DataFrame
) -> DataFrame:
    """Wide practice table of all rounds from session results; rows without a time are skipped."""
    practice = rounds_with_sessions(meetings, sessions).withColumn("session", session_label(F.col("session_name")))
    practice = practice.where(F.col("session").isNotNull())
    timed = known(results_with_names(results, drivers).withColumnRenamed("seconds", "best_lap"), "best_lap")
    best = attach(timed, practice, ["session_key"], "inner").select(
        *EVENT, "session", "driver_id", "driver_name", "best_lap"
    )
    return with_row_means(practice_wide(session_features(cut_lineage(best, "best"), EVENT)))


def qualifying_from_results(
    meetings: DataFrame, sessions: DataFrame, results: DataFrame, drivers: DataFrame
) -> DataFrame:
    """Qualifying positions and third-segment times of all rounds."""
    quali = rounds_with_sessions(meetings, sessions).where(F.col("session_name") == "Qualifying")
    named = results_with_names(results, drivers)
    return attach(named, quali, ["session_key"], "inner").select(
        *EVENT, "driver_id", "driver_name", "position", "q3_time", "ord"
    )


def race_from_results(meetings: DataFrame, sessions: DataFrame, results: DataFrame, drivers: DataFrame) -> DataFrame:
    """Race positions of all rounds."""
    race = rounds_with_sessions(meetings, sessions).where(F.col("session_name") == "Race")
    named = results_with_names(results, drivers)
    return attach(named, race, ["session_key"], "inner").select(*EVENT, "driver_id", "driver_name", "position", "ord")
