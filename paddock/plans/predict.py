"""Prediction of a round, or of all rounds, from landed tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import models
from paddock.operators.ordering import first_places
from paddock.operators.practice import required_meeting
from paddock.operators.training import (
    before_target,
    in_seasons,
    qualifying_training,
    race_features,
    race_training,
    walk_forward_folds,
)
from paddock.schemas import DELTAS, EVENT, QUALIFYING_FEATURES, RACE_FEATURES
from paddock.session import cut_lineage

TOP_N = 10
#: What a candidate raises whose library is missing or says that it can't run.
UNUSABLE = (ImportError, RuntimeError)


@dataclass(frozen=True)
class Tables:
    """Landed tables of one source, all rounds."""

    practice: DataFrame
    qualifying: DataFrame
    race: DataFrame
    standings: DataFrame | None = None


@dataclass
class Prediction:
    table: DataFrame
    model: str
    version: str
    leaderboard: DataFrame | None = None
    notes: list[str] = field(default_factory=list)
    #: Errors of the candidates that were left out, by name.
    failures: dict[str, str] = field(default_factory=dict)


def feature_columns(mode: str, include_standings: bool = False) -> list[str]:
    if mode == "qualifying":
        return list(QUALIFYING_FEATURES)
    return [*RACE_FEATURES, *(["position_start"] if include_standings else [])]


def fallback_columns(mode: str) -> list[str]:
    return list(DELTAS) if mode == "qualifying" else ["qualy_position"]


def training_table(tables: Tables, mode: str, seasons: Sequence[int], year: int, round_number: int,
                   include_standings: bool = False) -> DataFrame:
    """Earlier rounds of the chosen seasons; the season filter reaches the scans."""
    usable = in_seasons(seasons) & before_target(year, round_number)
    practice, quali = tables.practice.where(usable), tables.qualifying.where(usable)
    if mode == "qualifying":
        return qualifying_training(practice, quali)
    standings = tables.standings.where(usable) if include_standings and tables.standings is not None else None
    return race_training(practice, quali, tables.race.where(usable), standings)


def current_features(tables: Tables, mode: str, year: int, round_number: int,
                     include_standings: bool = False) -> DataFrame:
    this_round = (F.col("year") == year) & (F.col("round_number") == round_number)
    practice = tables.practice.where(this_round)
    if mode == "qualifying":
        return practice
    standings = tables.standings.where(this_round) if include_standings and tables.standings is not None else None
    return race_features(practice, tables.qualifying.where(this_round), standings)


def top_table(scored: DataFrame, group: Sequence[str] = (), n: int = TOP_N) -> DataFrame:
    """The first ``n`` by prediction, per group, numbered from 1."""
    named = scored.withColumn("driver_name", F.coalesce("driver_name", "driver_id"))
    order = [F.col("pred").asc_nulls_last(), F.col("driver_id")]
    if group:
        ranked = first_places(named, group, order, n, "rank")
    else:
        ranked = first_places(named.orderBy(*order).limit(n), [], order, n, "rank")
    return ranked.select(*group, "rank", "driver_name", "pred")


def _with_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The frame with every feature a double; an absent one is null."""
    known = set(df.columns)
    return df.withColumns({c: (F.col(c) if c in known else F.lit(None)).cast("double") for c in features})


def _collected(table: DataFrame) -> DataFrame:
    """A table of at most some rows, computed now: a model that cannot run fails here."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def predict_round(tables: Tables, mode: str, year: int, round_number: int, seasons: Sequence[int],
                  include_standings: bool = False, top_n: int = TOP_N,
                  candidates: Sequence[models.Candidate] | None = None, meetings: DataFrame | None = None,
                  meeting_name: str | None = None, country_name: str | None = None,
                  every_candidate: bool = False) -> Prediction:
    """Ranked prediction of one round by the model with the smallest walk-forward error.

    With ``meetings`` the round is that of the meeting by name, by country or
    by number; one that the season doesn't have is an error.

    A feature that no table has is null.  A candidate whose library is missing
    or can't run is left out, with a note and its error in ``failures``; the
    next best one predicts in its place, and without labelled rows or a working
    candidate the heuristic does.  With ``every_candidate`` nothing is left
    out: the error is raised, for callers that hand on the table alone.  Any
    other error, such as that of a Spark job, is raised in any case.  The
    training table feeds several fits, so it is written once.
    """
    if meetings is not None:
        round_number = required_meeting(meetings, year, round_number, meeting_name, country_name)["round_number"]
    features = feature_columns(mode, include_standings)
    result = Prediction(table=None, model="heuristic", version="V1" if round_number <= 1 else f"V{round_number}")
    fallback = fallback_columns(mode)
    current = current_features(tables, mode, year, round_number, include_standings)
    current = cut_lineage(_with_features(current, [*features, *fallback]), "current")
    train = _with_features(training_table(tables, mode, seasons, year, round_number, include_standings), features)
    train = cut_lineage(train, "training")
    if include_standings and tables.standings is None:
        result.notes.append("no standings: position_start is unknown")
    used = train.select("year", "round_number").distinct()
    known_rounds = tables.practice.where(in_seasons(seasons) & before_target(year, round_number)).select("year", "round_number").distinct()
    # As many rows as the calendar of the seasons.
    for r in known_rounds.join(used, ["year", "round_number"], "left_anti").orderBy("year", "round_number").collect():
        result.notes.append(f"{r['year']} round {r['round_number']}: left out of training, not all tables have it")
    if current.isEmpty():
        result.notes.append("no practice data" if mode == "qualifying" else "no practice or qualifying data")

    def leave_out(m: models.Candidate, failure: Exception) -> None:
        if every_candidate or isinstance(failure, PySparkException):
            raise failure
        result.failures[m.name] = f"{type(failure).__name__}: {failure}"
        result.notes.append(f"{m.name} failed: {result.failures[m.name]}")

    def heuristic(note: str) -> Prediction:
        result.notes.append(note)
        scored = models.heuristic(current.withColumn("_all", F.lit(0)), ["_all"], fallback).drop("_all")
        result.model, result.table = "heuristic", _collected(top_table(scored, n=top_n))
        return result

    if train.where("target IS NOT NULL").isEmpty():
        return heuristic("not enough past data: heuristic")
    known = list(candidates if candidates is not None else models.candidates())
    folds = walk_forward_folds(train.select("event_key").distinct())
    board = []
    if folds.isEmpty():
        result.notes.append("too few events for walk-forward validation: first model by priority")
    else:
        for m in list(known):
            try:
                board += models.leaderboard(train, features, folds, [m]).collect()  # one row at most
            except UNUSABLE as failure:
                leave_out(m, failure)
                known.remove(m)
    if board:
        board.sort(key=lambda r: (r["mae"], r["priority"]))
        result.leaderboard = train.sparkSession.createDataFrame(board, "name string, priority int, mae double, folds long")
        result.notes.append("walk-forward error: " + ", ".join(f"{r['name']}={r['mae']:.3f}" for r in board))
    place = {r["name"]: i for i, r in enumerate(board)}
    for m in sorted(known, key=lambda m: (place.get(m.name, len(board)), m.priority)):
        try:
            result.table = _collected(top_table(m.predict(train, current, features), n=top_n))
        except UNUSABLE as failure:
            leave_out(m, failure)
            continue
        result.model = m.name
        result.notes.append(f"model: {m.name}")
        return result
    if every_candidate:
        raise ValueError("no candidate is known")
    return heuristic("no model could be fitted: heuristic")


def predict_all_heuristic(practice: DataFrame, n: int = TOP_N) -> DataFrame:
    """Heuristic top ``n`` of every round at once."""
    practice = practice.select(*EVENT, "driver_id", "driver_name", *DELTAS)
    return top_table(models.heuristic(practice, EVENT, DELTAS), EVENT, n)
