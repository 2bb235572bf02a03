"""Fixed schemas: every column always exists and is null where a source has no value."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = ("source", "year", "round_number")
DRIVER = (*EVENT, "driver_id")
SESSIONS = ("FP1", "FP2", "FP3")
DELTAS = ("fp1_delta", "fp2_delta", "fp3_delta", "fp_mean_delta")
RANKS = ("fp1_rank", "fp2_rank", "fp3_rank", "fp_mean_rank")
QUALIFYING_FEATURES = (*DELTAS, *RANKS)
RACE_FEATURES = (*QUALIFYING_FEATURES, "qualy_position")


def _struct(text: str) -> T.StructType:
    kinds = {
        "int": T.IntegerType(),
        "long": T.LongType(),
        "double": T.DoubleType(),
        "string": T.StringType(),
        "timestamp": T.TimestampType(),
        "variant": T.VariantType(),
    }
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


SCHEDULE = _struct("source string, year int, round_number int, event_name string")
LAPS = _struct("source string, year int, round_number int, session string, driver_id string, lap_time double")
MEETINGS = _struct(
    "source string, year int, meeting_key long, meeting_name string, country_name string, date_start string, ord long"
)
SESSION_TABLE = _struct("source string, year int, meeting_key long, session_key long, session_name string, ord long")
SESSION_DRIVERS = _struct("session_key long, driver_number string, name_acronym string, ord long")
SESSION_RESULTS = _struct("session_key long, driver_number string, position string, duration variant, ord long")
CHAMPIONSHIP = _struct("session_key long, driver_number string, position_start int, position_current int, ord long")

TEAMS = _struct("team_id string, team_name string, league string, country string, team_aliases string")
MATCHES = _struct(
    "match_id string, date string, season int, league string, home_team_id string, away_team_id string, "
    "home_goals int, away_goals int, home_xg double, away_xg double, home_odds double, draw_odds double, "
    "away_odds double, venue string, home_red int, away_red int"
)

RUNS = _struct(
    "id string, created_at timestamp, sport string, project string, status string, config_json string, "
    "result_path string, stdout_path string, stderr_path string, duration_ms int, sweep_id string"
)
SWEEPS = _struct(
    "id string, created_at timestamp, sport string, project string, param string, values_json string, "
    "base_config_json string, status string"
)
SWEEP_RUNS = _struct("sweep_id string, run_id string, param_value string")

RESULT_DOCUMENT = (
    "version string, sport string, project string, config map<string,string>, "
    "rows array<struct<rank: int, driver_name: string, team: string, player: string, id: string, pred: double, score: double, value: double>>, "
    "notes array<string>, generated_at string"
)
NOTEBOOK_DOCUMENT = "cells array<struct<cell_type: string, source: variant>>"
