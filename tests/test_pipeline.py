"""Practice features, standings, datasets, training and predictions on inline tables."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rows import values

from paddock import schemas
from paddock.operators import dataset as ds
from paddock.operators import metrics, models, practice, standings, training, walkforward
from paddock.plans.build import build_dataset, summary_document
from paddock.plans.predict import Tables, predict_all_heuristic, predict_round


def laps(spark, rows):
    return spark.createDataFrame([("s", 2024, *r) for r in rows], schemas.LAPS)


def test_ties_share_a_rank(spark):
    got = practice.session_features(
        practice.best_laps(
            laps(spark, [(1, "FP1", "A", 90.0), (1, "FP1", "A", 95.0), (1, "FP1", "B", 90.0), (1, "FP1", "C", 91.5),
                         (1, "FP1", "D", None), (1, "FP1", None, 80.0)])
        )
    )
    assert values(got.select("driver_id", "delta", "rank")) == [("A", 0.0, 1), ("B", 0.0, 1), ("C", 1.5, 3)]


def test_missing_session(spark):
    rows = [(1, "FP1", d, t) for d, t in (("A", 90.0), ("B", 90.2), ("C", 90.4))]
    rows += [(1, "FP3", "C", 80.2), (1, "FP3", "D", 80.0), (1, "FP3", "C", 80.2)]
    got = practice.features_from_laps(laps(spark, rows)).where("driver_id = 'C'").first()
    assert got.fp2_delta is None and got.fp2_rank is None
    assert got.fp1_rank == 3 and got.fp3_rank == 2 and got.fp_mean_rank == 2.5
    assert got.fp_mean_delta == pytest.approx(0.3)


def test_pivot_equals_outer_join(spark):
    rng = np.random.default_rng(5)
    rows = [(int(r), f"FP{s}", f"D{d}", float(t)) for r, s, d, t in
            zip(rng.integers(1, 4, 80), rng.integers(1, 4, 80), rng.integers(0, 9, 80), rng.uniform(80, 99, 80))]
    scored = practice.session_features(practice.best_laps(laps(spark, rows))).withColumn("driver_name", F.col("driver_id"))
    cols = practice.practice_wide(scored).columns
    assert values(practice.practice_wide(scored)) == values(practice.practice_wide_by_joins(scored).select(*cols))


@pytest.fixture(scope="module")
def api(spark):
    """Landed API tables of one season with two meetings."""
    meetings = spark.createDataFrame(
        [("api", 2024, 11, "Alpha", "X", "2024-03-01", 0), ("api", 2024, 10, "Beta", "Y", "2024-02-01", 1),
         ("api", 2024, 12, "Gamma", "X", None, 2)], schemas.MEETINGS)
    names = ("Practice 1", "Practice 2", "Practice 3", "Qualifying", "Race")
    sessions = spark.createDataFrame(
        [("api", 2024, m, m * 10 + i, n, m * 10 + i) for m in (10, 11, 12) for i, n in enumerate(names)]
        + [("api", 2024, 10, 999, "Race", 9999)], schemas.SESSION_TABLE)
    drivers = spark.createDataFrame(
        [(k, str(n), a, o) for k in (100, 103, 104, 110) for o, (n, a) in enumerate(((1, "OLD"), (1, "VER"), (44, "")))],
        schemas.SESSION_DRIVERS)
    raw = spark.createDataFrame(
        [(100, "1", None, "90.5", 0), (100, "44", None, "90.0", 1), (100, "7", None, None, 2),
         (103, "1", "1", "[91.0,90.5,89.9]", 3), (103, "44", "2", "[91.0,90.5]", 4),
         (104, "1", "2", None, 5), (104, "44", "DNF", None, 6)],
        "session_key long, driver_number string, position string, text string, ord long")
    results = raw.withColumn("duration", F.try_parse_json("text")).select(*schemas.SESSION_RESULTS.names)
    champ = spark.createDataFrame([(104, "1", 0, 4, 0), (104, "44", 2, 1, 1)], schemas.CHAMPIONSHIP)
    return meetings, sessions, results, drivers, champ


def test_results_to_tables(api):
    meetings, sessions, results, drivers, champ = api
    assert values(practice.number_meetings(meetings).select("meeting_key", "round_number")) == [(10, 2), (11, 3), (12, 1)]
    fp = practice.practice_from_results(meetings, sessions, results, drivers)
    assert values(fp.select("round_number", "driver_id", "driver_name", "fp1_delta", "fp1_rank")) == [
        (2, "1", "VER", 0.5, 2), (2, "44", "44", 0.0, 1)]
    quali = practice.qualifying_from_results(meetings, sessions, results, drivers)
    assert values(quali.select("driver_id", "position", "q3_time")) == [("1", 1.0, 89.9), ("44", 2.0, None)]
    race = practice.race_from_results(meetings, sessions, results, drivers)
    assert values(race.select("driver_id", "position")) == [("1", 2.0), ("44", None)]
    table = standings.standings_after_previous_round(meetings, sessions, champ)
    assert values(table.select("round_number", "driver_id", "position_start")) == [(3, "1", 4.0), (3, "44", 2.0)]


def test_meeting_choice(api):
    def key(**kw):
        return [r.meeting_key for r in practice.find_meeting(api[0], 2024, kw.pop("rnd", 1), **kw).collect()]

    assert key(meeting_name="Beta", country_name="X") == [10]
    assert key(country_name="X") == [11]
    assert key(rnd=3) == [11] and key(rnd=4) == []


def race_table(spark, rows):
    return spark.createDataFrame([("s", 2024, *r) for r in rows], "source string, year int, round_number int, driver_id string, position double")


def test_standings_before_round(spark):
    race = race_table(spark, [(1, "A", 1.0), (1, "B", 2.0), (1, "C", 11.0), (1, "D", None), (1, "E", 0.0), (3, "B", 1.0)])
    cal = spark.createDataFrame([("s", 2024, r) for r in (1, 2, 3, 4)], "source string, year int, round_number int")
    got = standings.standings_before_round(cal, race)
    assert values(got.select("round_number", "driver_id", "points", "position_start")) == [
        (2, "A", 25, 1), (2, "B", 18, 2), (2, "E", 0, 3),
        (3, "A", 25, 1), (3, "B", 18, 2), (3, "E", 0, 3),
        (4, "A", 25, 2), (4, "B", 43, 1), (4, "E", 0, 3)]


def test_merge_coverage_and_notes(spark, tmp_path):
    cal = spark.createDataFrame([("s", 2024, r, f"E{r}") for r in (1, 2)], schemas.SCHEDULE)
    fp = practice.features_from_laps(laps(spark, [(1, "FP1", "VER", 90.0)]))
    kind = "source string, year int, round_number int, driver_id string, driver_name string, position double, q3_time double, ord long"
    quali = spark.createDataFrame([("s", 2024, 1, "VER", "VER", 4.0, 88.0, 0), ("s", 2024, 1, "VER", "VER", 3.0, 87.0, 1),
                                   ("s", 2024, 1, "HAM", None, 1.0, None, 2)], kind)
    race = spark.createDataFrame([("s", 2024, 1, "VER", "VERSTAPPEN", 5.0, None, 0)], kind)
    empty = standings.standings_before_round(cal, race)
    merged = ds.merge_kinds(ds.stack_kinds(fp, quali, race, empty))
    rows = ds.dataset_rows(cal, merged)
    assert rows.columns == list(ds.DATASET_COLUMNS)
    assert values(rows.where("round_number = 1").select("driver_id", "driver_name", "qualy_position", "qualy_q3_time", "race_position", "fp1_rank")) == [
        ("HAM", "HAM", 1.0, None, None, None), ("VER", "VERSTAPPEN", 3.0, 87.0, 5.0, 1)]
    cover = values(ds.coverage(cal, merged), "round_number")
    assert cover == [("s", 2024, 1, "E1", 2, 1, 1, 1, 0), ("s", 2024, 2, "E2", 1, 0, 0, 0, 1)]
    built = build_dataset(cal, fp, quali, race, empty, str(tmp_path / "out"), max_rounds=1)
    assert spark.read.parquet(built.paths["dataset_parquet"]).count() == 2
    assert spark.read.option("header", True).csv(built.paths["coverage_csv"]).count() == 1
    assert built.notes.where("stage = 'standings'").count() == 1
    document = json.loads(summary_document(built, {"years": [2024]}, "now").first()["document"])
    assert document["rows"] == 2 and document["events"] == 1 and document["config"] == {"years": "[2024]"}
    assert document["notes"] == ["s 2024 round 1: no standings data"] and document["dataset_csv_path"].endswith("dataset_csv")


@pytest.mark.parametrize("n,first", [(3, None), (4, 3), (12, 4)])
def test_folds(spark, n, first):
    events = spark.createDataFrame([(202400 + i,) for i in range(n)], "event_key int")
    got = values(training.walk_forward_folds(events), "event_key")
    assert got == ([] if first is None else [(202400 + i, i) for i in range(first, n)])


@pytest.fixture(scope="module")
def history():
    """Training rows with missing features, an all-missing feature early on, and missing targets."""
    rng = np.random.default_rng(11)
    rows = []
    for e in range(9):
        for d in range(12):
            x = rng.normal(size=3) * (1, 5, 20)
            y = 2 * x[0] - 0.3 * x[1] + 0.05 * x[2] + rng.normal()
            rows.append((202400 + e, f"D{d}", *x, y))
    frame = pd.DataFrame(rows, columns=["event_key", "driver_id", "a", "b", "c", "target"])
    frame.loc[rng.random(len(frame)) < 0.3, "a"] = np.nan
    frame.loc[frame["event_key"] < 202406, "c"] = np.nan
    frame.loc[rng.random(len(frame)) < 0.1, "target"] = np.nan
    return frame


def impute(x):
    return x.fillna(x.median()).fillna(0.0)


def ridge(x, y):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    return y.mean() - x.mean(axis=0) @ w, w


def test_walk_forward_equals_a_loop(spark, history):
    cols = ["a", "b", "c"]
    df = spark.createDataFrame(history).select(
        "event_key", "driver_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in [*cols, "target"]]
    ).withColumn("event_key", F.col("event_key").cast("int"))
    folds = training.walk_forward_folds(df.select("event_key").distinct())
    got = dict(walkforward.fold_errors(walkforward.fold_predictions(df, cols, folds)).collect())
    want = {}
    keys = sorted(history["event_key"].unique())
    for i in range(3, len(keys)):
        train, val = history[history["event_key"] < keys[i]], history[history["event_key"] == keys[i]]
        known = train["target"].notna()
        b, w = ridge(impute(train[cols])[known].to_numpy(), train["target"][known].to_numpy())
        pred = b + impute(val[cols]).to_numpy() @ w
        want[keys[i]] = (val["target"] - pred).abs().mean()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_running_medians(spark, history):
    df = spark.createDataFrame(history[["event_key", "b"]].rename(columns={"b": "value"})).withColumn("name", F.lit("b"))
    df = df.union(df.select("event_key", F.lit(7.0).alias("value"), F.lit("k").alias("name")))
    folds = df.select("event_key").distinct().where("event_key > 202402")
    got = {(r.event_key, r.name): r["median"] for r in walkforward.running_medians(df, folds).collect()}
    for k in range(202403, 202409):
        assert got[k, "k"] == 7.0
        assert got[k, "b"] == history.loc[history["event_key"] < k, "b"].median()


def test_a_fold_meets_few_values(spark, monkeypatch):
    """The values that are compared for a fold are those of one range, a small share of all."""
    rng = np.random.default_rng(5)
    n = 40_000
    frame = pd.DataFrame({"event_key": 202401 + rng.integers(0, 8, n), "name": "b", "value": rng.normal(size=n) * 1000})
    frame.loc[:3000, "value"] = 7.0
    frame.loc[3000:3010, "value"] = np.inf
    met, plain = [], walkforward.totals_before

    def spy(counts, group, key, *rest, **more):
        if key == "value":
            met.append(counts.groupBy(*group).count().agg(F.max("count")).first()[0])
        return plain(counts, group, key, *rest, **more)

    monkeypatch.setattr(walkforward, "totals_before", spy)
    df = spark.createDataFrame(frame)
    folds = df.select("event_key").distinct().where("event_key > 202401")
    got = {r.event_key: r["median"] for r in walkforward.running_medians(df, folds).collect()}
    assert got == {k: frame.loc[frame["event_key"] < k, "value"].median() for k in range(202402, 202409)}
    assert len(met) == 1 and met[0] < n / 200


def test_qualifying_targets(spark):
    rows = [(1, "A", 80.5), (1, "B", 80.0), (1, "C", None), (2, "A", 70.0)]
    q = spark.createDataFrame([("s", 2024, *r) for r in rows], "source string, year int, round_number int, driver_id string, q3_time double")
    assert values(training.qualifying_targets(q).select("round_number", "driver_id", "target")) == [
        (1, "A", 0.5), (1, "B", 0.0), (2, "A", 0.0)]


def test_leakage_filter(spark):
    cal = spark.createDataFrame([(y, r) for y in (2023, 2024, 2025) for r in (1, 2, 3)], "year int, round_number int")
    kept = values(cal.where(training.before_target(2024, 2)))
    assert kept == [(2023, 1), (2023, 2), (2023, 3), (2024, 1), (2025, 1), (2025, 2), (2025, 3)]


def test_split_ignores_partitioning(spark):
    df = spark.range(500).withColumn("k", F.col("id").cast("string"))
    a, b = (values(training.hash_split(df.repartition(n), ["k"])) for n in (1, 6))
    assert a == b and 350 < sum(r[-1] for r in a) < 450


def test_metrics(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": 1, "id": range(30), "target": rng.integers(0, 8, 30) * 1.0, "pred": rng.integers(0, 8, 30) * 1.0})
    df = spark.createDataFrame(frame)
    rho = metrics.spearman(df, ["g"]).first()["spearman"]
    assert rho == pytest.approx(frame["target"].rank().corr(frame["pred"].rank()), rel=1e-12)
    p, t = (set(frame.index[frame[c].rank(method="first") <= 10]) for c in ("pred", "target"))
    assert metrics.top_hit_rate(df, ["g"], ["id"]).first()["hit_rate"] == len(p & t) / 10
    few = spark.createDataFrame([(1, 1, None, 2.0)], "g int, id int, target double, pred double")
    assert metrics.top_hit_rate(few, ["g"], ["id"]).first()["hit_rate"] == 0.0


def _tables(spark, rounds=6, drivers=12):
    rng = np.random.default_rng(4)
    rows = [(r, f"FP{s}", f"D{d:02d}", 90 + d * 0.1 + rng.normal() * 0.05) for r in range(1, rounds + 1) for s in (1, 2, 3) for d in range(drivers)]
    fp = practice.features_from_laps(laps(spark, rows))
    kind = "source string, year int, round_number int, driver_id string, position double, q3_time double"
    results = [("s", 2024, r, f"D{d:02d}", float(d + 1), 88 + d * 0.1) for r in range(1, rounds) for d in range(drivers)]
    now = [("s", 2024, rounds, f"D{d:02d}", float(d + 1), None) for d in range(drivers)]
    quali = spark.createDataFrame(results + now, kind)
    race = spark.createDataFrame(results, kind).select(*schemas.DRIVER, "position")
    cal = spark.createDataFrame([("s", 2024, r) for r in range(1, rounds + 1)], "source string, year int, round_number int")
    return Tables(fp, quali, race, standings.standings_before_round(cal, race))


def test_predict_round(spark):
    ridge_only = [m for m in models.candidates() if m.name == "ridge"]
    for mode in ("qualifying", "race"):
        got = predict_round(_tables(spark), mode, 2024, 6, [2022, 2023, 2024], include_standings=True, candidates=ridge_only)
        table = values(got.table, "rank")
        assert [r[0] for r in table] == list(range(1, 11)) and [r[1] for r in table[:3]] == ["D00", "D01", "D02"]
        assert got.model == "ridge" and got.version == "V6" and got.leaderboard.first()["folds"] == 2


def test_predict_without_history(spark):
    got = predict_round(_tables(spark), "race", 2024, 1, [2024])
    assert got.model == "heuristic" and got.version == "V1"
    assert [r[1] for r in values(got.table, "rank")][:2] == ["D00", "D01"]


def test_too_few_events_take_the_first_candidate(spark):
    known = models.candidates(iterations=2)
    got = predict_round(_tables(spark), "race", 2024, 4, [2024], candidates=known)
    assert got.model == known[0].name and got.leaderboard is None and got.table.count() == 10


def test_leaderboard_tie_goes_to_priority(spark):
    board = spark.createDataFrame([("ridge", 2, 1.0, 3), ("hist_gradient_boosting", 1, 1.0, 3)], "name string, priority int, mae double, folds long")
    assert models.best_model(board).first()["name"] == "hist_gradient_boosting"


def test_heuristic_top(spark):
    top = predict_all_heuristic(_tables(spark).practice)
    assert top.count() == 60 and top.where("rank = 1").select("driver_name").distinct().count() <= 2
