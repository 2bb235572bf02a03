"""Form, strength, odds, calibration, intervals, drift and ranking gains on inline tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rows import values

from paddock.operators import football, metrics, reliability


def season(n=300, seed=2, hot=0.5):
    """Matches in which one team plays half of the time."""
    rng = np.random.default_rng(seed)
    teams = [f"t{i}" for i in range(6)]
    rows = []
    for i in range(n):
        home = "t0" if rng.random() < hot else str(rng.choice(teams))
        away = str(rng.choice([t for t in teams if t != home]))
        goals = (None, None) if rng.random() < 0.1 else (int(rng.poisson(1.5)), int(rng.poisson(1.1)))
        rows.append((f"m{i:04d}", f"2024-01-{1 + i * 28 // n:02d}", 2024, "L", home, away, *goals))
    return rows


KIND = "match_id string, date string, season int, league string, home_team_id string, away_team_id string, home_goals int, away_goals int"


def test_form_of_a_hot_team_is_a_rolling_window(spark):
    rows = season()
    got = {(r["match_id"], r["team_id"]): (r["form_points"], r["form_for"], r["form_against"], r["form_matches"]) for r in football.form(spark.createDataFrame(rows, KIND), 4).collect()}
    history: dict[str, list] = {}
    want = {}
    for match, _, _, _, home, away, h, a in rows:
        if h is None:
            continue
        for team, own, other in ((home, h, a), (away, a, h)):
            last = history.setdefault(team, [])[-4:]
            want[match, team] = (*[sum(r[i] for r in last) for i in range(3)], len(last))
        for team, own, other in ((home, h, a), (away, a, h)):
            history[team].append((3 if own > other else int(own == other), own, other))
    assert got == want


def test_strength_of_exact_products(spark):
    """Goals that are products of attack and defence give these back, up to the scale of a league."""
    attack, defence = {"a": 2, "b": 4, "c": 6}, {"a": 1, "b": 2, "c": 3}
    pairs = [(x, y) for x in attack for y in attack if x != y]
    rows = [(f"{x}{y}", "d", 1, "L", x, y, attack[x] * defence[y], attack[y] * defence[x]) for x, y in pairs]
    got = values(football.strength(spark.createDataFrame(rows, KIND)), "team_id")
    assert [r[1:] for r in got] == [(t, pytest.approx(attack[t] / 4), pytest.approx(defence[t] * 4)) for t in "abc"]


def test_fair_probabilities(spark):
    rows = [(1.5, 4.2, 6.5), (2.0, 3.0, 6.0), (1.0, 3.0, 4.0), (None, 2.0, 2.0), (9.0, 9.0, 9.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "h double, d double, a double").select(football.fair_probabilities([F.col(c) for c in "hda"])).collect()]
    assert got[2] is None and got[3] is None
    for (h, d, a), p in zip(rows, got):
        if p:
            assert sum(p) == pytest.approx(1) and math.log(p[0]) / math.log(1 / h) == pytest.approx(math.log(p[2]) / math.log(1 / a))
    assert got[1] == pytest.approx([1 / 2, 1 / 3, 1 / 6])


def test_fair_probabilities_search_once_a_row(spark):
    rows = [(1.31, 4.4, 6.7), (2.05, 3.3, 3.9), (1.02, 30.0, 41.0), (5.0, 5.0, 5.0)]
    odds = spark.createDataFrame(rows, "h double, d double, a double").select(football.fair_probabilities([F.col(c) for c in "hda"]).alias("p"))
    shares = odds.select(*[F.get("p", F.lit(i)) for i in range(3)])
    # One search a row, though three columns are read from it: an expression in a lambda is computed at every step.
    assert shares._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    for row, got in zip(rows, shares.collect()):
        low, high = 0.0, football.WIDEST
        for _ in range(football.HALVINGS):
            middle = (low + high) / 2
            low, high = (middle, high) if sum((1 / o) ** middle for o in row) > 1 else (low, middle)
        assert list(got) == pytest.approx([(1 / o) ** ((low + high) / 2) for o in row], rel=1e-13)


def test_scorelines(spark):
    row = football.scorelines(spark.createDataFrame([(1.6, 0.9)], "home_rate double, away_rate double")).first()
    h, a = ([math.exp(-x) * x**i / math.factorial(i) for i in range(11)] for x in (1.6, 0.9))
    whole = sum(h) * sum(a)
    assert row["p_draw"] == pytest.approx(sum(x * y for x, y in zip(h, a)) / whole)
    assert row["p_home"] + row["p_draw"] + row["p_away"] == pytest.approx(1)
    assert (row["home_score"], row["away_score"]) == (1, 0)


@pytest.mark.parametrize("seed, slope", [(1, 0.0), (2, 1.0), (3, -1.0)])
def test_isotonic_equals_a_loop(spark, monkeypatch, seed, slope):
    monkeypatch.setattr(reliability, "STEPS", 40)
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(600), 2 if seed == 1 else 6)
    y = (rng.random(600) < 0.5 + slope * (p - 0.5)).astype(int)
    rows = [(float(a), int(b)) for a, b in zip(p, y)] + [(None, 1), (0.5, None)]
    got = values(reliability.isotonic(spark.createDataFrame(rows, "p double, outcome int")), "low")
    blocks = []
    for x in sorted(set(p)):
        blocks.append([x, x, int((p == x).sum()), int(y[p == x].sum())])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0], top[1], blocks[-1][2] + top[2], blocks[-1][3] + top[3]]
    assert got == [(pytest.approx(a), pytest.approx(b), n, pytest.approx(s / n)) for a, b, n, s in blocks]


def test_probability_scores_and_calibration(spark):
    df = spark.createDataFrame([("g", 0.25, 0), ("g", 0.75, 1), ("g", 1.0, 1), ("g", 0.0, 0), ("g", None, 1)], "g string, p double, outcome int")
    row = reliability.probability_scores(df, ["g"]).first()
    assert row["rows"] == 4 and row["log_loss"] == pytest.approx(-math.log(0.75) / 2) and row["brier"] == pytest.approx(0.03125)
    table = values(reliability.calibration_table(df, ["g"], 2).select("bin", "rows", "mean_p", "share", "expected_gap"))
    assert table == [(0, 2, 0.125, 0.0, 0.125), (1, 2, 0.875, 1.0, 0.125)]


def test_intervals_cover(spark):
    """The share of new targets within the range is near the level; too few residuals leave it open."""
    rng = np.random.default_rng(8)
    old, new = rng.normal(size=800), rng.normal(size=4000)
    residuals = spark.createDataFrame([("a", float(x)) for x in old] + [("b", 1.0), ("a", None)], "g string, residual double")
    widths = reliability.conformal_widths(residuals, ["g"], [0.5, 0.9])
    got = {(r["g"], r["level"]): r["width"] for r in widths.collect()}
    sizes = np.sort(np.abs(old))
    assert got == {("a", 0.5): sizes[math.ceil(801 * 0.5) - 1], ("a", 0.9): sizes[math.ceil(801 * 0.9) - 1], ("b", 0.5): 1.0, ("b", 0.9): None}
    rows = reliability.with_intervals(spark.createDataFrame(pd.DataFrame({"g": "a", "pred": 0.0, "target": new})), widths, ["g"])
    shares = dict(rows.groupBy("level").agg(F.avg(F.col("target").between(F.col("low"), F.col("high")).cast("double"))).collect())
    assert shares[0.5] == pytest.approx(0.5, abs=0.05) and shares[0.9] == pytest.approx(0.9, abs=0.03)


def test_drift(spark):
    rng = np.random.default_rng(9)
    parts = {1: rng.integers(0, 40, 500), 2: rng.integers(0, 40, 300), 3: rng.integers(20, 60, 400)}
    df = spark.createDataFrame([(k, int(x)) for k, xs in parts.items() for x in xs] + [(2, None)], "year int, v long")
    ks = dict(reliability.largest_gap(df, "year", "v", 1).collect())
    for k, xs in parts.items():
        want = max(abs((xs <= v).mean() - (parts[1] <= v).mean()) for v in range(60))
        assert ks[k] == pytest.approx(want)
    psi = {r["year"]: r["psi"] for r in reliability.stability_index(df, "year", "v", 1).collect()}
    assert psi[1] == 0 and psi[2] < 0.2 < psi[3]
    edges = reliability.quantile_edges(df.where("year = 1"), "v", 10).first()[0]
    ordered = np.sort(parts[1])
    assert edges == sorted({int(ordered[math.ceil(500 * i / 10) - 1]) for i in range(1, 10)})
    sketches = reliability.sketched_edges(df, ["year"], "v", 4)
    for r in sketches.collect():
        xs = np.sort(parts[r["year"]])
        assert all(abs((xs <= e).mean() - q) < 0.08 for e, q in zip(r["edges"], (0.25, 0.5, 0.75)))
    merged = sketches.agg(F.expr("kll_sketch_get_n_double(kll_merge_agg_double(sketch))")).first()[0]
    assert merged == 1200


def test_ndcg_shares_discounts_of_ties(spark):
    rows = [("e", 1.0, 1.0), ("e", 1.0, 3.0), ("e", 2.0, 2.0), ("e", 5.0, 30.0), ("x", 1.0, 20.0), ("e", None, 1.0), ("e", 1.0, None)]
    got = dict(metrics.ndcg(spark.createDataFrame(rows, "g string, pred double, target double"), ["g"]).collect())
    d = [1 / math.log2(r + 1) for r in (1, 2, 3)]
    assert got["e"] == pytest.approx(((10 + 8) * (d[0] + d[1]) / 2 + 9 * d[2]) / (10 * d[0] + 9 * d[1] + 8 * d[2]))
    assert got["x"] is None
