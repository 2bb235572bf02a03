"""Form, strength, odds, calibration, intervals and drift over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.operators import football, metrics, reliability
from paddock.schemas import DRIVER
from paddock.session import cut_lineage
from workload import views
from workload.registry import register
from workload.sqlviews import with_views

# -- football ----------------------------------------------------------------

_SIDES = """, sides AS (
  SELECT match_id, date, season, league, home_team_id AS team_id, away_team_id AS opponent_id, home_goals AS gf, away_goals AS ga,
    CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS points
  FROM matches WHERE home_goals IS NOT NULL AND away_goals IS NOT NULL
  UNION ALL
  SELECT match_id, date, season, league, away_team_id, home_team_id, away_goals, home_goals,
    CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END
  FROM matches WHERE home_goals IS NOT NULL AND away_goals IS NOT NULL)"""

_FORM = (
    _SIDES
    + """, form AS (
  SELECT match_id, league, team_id, coalesce(sum(points) OVER w, 0)::BIGINT AS form_points, coalesce(sum(gf) OVER w, 0)::BIGINT AS form_for,
    coalesce(sum(ga) OVER w, 0)::BIGINT AS form_against, count(*) OVER w AS form_matches, points
  FROM sides WINDOW w AS (PARTITION BY league, team_id ORDER BY date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""
)


@register("form", with_views(_FORM + " SELECT match_id, league, team_id, form_points, form_for, form_against, form_matches FROM form", "matches"))
def form(spark, d):
    rows = football.form(views.matches(spark, d))
    return rows.select("match_id", "league", "team_id", "form_points", "form_for", "form_against", "form_matches")


@register(
    "home_advantage",
    with_views(
        """SELECT league, season, count(*) AS matches, avg(home_goals - away_goals) AS goals_more,
             avg(CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals < away_goals THEN -3 ELSE 0 END) AS points_more,
             avg((home_goals > away_goals)::INT) AS home_share, avg((home_goals = away_goals)::INT) AS draw_share,
             avg((home_goals < away_goals)::INT) AS away_share
           FROM matches WHERE home_goals IS NOT NULL AND away_goals IS NOT NULL GROUP BY ALL""",
        "matches",
    ),
)
def home_advantage(spark, d):
    return football.home_advantage(views.matches(spark, d))


_STRENGTH = """
WITH RECURSIVE matches AS ({matches}) {sides},
pairs AS (SELECT league, team_id, opponent_id, count(*) AS n, sum(gf) AS scored, sum(ga) AS conceded FROM sides GROUP BY ALL),
state AS (
  SELECT DISTINCT 0 AS turn, league, team_id, 1.0::DOUBLE AS attack, 1.0::DOUBLE AS defence FROM pairs
  UNION ALL
  SELECT s.turn + 1, p.league, p.team_id,
    CASE WHEN s.turn % 2 = 0 THEN coalesce(sum(p.scored) / nullif(sum(p.n * o.defence), 0), 0) ELSE any_value(s.attack) END,
    CASE WHEN s.turn % 2 = 1 THEN coalesce(sum(p.conceded) / nullif(sum(p.n * o.attack), 0), 0) ELSE any_value(s.defence) END
  FROM pairs p JOIN state s ON s.league = p.league AND s.team_id = p.team_id
    JOIN state o ON o.league = p.league AND o.team_id = p.opponent_id AND o.turn = s.turn
  WHERE s.turn < 60 GROUP BY s.turn, p.league, p.team_id),
last AS (SELECT *, avg(attack) OVER (PARTITION BY league) AS mean FROM state WHERE turn = 60)
SELECT league, team_id, round(attack / mean, 6) AS attack, round(defence * mean, 6) AS defence FROM last
"""


def _strength_sql() -> str:
    from workload.sqlviews import VIEWS

    return _STRENGTH.format(matches=VIEWS["matches"][1], sides=_SIDES)


@register("strength", _strength_sql())
def strength(spark, d):
    found = football.strength(views.matches(spark, d))
    return found.select("league", "team_id", *[F.round(c, 6).alias(c) for c in ("attack", "defence")])


_ODDS = "1.3 + (o_custkey % 37) / 10.0", "2.1 + (o_orderkey % 23) / 10.0", "1.4 + ((o_custkey + o_orderkey) % 53) / 10.0"


@register(
    "fair_odds",
    f"""WITH RECURSIVE o AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS match_id, 1 / ({_ODDS[0]})::DOUBLE AS a, 1 / ({_ODDS[1]})::DOUBLE AS b, 1 / ({_ODDS[2]})::DOUBLE AS c FROM orders),
search AS (
  SELECT 0 AS step, match_id, a, b, c, 0.0::DOUBLE AS low, 64.0::DOUBLE AS high FROM o
  UNION ALL
  SELECT step + 1, match_id, a, b, c,
    CASE WHEN pow(a, (low + high) / 2) + pow(b, (low + high) / 2) + pow(c, (low + high) / 2) > 1 THEN (low + high) / 2 ELSE low END,
    CASE WHEN pow(a, (low + high) / 2) + pow(b, (low + high) / 2) + pow(c, (low + high) / 2) > 1 THEN high ELSE (low + high) / 2 END
  FROM search WHERE step < 60)
SELECT match_id, round(pow(a, (low + high) / 2), 9) AS p_home, round(pow(b, (low + high) / 2), 9) AS p_draw, round(pow(c, (low + high) / 2), 9) AS p_away
FROM search WHERE step = 60""",
)
def fair_odds(spark, d):
    """Probabilities behind odds made of the order's numbers."""
    odds = [F.expr(x.replace("/ 10.0", "/ 10.0D").replace("1.3", "1.3D").replace("2.1", "2.1D").replace("1.4", "1.4D")) for x in _ODDS]
    rows = views.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("match_id"), football.fair_probabilities(odds).alias("p"))
    return rows.select("match_id", *[F.round(F.get("p", F.lit(i)), 9).alias(f"p_{x}") for i, x in enumerate(("home", "draw", "away"))])


_RATES = """, scored AS (SELECT league, home_team_id, avg(home_goals) AS home_rate FROM matches WHERE home_goals IS NOT NULL GROUP BY ALL),
  away_scored AS (SELECT league, away_team_id, avg(away_goals) AS away_rate FROM matches WHERE away_goals IS NOT NULL GROUP BY ALL),
  rates AS (SELECT league, match_id, home_rate, away_rate FROM matches JOIN scored USING (league, home_team_id) JOIN away_scored USING (league, away_team_id))"""


@register(
    "scorelines",
    with_views(
        _RATES
        + """, goals AS (SELECT unnest(generate_series(0, 10)) AS g),
  cells AS (
    SELECT match_id, h.g AS i, a.g AS j, exp(-home_rate) * pow(home_rate, h.g) / factorial(h.g::INT) * exp(-away_rate) * pow(away_rate, a.g) / factorial(a.g::INT) AS p
    FROM rates, goals h, goals a)
  SELECT match_id, round(sum(CASE WHEN i > j THEN p ELSE 0 END) / sum(p), 9) AS p_home, round(sum(CASE WHEN i = j THEN p ELSE 0 END) / sum(p), 9) AS p_draw,
    round(sum(CASE WHEN i < j THEN p ELSE 0 END) / sum(p), 9) AS p_away FROM cells GROUP BY match_id""",
        "matches",
    ),
)
def scorelines(spark, d):
    """Outcomes of every match from the mean goals of its home side at home and of its away side away."""
    matches = views.matches(spark, d)
    done = football.played(matches)
    home = done.groupBy("league", "home_team_id").agg(F.avg("home_goals").alias("home_rate"))
    away = done.groupBy("league", "away_team_id").agg(F.avg("away_goals").alias("away_rate"))
    rates = matches.select("match_id", "league", "home_team_id", "away_team_id").join(home, ["league", "home_team_id"]).join(away, ["league", "away_team_id"])
    return football.scorelines(rates).select("match_id", *[F.round(f"p_{x}", 9).alias(f"p_{x}") for x in ("home", "draw", "away")])


# -- probabilities -----------------------------------------------------------

_CHANCES = _FORM + """, chances AS (
  SELECT league, season, (1 + h.form_points) / (2.0::DOUBLE + h.form_points + a.form_points) AS p, (h.points = 3)::INT AS outcome
  FROM matches m JOIN form h ON h.match_id = m.match_id AND h.league = m.league AND h.team_id = m.home_team_id
    JOIN form a ON a.match_id = m.match_id AND a.league = m.league AND a.team_id = m.away_team_id)"""
_CHANCES = _CHANCES.replace("SELECT league, season, (1 +", "SELECT m.league, m.season, m.match_id, (1 +")


def _chances(spark, d):
    """Chance of a home win by the points of both sides' last matches."""
    matches = views.matches(spark, d)
    rows = cut_lineage(football.form(matches), "form")
    home = rows.where("at_home").select("match_id", "league", "season", F.col("form_points").alias("h"), (F.col("points") == 3).cast("int").alias("outcome"))
    away = rows.where("NOT at_home").select("match_id", F.col("form_points").alias("a"))
    return home.join(away, "match_id").withColumn("p", (1 + F.col("h")) / (F.lit(2.0) + F.col("h") + F.col("a")))


@register(
    "probability_scores",
    with_views(
        _CHANCES
        + """ SELECT league, season, count(*) AS rows, round(-avg(CASE WHEN outcome = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss,
               round(avg((p - outcome) * (p - outcome)), 9) AS brier FROM chances GROUP BY ALL""",
        "matches",
    ),
)
def probability_scores(spark, d):
    scores = reliability.probability_scores(_chances(spark, d), ["league", "season"])
    return scores.withColumns({c: F.round(c, 9) for c in ("log_loss", "brier")})


@register(
    "calibration",
    with_views(
        _CHANCES
        + """, bins AS (SELECT league, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS rows, avg(p) AS mean_p, avg(outcome) AS share FROM chances GROUP BY ALL)
              SELECT league, bin, rows, round(mean_p, 9) AS mean_p, round(share, 9) AS share,
                round(sum(rows * abs(mean_p - share)) OVER (PARTITION BY league) / sum(rows) OVER (PARTITION BY league), 9) AS expected_gap FROM bins""",
        "matches",
    ),
)
def calibration(spark, d):
    table = reliability.calibration_table(_chances(spark, d), ["league"])
    return table.withColumns({c: F.round(c, 9) for c in ("mean_p", "share", "expected_gap")})


@register(
    "isotonic",
    with_views(
        _CHANCES
        + """, points AS (SELECT p, count(*) AS n, sum(outcome) AS s, row_number() OVER (ORDER BY p) AS k FROM chances GROUP BY p),
  sums AS (SELECT k, p, sum(n) OVER (ORDER BY k) AS n, sum(s) OVER (ORDER BY k) AS s FROM points),
  runs AS (SELECT a.k AS j, b.k AS k, (b.s - coalesce(c.s, 0)) / (b.n - coalesce(c.n, 0))::DOUBLE AS m
    FROM points a JOIN sums b ON b.k >= a.k LEFT JOIN sums c ON c.k = a.k - 1),
  least_after AS (SELECT r.j, i.k AS i, min(m) AS m FROM runs r JOIN points i ON i.k >= r.j AND r.k >= i.k GROUP BY ALL),
  fitted AS (SELECT i, max(m) AS value FROM least_after GROUP BY i)
  SELECT min(p) AS low, max(p) AS high, CAST(sum(n) AS BIGINT) AS n, round(value, 9) AS value FROM fitted JOIN points ON k = i GROUP BY value""",
        "matches",
    ),
)
def isotonic(spark, d):
    return reliability.isotonic(_chances(spark, d)).withColumn("value", F.round("value", 9))


# -- rankings and intervals --------------------------------------------------


@register(
    "ndcg_at_10",
    with_views(
        """, g AS (SELECT event_key, qualy_position AS pred, greatest(11 - target, 0) AS gain,
               rank() OVER (PARTITION BY event_key ORDER BY qualy_position) AS first, count(*) OVER (PARTITION BY event_key, qualy_position) AS ties,
               row_number() OVER (PARTITION BY event_key ORDER BY target) AS best FROM train_race),
           d AS (SELECT r, 1 / log2(r + 1) AS w FROM (SELECT unnest(generate_series(1, 10)) AS r)),
           found AS (SELECT event_key, sum(gain * w / ties) AS v FROM g JOIN d ON r >= first AND r < first + ties GROUP BY event_key),
           ideal AS (SELECT event_key, sum(gain * w) AS v FROM g JOIN d ON r = best GROUP BY event_key)
           SELECT i.event_key, round(coalesce(f.v, 0) / nullif(i.v, 0), 9) AS ndcg FROM ideal i LEFT JOIN found f USING (event_key)""",
        "train_race",
    ),
)
def ndcg_at_10(spark, d):
    graded = cut_lineage(views.train_race(spark, d).select("event_key", "target", F.col("qualy_position").alias("pred")), "graded")
    return metrics.ndcg(graded, ["event_key"]).withColumn("ndcg", F.round("ndcg", 9))


def _graded(spark, d):
    """Grid position as the prediction of the finishing position."""
    rows = views.train_race(spark, d).select("event_key", "driver_id", "target", F.col("qualy_position").alias("pred"))
    return cut_lineage(rows, "graded")


@register(
    "surprises",
    with_views(
        """SELECT event_key, driver_id, target - qualy_position AS gap,
             row_number() OVER (PARTITION BY event_key ORDER BY abs(target - qualy_position) DESC, driver_id) AS place
           FROM train_race QUALIFY place <= 3""",
        "train_race",
    ),
)
def surprises(spark, d):
    found = metrics.surprises(_graded(spark, d), ["event_key"], ["driver_id"])
    return found.select("event_key", "driver_id", "gap", F.col("place").cast("bigint").alias("place"))


@register(
    "confident_and_wrong",
    with_views(
        _CHANCES
        + """, missed AS (SELECT league, match_id, outcome, CASE WHEN outcome = 1 THEN 1 - p ELSE p END AS missed FROM chances)
              SELECT league, match_id, round(missed, 9) AS missed, row_number() OVER (PARTITION BY league ORDER BY missed.missed DESC, match_id) AS place
              FROM missed WHERE missed.missed >= 0.8 QUALIFY place <= 10""",
        "matches",
    ),
)
def confident_and_wrong(spark, d):
    found = metrics.confident_and_wrong(_chances(spark, d), ["league"], ["match_id"])
    return found.select("league", "match_id", F.round("missed", 9).alias("missed"), F.col("place").cast("bigint").alias("place"))


@register(
    "baseline_gap",
    with_views(
        """, m AS (SELECT *, avg(target) OVER (PARTITION BY event_key) AS mean FROM train_race),
           e AS (SELECT event_key, avg(abs(target - qualy_position)) AS mae, avg(abs(target - mean)) AS baseline FROM m GROUP BY event_key)
           SELECT event_key, round(mae, 9) AS mae, round(baseline, 9) AS baseline, round(baseline - mae, 9) AS gap FROM e""",
        "train_race",
    ),
)
def baseline_gap(spark, d):
    return metrics.baseline_gap(_graded(spark, d), ["event_key"]).withColumns({c: F.round(c, 9) for c in ("mae", "baseline", "gap")})


_WIDTHS = """, seasons AS (SELECT *, abs(target - qualy_position) AS residual FROM train_race),
  sized AS (SELECT event_year, residual, row_number() OVER (PARTITION BY event_year ORDER BY residual) AS place, count(*) OVER (PARTITION BY event_year) AS n FROM seasons),
  levels AS (SELECT unnest([0.5, 0.8, 0.9]) AS level),
  widths AS (SELECT event_year, level::DOUBLE AS level, max(CASE WHEN place = ceil((n + 1) * level) THEN residual END) AS width FROM sized, levels GROUP BY ALL)"""
LEVELS = (0.5, 0.8, 0.9)


def _widths(spark, d):
    """Residuals of the grid as a prediction of the finish, season by season."""
    train = cut_lineage(views.train_race(spark, d), "race")
    residuals = train.withColumn("residual", F.col("target") - F.col("qualy_position"))
    return train, reliability.conformal_widths(residuals, ["event_year"], LEVELS)


@register("interval_widths", with_views(_WIDTHS + " SELECT * FROM widths", "train_race"))
def interval_widths(spark, d):
    return _widths(spark, d)[1]


@register(
    "position_ranges",
    with_views(
        _WIDTHS
        + f""" SELECT source, year, round_number, driver_id, level, qualy_position - width AS low, qualy_position + width AS high
               FROM train_race t JOIN widths w ON w.event_year = t.event_year - 1 WHERE width IS NOT NULL""",
        "train_race",
    ),
)
def position_ranges(spark, d):
    """Ranges of finishing positions by the residuals of the season before."""
    train, widths = _widths(spark, d)
    before = widths.where("width IS NOT NULL").withColumn("event_year", F.col("event_year") + 1)
    ranges = reliability.with_intervals(train.withColumn("pred", F.col("qualy_position")), before, ["event_year"])
    return ranges.select(*DRIVER, "level", "low", "high")


# -- drift -------------------------------------------------------------------

_PRICES = "SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem"


def _prices(spark, d):
    return views.laps(spark, d).select("year", F.col("lap_ms").alias("v"))


@register(
    "stability_index",
    f"""WITH r AS ({_PRICES}),
  cuts AS (SELECT list_distinct(quantile_disc(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM r WHERE year = 1995),
  binned AS (SELECT year, len(list_filter(edges, lambda e: e < v)) AS bin, count(*) AS n FROM r, cuts GROUP BY ALL),
  grid AS (SELECT y.year, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT year FROM binned) y CROSS JOIN (SELECT DISTINCT bin FROM binned) b LEFT JOIN binned USING (year, bin)),
  shares AS (SELECT year, bin, sum(n) OVER (PARTITION BY year) AS rows, greatest(n, 0.5::DOUBLE) / sum(n) OVER (PARTITION BY year) AS share FROM grid)
  SELECT s.year, CAST(max(s.rows) AS BIGINT) AS rows, round(sum((s.share - b.share) * ln(s.share / b.share)), 9) AS psi
  FROM shares s JOIN shares b ON b.bin = s.bin AND b.year = 1995 GROUP BY s.year""",
)
def stability_index(spark, d):
    return reliability.stability_index(_prices(spark, d), "year", "v", 1995).withColumn("psi", F.round("psi", 9))


@register(
    "largest_gap",
    f"""WITH r AS ({_PRICES}),
  vals AS (SELECT y.year, x.v FROM (SELECT DISTINCT year FROM r) y JOIN (SELECT DISTINCT year, v FROM r) x ON x.year IN (y.year, 1995) GROUP BY ALL),
  own AS (SELECT year, v, count(*) AS n FROM r GROUP BY ALL),
  steps AS (
    SELECT vals.year, vals.v, sum(coalesce(a.n, 0)) OVER w AS mine, sum(coalesce(b.n, 0)) OVER w AS base
    FROM vals LEFT JOIN own a ON a.year = vals.year AND a.v = vals.v LEFT JOIN own b ON b.year = 1995 AND b.v = vals.v
    WINDOW w AS (PARTITION BY vals.year ORDER BY vals.v)),
  sizes AS (SELECT year, count(*) AS n FROM r GROUP BY year)
  SELECT s.year, round(max(abs(s.mine / z.n::DOUBLE - s.base / b.n::DOUBLE)), 9) AS ks
  FROM steps s JOIN sizes z ON z.year = s.year JOIN sizes b ON b.year = 1995 GROUP BY s.year""",
)
def largest_gap(spark, d):
    return reliability.largest_gap(_prices(spark, d), "year", "v", 1995).withColumn("ks", F.round("ks", 9))


# -- counts without rows -----------------------------------------------------


@register(
    "distinct_estimates",
    f"""SELECT CAST(year(l_shipdate) AS INT) AS year, count(DISTINCT l_suppkey) AS exact, TRUE AS near FROM lineitem GROUP BY ALL""",
)
def distinct_estimates(spark, d):
    """Drivers of a season from sketches of its rounds, which are merged without reading rows again."""
    laps = views.laps(spark, d)
    rounds = cut_lineage(laps.groupBy("source", "year", "round_number").agg(F.hll_sketch_agg("driver_id", 14).alias("drivers")), "sketches")
    merged = rounds.groupBy("year").agg(F.hll_sketch_estimate(F.hll_union_agg("drivers")).alias("estimate"))
    exact = laps.select("year", "driver_id").distinct().groupBy("year").agg(F.count("driver_id").alias("exact"))
    # Five times the standard error of 2^14 registers.
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), 5 * 0.0065 * F.col("exact"))
    return merged.join(exact, "year").select("year", "exact", near.alias("near"))
