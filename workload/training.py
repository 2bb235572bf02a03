"""Training frames, models, predictions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.operators import boosting, metrics, models
from paddock.operators.ordering import impute_medians
from paddock.operators.training import race_features, walk_forward_folds
from paddock.operators.walkforward import fit_ridge, fold_errors, fold_predictions, mean_of_folds
from paddock.plans.predict import Tables, predict_round
from paddock.plans.sweep import sweep_predictions, sweep_scores
from paddock.schemas import DELTAS, DRIVER, EVENT, QUALIFYING_FEATURES, RACE_FEATURES
from paddock.session import cut_lineage
from workload import views
from workload.registry import register
from workload.scans import heuristic_top, with_predictions
from workload.sqlviews import with_views

E = "source, year, round_number"
_FEATURES = ", ".join(QUALIFYING_FEATURES)


@register(
    "train_qualifying",
    with_views(f"SELECT {E}, driver_id, {_FEATURES}, target, event_year, event_round, event_key FROM train_qualifying", "train_qualifying"),
)
def train_qualifying(spark, d):
    return views.train_qualifying(spark, d).select(
        *DRIVER, *QUALIFYING_FEATURES, "target", "event_year", "event_round", "event_key"
    )


@register(
    "train_race",
    with_views(f"SELECT {E}, driver_id, {_FEATURES}, qualy_position, target, event_key FROM train_race", "train_race"),
)
def train_race(spark, d):
    return views.train_race(spark, d).select(*DRIVER, *RACE_FEATURES, "target", "event_key")


@register(
    "train_race_standings",
    with_views(
        f"""SELECT {E}, driver_id, qualy_position, target, s.position_start FROM train_race
            LEFT JOIN standings s USING ({E}, driver_id)""",
        "train_race",
        "standings",
    ),
)
def train_race_standings(spark, d):
    return views.train_race(spark, d, with_standings=True).select(*DRIVER, "qualy_position", "target", "position_start")


@register(
    "current_features",
    with_views(
        f"""SELECT {E}, driver_id, {_FEATURES}, CAST(q.position AS DOUBLE) AS qualy_position
            FROM features JOIN quali q USING ({E}, driver_id) WHERE year = 1998 AND round_number = 6""",
        "features",
        "quali",
    ),
)
def current_features(spark, d):
    this = (F.col("year") == 1998) & (F.col("round_number") == 6)
    base = views.by_driver(spark, d).where(this)
    rows = race_features(views.practice_features(spark, d, base), views.quali(spark, d, base))
    return rows.select(*DRIVER, *RACE_FEATURES)


def _materialised(spark, d):
    """Race training rows, written once because every fold and model reads them again."""
    return cut_lineage(views.train_race(spark, d))


def _folds(train):
    return walk_forward_folds(train.select("event_key").distinct())


@register("walk_forward_folds", with_views("SELECT event_key, train_events FROM folds", "folds"))
def walk_forward_folds_query(spark, d):
    return _folds(views.train_race(spark, d))


@register(
    "median_impute",
    with_views(
        f""", m AS (SELECT {E}, quantile_cont(fp1_delta, 0.5) AS m1, quantile_cont(fp2_delta, 0.5) AS m2,
               quantile_cont(fp3_delta, 0.5) AS m3, quantile_cont(fp_mean_delta, 0.5) AS m4 FROM features GROUP BY ALL)
           SELECT {E}, driver_id, coalesce(CAST(fp1_delta AS DOUBLE), m1, 0) AS fp1_delta, coalesce(CAST(fp2_delta AS DOUBLE), m2, 0) AS fp2_delta,
             coalesce(CAST(fp3_delta AS DOUBLE), m3, 0) AS fp3_delta, round(coalesce(fp_mean_delta, m4, 0), 6) AS fp_mean_delta
           FROM features JOIN m USING ({E})""",
        "features",
    ),
)
def median_impute(spark, d):
    features = views.practice_features(spark, d).select(*DRIVER, *DELTAS)
    filled = impute_medians(features, EVENT, DELTAS)
    return filled.select(*DRIVER, *DELTAS[:3], F.round("fp_mean_delta", 6).alias("fp_mean_delta"))


# -- ridge -------------------------------------------------------------------

_TRAIN_SQL = """, {p}_tr AS (SELECT f.event_key AS fold, t.target AS y, CAST(t.{x} AS DOUBLE) AS x FROM folds f JOIN train_race t ON t.event_key < f.event_key),
  {p}_med AS (SELECT fold, quantile_cont(x, 0.5) AS m FROM {p}_tr GROUP BY fold),
  {p}_sum AS (SELECT fold, count(*) AS n, sum(coalesce(x, m, 0)) AS sx, sum(y) AS sy, sum(coalesce(x, m, 0) * coalesce(x, m, 0)) AS sxx,
      sum(coalesce(x, m, 0) * y) AS sxy FROM {p}_tr JOIN {p}_med USING (fold) GROUP BY fold),
  {p}_fit AS (SELECT fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS w, n, sx, sy FROM {p}_sum),
  {p}_vmed AS (SELECT event_key, quantile_cont(CAST({x} AS DOUBLE), 0.5) AS m FROM train_race GROUP BY event_key),
  {p}_err AS (SELECT t.event_key, avg(abs(t.target - ((sy - w * sx) / n + w * coalesce(CAST(t.{x} AS DOUBLE), v.m, 0)))) AS mae
      FROM train_race t JOIN {p}_fit ON fold = t.event_key JOIN {p}_vmed v ON v.event_key = t.event_key GROUP BY t.event_key)"""


def _walk_sql(p: str, x: str) -> str:
    return _TRAIN_SQL.format(p=p, x=x)


@register(
    "fold_errors",
    with_views(_walk_sql("a", "fp1_delta") + " SELECT event_key, round(mae, 6) AS mae FROM a_err", "folds"),
)
def fold_errors_query(spark, d):
    train = _materialised(spark, d)
    errors = fold_errors(fold_predictions(train, ["fp1_delta"], _folds(train)))
    return errors.select("event_key", F.round("mae", 6).alias("mae"))


@register(
    "walk_forward_mae",
    with_views(_walk_sql("a", "fp_mean_rank") + " SELECT round(avg(mae), 6) AS mae, count(*) AS folds FROM a_err", "folds"),
)
def walk_forward_mae(spark, d):
    train = _materialised(spark, d)
    score = mean_of_folds(fold_errors(fold_predictions(train, ["fp_mean_rank"], _folds(train))))
    return score.select(F.round("mae", 6).alias("mae"), "folds")


@register("walk_forward_predictions")
def walk_forward_predictions(spark, d):
    """All race features, every fold: fitted in one job and scored on its validation event."""
    train = _materialised(spark, d)
    scored = fold_predictions(train, list(RACE_FEATURES), _folds(train))
    return scored.select(*DRIVER, "event_key", "target", "pred")


def _single_feature(name: str, priority: int, feature: str) -> models.Candidate:
    return models.Candidate(
        name,
        priority,
        lambda train, features, folds: models.ridge_errors(train, [feature], folds),
        lambda train, current, features: models.ridge_predict(train, current, [feature]),
    )


def _board(spark, d):
    """Two ridge models on one feature each, so that SQL can check the scores."""
    train = _materialised(spark, d)
    known = [_single_feature("gap", 0, "fp1_delta"), _single_feature("grid", 1, "qualy_position")]
    return models.leaderboard(train, [], _folds(train), known)


_BOARD_SQL = _walk_sql("a", "fp1_delta") + _walk_sql("b", "qualy_position") + """, board AS (
  SELECT 'gap' AS name, CAST(0 AS INT) AS priority, avg(mae) AS mae, count(*) AS folds FROM a_err
  UNION ALL SELECT 'grid', 1, avg(mae), count(*) FROM b_err)"""


@register("leaderboard", with_views(_BOARD_SQL + " SELECT name, priority, round(mae, 6) AS mae, folds FROM board", "folds"))
def leaderboard(spark, d):
    return _board(spark, d).withColumn("mae", F.round("mae", 6))


@register(
    "model_select",
    with_views(_BOARD_SQL + " SELECT name, round(mae, 6) AS mae FROM board ORDER BY board.mae, priority LIMIT 1", "folds"),
)
def model_select(spark, d):
    return models.best_model(_board(spark, d)).withColumn("mae", F.round("mae", 6))


@register(
    "ridge_fit",
    with_views(
        """, m AS (SELECT quantile_cont(CAST(fp2_delta AS DOUBLE), 0.5) AS m FROM train_race),
           s AS (SELECT count(*) AS n, sum(coalesce(fp2_delta, m, 0)) AS sx, sum(target) AS sy,
             sum(coalesce(fp2_delta, m, 0) * coalesce(fp2_delta, m, 0)) AS sxx, sum(coalesce(fp2_delta, m, 0) * target) AS sxy FROM train_race, m),
           f AS (SELECT (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS w, n, sx, sy FROM s)
           SELECT round((sy - w * sx) / n, 6) AS intercept, round(w * 1e6, 4) AS weight_millionths FROM f""",
        "train_race",
    ),
)
def ridge_fit(spark, d):
    model = fit_ridge(_materialised(spark, d), ["fp2_delta"])
    return model.select(
        F.round("intercept", 6).alias("intercept"), F.round(F.col("weights")[0] * 1e6, 4).alias("weight_millionths")
    )


@register("gbt_fit")
def gbt_fit(spark, d):
    """Boosted trees on all race rows, scored on the same rows."""
    tree = next(m for m in models.candidates() if m.name == "hist_gradient_boosting")
    train = _materialised(spark, d)
    return tree.predict(train, train, list(RACE_FEATURES)).select(*DRIVER, "target", "pred")


_GROUPED = ", grouped AS (SELECT *, CASE WHEN fp3_delta IS NOT NULL THEN 1 ELSE 0 END AS g FROM train_race)"
#: On a feature of two values trees end at the group means, so that SQL can check them; long steps get there sooner.
_GROUP_SETTINGS = boosting.Settings(iterations=60, step=0.5)


def _grouped(rows):
    return rows.withColumn("g", F.col("fp3_delta").isNotNull().cast("double"))


@register(
    "gbt_groups",
    with_views(
        _GROUPED
        + f""", sized AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, count(*) OVER () AS total, avg(target) OVER (PARTITION BY g) AS own,
                avg(target) OVER () AS every FROM grouped)
              SELECT {E}, driver_id, target, round(CASE WHEN n >= 20 AND total - n >= 20 THEN own ELSE every END, 6) AS pred FROM sized""",
        "train_race",
    ),
)
def gbt_groups(spark, d):
    """Boosted trees on one feature of two values."""
    train = cut_lineage(_grouped(views.train_race(spark, d)))
    forest = boosting.fit(train, ["g"], settings=_GROUP_SETTINGS).forest
    return boosting.score(forest, train, ["g"]).select(*DRIVER, "target", F.round("pred", 6).alias("pred"))


_GROUP_ERRORS = (
    _GROUPED
    + """, before AS (SELECT f.event_key AS fold, g, target FROM folds f JOIN grouped t ON t.event_key < f.event_key),
  own AS (SELECT fold, g, count(*) AS n, avg(target) AS m FROM before GROUP BY ALL),
  every AS (SELECT fold, count(*) AS n, avg(target) AS m FROM before GROUP BY ALL),
  errors AS (
    SELECT t.event_key, round(avg(abs(t.target - CASE WHEN own.n >= 20 AND every.n - own.n >= 20 THEN own.m ELSE every.m END)), 6) AS mae
    FROM grouped t JOIN every ON every.fold = t.event_key LEFT JOIN own ON own.fold = t.event_key AND own.g = t.g GROUP BY ALL)"""
)


@register("gbt_fold_errors", with_views(_GROUP_ERRORS + " SELECT * FROM errors", "folds"))
def gbt_fold_errors(spark, d):
    """Boosted trees on one feature of two values, all folds in one fit."""
    train = cut_lineage(_grouped(views.train_race(spark, d)))
    errors = models.BoostedTrees(_GROUP_SETTINGS).errors(train, ["g"], _folds(train))
    return errors.select("event_key", F.round("mae", 6).alias("mae"))


# -- predictions -------------------------------------------------------------


@register("predict_heuristic", with_predictions("SELECT * FROM top"))
def predict_heuristic(spark, d):
    return heuristic_top(spark, d)


@register(
    "predict_top_n",
    with_views(
        f"""SELECT {E}, row_number() OVER (PARTITION BY {E} ORDER BY fp_mean_rank, driver_id) AS rank, driver_name, fp_mean_rank AS pred
            FROM features QUALIFY rank <= 10""",
        "features",
    ),
)
def predict_top_n(spark, d):
    from paddock.plans.predict import top_table

    top = top_table(views.practice_features(spark, d).withColumn("pred", F.col("fp_mean_rank")), EVENT)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


def _tables(spark, d) -> Tables:
    base = views.by_driver(spark, d)
    quali = views.quali(spark, d, base).drop("q3_time").withColumnRenamed("q3_ms", "q3_time")
    races = cut_lineage(views.race(spark, d, base), "race")
    return Tables(views.practice_features(spark, d, base), quali, races, views.standings(spark, d, races))


@register("predict_qualifying")
def predict_qualifying(spark, d):
    """Model chosen among boosted trees and ridge on the earlier rounds of the season."""
    known = models.candidates()
    return predict_round(
        _tables(spark, d), "qualifying", 1998, 6, [1996, 1997, 1998], candidates=known, every_candidate=True
    ).table


@register("predict_race")
def predict_race(spark, d):
    """Ridge on three seasons with standings."""
    ridge = [m for m in models.candidates() if m.name == "ridge"]
    return predict_round(
        _tables(spark, d), "race", 1998, 6, [1996, 1997, 1998], include_standings=True, candidates=ridge, every_candidate=True
    ).table


@register(
    "sweep_scores",
    with_predictions(
        """SELECT CAST(round_number AS VARCHAR) AS param_value, round(avg(pred), 6) AS score FROM top
           WHERE year = 1998 AND round_number IN (2, 4, 6) GROUP BY ALL"""
    ),
)
def sweep_scores_query(spark, d):
    """Heuristic predictions of one season, swept over the round."""
    top = heuristic_top(spark, d)

    def predict(year, round_number):
        return top.where((F.col("year") == year) & (F.col("round_number") == round_number))

    scores = sweep_scores(sweep_predictions(predict, {"year": 1998, "round_number": 1}, "round_number", [2, 4, 6]))
    return scores.select("param_value", F.round("score", 6).alias("score"))


# -- metrics -----------------------------------------------------------------


def _scored(spark, d):
    """Grid position as the prediction of the finishing position."""
    return _materialised(spark, d).withColumn("pred", F.col("qualy_position"))


@register("mae", with_views("SELECT event_key, avg(abs(target - qualy_position)) AS mae FROM train_race GROUP BY ALL", "train_race"))
def mae(spark, d):
    graded = views.train_race(spark, d).withColumn("pred", F.col("qualy_position"))
    return metrics.mean_absolute_error(graded, ["event_key"])


@register(
    "spearman",
    with_views(
        """, r AS (SELECT event_key,
             rank() OVER (PARTITION BY event_key ORDER BY target) * 2 + count(*) OVER (PARTITION BY event_key, target) - 1 AS x,
             rank() OVER (PARTITION BY event_key ORDER BY qualy_position) * 2 + count(*) OVER (PARTITION BY event_key, qualy_position) - 1 AS y
             FROM train_race),
           s AS (SELECT event_key, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy,
             CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(y * y) AS DOUBLE) AS syy, CAST(sum(x * y) AS DOUBLE) AS sxy FROM r GROUP BY ALL)
           SELECT event_key, round((n * sxy - sx * sy) / nullif(sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 0), 9) AS spearman FROM s""",
        "train_race",
    ),
)
def spearman(spark, d):
    graded = cut_lineage(views.train_race(spark, d).withColumn("pred", F.col("qualy_position")), "graded")
    return metrics.spearman(graded, ["event_key"]).withColumn("spearman", F.round("spearman", 9))


_TOPS = """, p AS (SELECT event_key, driver_id FROM train_race QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY qualy_position, driver_id) <= 10),
  t AS (SELECT event_key, driver_id FROM train_race QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY target, driver_id) <= 10),
  both_tops AS (SELECT * FROM p INTERSECT SELECT * FROM t)"""


@register(
    "top10_hit_rate",
    with_views(
        _TOPS
        + """ SELECT event_key, coalesce(h, 0) / 10.0::DOUBLE AS hit_rate FROM (SELECT DISTINCT event_key FROM train_race)
              LEFT JOIN (SELECT event_key, count(*) AS h FROM both_tops GROUP BY ALL) USING (event_key)""",
        "train_race",
    ),
)
def top10_hit_rate(spark, d):
    return metrics.top_hit_rate(_scored(spark, d), ["event_key"], ["driver_id"])


@register("top10_intersect", with_views(_TOPS + " SELECT * FROM both_tops", "train_race"))
def top10_intersect(spark, d):
    return metrics.top_overlap(_scored(spark, d), ["event_key"], ["driver_id"])


@register(
    "summary_stats",
    """SELECT l_returnflag, count(c) AS n, sum(c)::DOUBLE / count(c) AS mean, min(c) AS min, max(c) AS max, max(c) - min(c) AS range
       FROM (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) GROUP BY ALL""",
)
def summary_stats(spark, d):
    rows = views.table(spark, d, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"))
    return metrics.summary_stats(rows, ["l_returnflag"], "c")


@register(
    "hash_split",
    with_views(
        """SELECT source, year, round_number, driver_id, event_key, target,
             ('0x' || substr(md5('7:' || source || ':' || year || ':' || round_number || ':' || driver_id), 1, 8))::BIGINT % 100 < 80 AS in_train
           FROM train_race""",
        "train_race",
    ),
)
def hash_split(spark, d):
    """Repeatable 80/20 split of the training rows."""
    from paddock.operators.training import hash_split as split

    return split(views.train_race(spark, d).select(*DRIVER, "event_key", "target"), list(DRIVER))
