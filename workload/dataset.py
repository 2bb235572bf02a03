"""Practice features, standings and the wide dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.operators import dataset as ds
from paddock.operators.ordering import keep_last
from paddock.operators.practice import (
    best_laps,
    driver_names,
    find_meeting,
    number_meetings,
    practice_wide,
    practice_wide_by_joins,
    session_features,
    session_keys,
)
from paddock.operators.standings import standings_after_previous_round
from paddock.schemas import DRIVER, EVENT, SESSIONS
from paddock.session import cut_lineage
from paddock.sources.sinks import in_order
from workload import views
from workload.registry import register
from workload.sqlviews import with_views

E = "source, year, round_number"


@register("best_lap", with_views("SELECT source, year, round_number, session, driver_id, best_lap FROM best", "best"))
def best_lap(spark, d):
    return best_laps(views.laps(spark, d), EVENT, "lap_ms")


def _scored(spark, d):
    return session_features(cut_lineage(best_laps(views.laps(spark, d), EVENT, "lap_ms"), "best"), EVENT)


@register(
    "fp_session_features",
    with_views("SELECT source, year, round_number, session, driver_id, best_lap, delta, rank FROM scored", "scored"),
)
def fp_session_features(spark, d):
    return _scored(spark, d).select(*EVENT, "session", "driver_id", "best_lap", "delta", "rank")


_WIDE = [*DRIVER, "driver_name", *[f"{s.lower()}_{c}" for s in SESSIONS for c in ("delta", "rank")]]
_WIDE_SQL = with_views(f"SELECT {', '.join(_WIDE)} FROM wide", "wide")


@register("fp_wide_pivot", _WIDE_SQL)
def fp_wide_pivot(spark, d):
    return practice_wide(_scored(spark, d).withColumn("driver_name", F.col("driver_id"))).select(*_WIDE)


@register("fp_wide_outer_join", _WIDE_SQL)
def fp_wide_outer_join(spark, d):
    return practice_wide_by_joins(_scored(spark, d).withColumn("driver_name", F.col("driver_id"))).select(*_WIDE)


@register(
    "fp_row_means",
    with_views(f"SELECT {E}, driver_id, fp_mean_delta, fp_mean_rank FROM features", "features"),
)
def fp_row_means(spark, d):
    return views.practice_features(spark, d).select(*DRIVER, "fp_mean_delta", "fp_mean_rank")


@register(
    "standings_points",
    with_views(f"SELECT {E}, driver_id, points, position_start FROM standings", "standings"),
)
def standings_points(spark, d):
    return views.standings(spark, d).select(*DRIVER, "points", "position_start")


# -- meetings, sessions and drivers, with months as meetings -----------------


def _meetings(spark, d):
    """Months as meetings: the start date is the first order day, missing for every seventh month."""
    months = views.table(spark, d, "orders").select(
        F.lit("api").alias("source"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").cast("bigint").alias("month"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    key = F.col("year") * 100 + F.col("month")
    grouped = months.groupBy("source", "year", "month").agg(F.min("day").alias("first_day"))
    return grouped.select(
        "source",
        "year",
        key.alias("meeting_key"),
        F.concat(F.lit("M"), F.col("month").cast("string")).alias("meeting_name"),
        F.concat(F.lit("C"), (F.col("month") % 3).cast("string")).alias("country_name"),
        F.when(F.col("month") % 7 != 0, F.col("first_day")).alias("date_start"),
        key.alias("ord"),
    )


_MEETINGS_SQL = """meetings AS (
  SELECT 'api' AS source, year, year * 100 + month AS meeting_key, 'M' || month AS meeting_name, 'C' || (month % 3) AS country_name,
    CASE WHEN month % 7 <> 0 THEN first_day END AS date_start
  FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, month(o_orderdate) AS month,
          strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM orders GROUP BY ALL)),
rounds AS (SELECT *, row_number() OVER (PARTITION BY source, year ORDER BY coalesce(date_start, ''), meeting_key) AS round_number FROM meetings)
"""


@register("round_numbering", f"WITH {_MEETINGS_SQL} SELECT source, year, meeting_key, round_number FROM rounds")
def round_numbering(spark, d):
    return number_meetings(_meetings(spark, d)).select(
        "source", "year", "meeting_key", F.col("round_number").cast("bigint").alias("round_number")
    )


@register(
    "meeting_lookup",
    f"""WITH {_MEETINGS_SQL}, hits AS (
          SELECT 1 AS q, meeting_key FROM rounds WHERE year = 1997 AND meeting_name = 'M5'
          UNION ALL (SELECT 2, meeting_key FROM rounds WHERE year = 1997 AND country_name = 'C2' ORDER BY meeting_key LIMIT 1)
          UNION ALL SELECT 3, meeting_key FROM rounds WHERE year = 1997 AND round_number = 1)
        SELECT CAST(q AS INT) AS q, meeting_key FROM hits""",
)
def meeting_lookup(spark, d):
    """The three ways to name a meeting: by name, by country, by round."""
    meetings = _meetings(spark, d)
    ways = [
        find_meeting(meetings, 1997, 3, meeting_name="M5", country_name="C1"),
        find_meeting(meetings, 1997, 3, country_name="C2"),
        find_meeting(meetings, 1997, 1),
    ]
    return ds.union_sources([w.select(F.lit(i + 1).alias("q"), "meeting_key") for i, w in enumerate(ways)])


@register(
    "session_lookup",
    """SELECT l_shipmonth AS meeting_key, session_name, min(session_key) AS session_key FROM (
         SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS l_shipmonth,
           CASE l_returnflag WHEN 'A' THEN 'Practice 1' WHEN 'N' THEN 'Qualifying' ELSE 'Race' END AS session_name,
           l_orderkey AS session_key FROM lineitem) GROUP BY ALL""",
)
def session_lookup(spark, d):
    """Order lines as sessions of a month; the order key is the input position."""
    flag = F.col("l_returnflag")
    sessions = views.table(spark, d, "lineitem").select(
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint").alias("meeting_key"),
        F.when(flag == "A", "Practice 1").when(flag == "N", "Qualifying").otherwise("Race").alias("session_name"),
        F.col("l_orderkey").alias("session_key"),
        F.col("l_orderkey").alias("ord"),
    )
    return session_keys(sessions)


@register(
    "driver_lookup",
    """WITH named AS (
         SELECT session_key, driver_id, arg_max(name, ord) AS name FROM (
           SELECT l_orderkey % 50 AS session_key, CAST(l_suppkey AS VARCHAR) AS driver_id, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS ord,
             CASE WHEN l_partkey % 3 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE 'P' || l_partkey END AS name FROM lineitem) GROUP BY ALL)
       SELECT s_suppkey, k.session_key, coalesce(n.name, CAST(s_suppkey AS VARCHAR)) AS driver_name
       FROM supplier CROSS JOIN (SELECT DISTINCT l_orderkey % 50 AS session_key FROM lineitem) k
         JOIN named n ON n.driver_id = CAST(s_suppkey AS VARCHAR) AND n.session_key = k.session_key""",
)
def driver_lookup(spark, d):
    """Order lines as session drivers; a part without a name falls back to the driver number."""
    lines = views.table(spark, d, "lineitem")
    listed = lines.select(
        (F.col("l_orderkey") % 50).alias("session_key"),
        F.col("l_suppkey").alias("driver_number"),
        F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("name_acronym"),
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    suppliers = views.table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("driver_id"))
    names = driver_names(listed)
    return suppliers.join(names, "driver_id").select(
        "s_suppkey", "session_key", F.coalesce("driver_name", "driver_id").alias("driver_name")
    )


@register(
    "standings_previous_round",
    f"""WITH {_MEETINGS_SQL}, cust AS (SELECT 199501 + c_custkey % 7 * 100 + c_custkey // 7 % 12 AS meeting_key, c_custkey,
            CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 20 + 1 END AS position_start, c_nationkey + 1 AS position_current FROM customer)
        SELECT source, year, CAST(round_number + 1 AS BIGINT) AS round_number, CAST(c_custkey AS VARCHAR) AS driver_id,
          CAST(CASE WHEN position_start = 0 THEN position_current ELSE position_start END AS DOUBLE) AS position_start
        FROM rounds JOIN cust USING (meeting_key)""",
)
def standings_previous_round(spark, d):
    """Customers as standings rows of one race each; the snapshot counts for the next round."""
    key = F.col("c_custkey")
    meeting = (199501 + key % 7 * 100 + F.floor(key / 7) % 12).cast("bigint")
    snapshot = views.table(spark, d, "customer").select(
        meeting.alias("session_key"),
        key.alias("driver_number"),
        F.when(key % 3 == 0, 0).otherwise(key % 20 + 1).cast("int").alias("position_start"),
        (F.col("c_nationkey") + 1).alias("position_current"),
        key.alias("ord"),
    )
    meetings = _meetings(spark, d)
    sessions = meetings.select(
        "meeting_key", F.lit("Race").alias("session_name"), F.col("meeting_key").alias("session_key"), "ord"
    )
    rows = standings_after_previous_round(meetings, sessions, snapshot)
    return rows.select("source", "year", F.col("round_number").cast("bigint").alias("round_number"), "driver_id", "position_start")


# -- dataset -----------------------------------------------------------------


def stacked_kinds(spark, d):
    """The four kinds of every round; race results also feed the standings."""
    base = views.by_driver(spark, d)
    races = cut_lineage(views.race(spark, d, base), "race")
    return ds.stack_kinds(
        views.practice_features(spark, d, base), views.quali(spark, d, base), races, views.standings(spark, d, races)
    )


def merged_kinds(spark, d):
    return ds.merge_kinds(stacked_kinds(spark, d))


_UNIVERSE = f"""drv AS (SELECT {E}, driver_id FROM wide UNION SELECT {E}, driver_id FROM quali
  UNION SELECT {E}, driver_id FROM race UNION SELECT {E}, driver_id FROM standings)"""
_DATASET_SQL = f""", {_UNIVERSE}, dataset AS (
  SELECT c.source, c.event_name, c.year, c.round_number, CAST(c.year * 100 + c.round_number AS INT) AS event_key, drv.driver_id,
    drv.driver_id AS driver_name, CAST(f.fp1_delta AS DOUBLE) AS fp1_delta, CAST(f.fp2_delta AS DOUBLE) AS fp2_delta,
    CAST(f.fp3_delta AS DOUBLE) AS fp3_delta, f.fp_mean_delta, CAST(f.fp1_rank AS INT) AS fp1_rank, CAST(f.fp2_rank AS INT) AS fp2_rank,
    CAST(f.fp3_rank AS INT) AS fp3_rank, f.fp_mean_rank, CAST(q.position AS DOUBLE) AS qualy_position, q.q3_time AS qualy_q3_time,
    CAST(r.position AS DOUBLE) AS race_position, CAST(s.position_start AS DOUBLE) AS standings_position_start
  FROM drv JOIN calendar c USING ({E}) LEFT JOIN features f USING ({E}, driver_id) LEFT JOIN quali q USING ({E}, driver_id)
    LEFT JOIN race r USING ({E}, driver_id) LEFT JOIN standings s USING ({E}, driver_id))
"""
_DATASET_VIEWS = ("features", "quali", "race", "standings", "calendar")


@register("driver_universe", with_views(f", {_UNIVERSE} SELECT *, driver_id AS driver_name FROM drv", *_DATASET_VIEWS))
def driver_universe(spark, d):
    return ds.driver_universe(stacked_kinds(spark, d))


@register("dataset_wide", with_views(f"{_DATASET_SQL} SELECT * FROM dataset", *_DATASET_VIEWS))
def dataset_wide(spark, d):
    return ds.dataset_rows(views.calendar(spark, d), merged_kinds(spark, d))


@register("dataset_sorted", with_views(f"{_DATASET_SQL} SELECT {E}, qualy_position, race_position, driver_id FROM dataset", *_DATASET_VIEWS))
def dataset_sorted(spark, d):
    rows = ds.dataset_rows(views.calendar(spark, d), merged_kinds(spark, d))
    return in_order(rows.select(*EVENT, "qualy_position", "race_position", "driver_id"))


@register(
    "coverage",
    with_views(
        f"""{_DATASET_SQL} SELECT {E}, event_name, coalesce(n, 0) AS drivers, coalesce(fp, 0) AS fp_available,
              coalesce(q, 0) AS qualifying_available, coalesce(r, 0) AS race_available, coalesce(s, 0) AS standings_available
            FROM calendar LEFT JOIN (SELECT {E}, count(DISTINCT driver_id) AS n FROM drv GROUP BY ALL) USING ({E})
              LEFT JOIN (SELECT DISTINCT {E}, 1 AS fp FROM features) USING ({E}) LEFT JOIN (SELECT DISTINCT {E}, 1 AS q FROM quali) USING ({E})
              LEFT JOIN (SELECT DISTINCT {E}, 1 AS r FROM race) USING ({E}) LEFT JOIN (SELECT DISTINCT {E}, 1 AS s FROM standings) USING ({E})""",
        *_DATASET_VIEWS,
    ),
)
def coverage(spark, d):
    return ds.coverage(views.calendar(spark, d), merged_kinds(spark, d))


@register(
    "max_rounds",
    with_views(
        f"SELECT {E}, event_name FROM (SELECT *, row_number() OVER (PARTITION BY source, year ORDER BY round_number) AS n FROM calendar) WHERE n <= 3",
        "calendar",
    ),
)
def max_rounds(spark, d):
    return ds.first_rounds(views.calendar(spark, d), 3).select(*EVENT, "event_name")


@register(
    "keep_last_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def keep_last_per_key(spark, d):
    rows = views.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return keep_last(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@register(
    "union_sources",
    """SELECT 'customer' AS source, CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS brand FROM customer
       UNION ALL SELECT 'part', p_partkey, NULL, p_brand FROM part""",
)
def union_sources(spark, d):
    customers = views.table(spark, d, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")
    )
    parts = views.table(spark, d, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")
    )
    return ds.union_sources([customers, parts])


@register(
    "rounds_with_data",
    with_views(
        f"""SELECT {E} FROM calendar WHERE ({E}) IN (SELECT ({E}) FROM features) AND ({E}) IN (SELECT ({E}) FROM quali)
             AND ({E}) IN (SELECT ({E}) FROM race) AND ({E}) IN (SELECT ({E}) FROM standings)""",
        "features",
        "quali",
        "race",
        "standings",
        "calendar",
    ),
)
def rounds_with_data(spark, d):
    base = views.by_driver(spark, d)
    races = cut_lineage(views.race(spark, d, base), "race")
    frames = [best_laps(base), views.quali(spark, d, base), races, views.standings(spark, d, races)]
    return ds.rounds_with(views.calendar(spark, d), *frames).select(*EVENT)


@register(
    "rounds_missing",
    with_views(
        f"""SELECT stage, {E}, source || ' ' || year || ' round ' || round_number || ': no ' || stage || ' data' AS message FROM (
              SELECT 'race' AS stage, {E} FROM calendar WHERE ({E}) NOT IN (SELECT ({E}) FROM race)
              UNION ALL SELECT 'standings', {E} FROM calendar WHERE ({E}) NOT IN (SELECT ({E}) FROM standings))""",
        "race",
        "standings",
        "calendar",
    ),
)
def rounds_missing(spark, d):
    """The first round of a season has no standings yet."""
    races = cut_lineage(views.race(spark, d), "race")
    frames = {"race": races, "standings": views.standings(spark, d, races)}
    return ds.missing_notes(views.calendar(spark, d), frames)
