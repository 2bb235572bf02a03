"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock import schemas
from paddock.functions.scalars import version_label
from paddock.operators import dataset as ds
from paddock.operators import practice
from paddock.operators.experiments import result_rows
from paddock.operators.ordering import first_places
from paddock.operators.practice import best_laps
from paddock.plans.predict import predict_all_heuristic
from paddock.schemas import EVENT, SESSIONS
from paddock.session import cut_lineage, scratch_path
from paddock.sources import readers, sinks
from workload import views
from workload.dataset import merged_kinds
from workload.registry import register
from workload.sqlviews import with_views


@register(
    "scan_schedule",
    with_views("SELECT source, year, round_number, event_name FROM calendar", "calendar"),
)
def scan_schedule(spark, d):
    """The calendar landed as CSV with its columns in another order and one more, read by the schema."""
    home = scratch_path(spark, "schedule")
    landed = views.calendar(spark, d).select("event_name", F.lit("x").alias("note"), "round_number", "source", "year")
    sinks.write_csv(landed, f"{home}/schedule.csv")
    return readers.read_schedule(spark, home).select(*EVENT, "event_name")


@register(
    "scan_endpoint_filtered",
    """SELECT CAST(p_partkey AS BIGINT) AS session_key, p_brand AS driver_number, CAST(p_size AS VARCHAR) AS position
       FROM part WHERE p_brand = 'Brand#7' AND p_size = 3""",
)
def scan_endpoint_filtered(spark, d):
    """Parts as session results: landed as JSON, read back with equality parameters."""
    home = scratch_path(spark, "endpoint")
    landed = views.table(spark, d, "part").select(
        F.col("p_partkey").alias("session_key"),
        F.col("p_brand").alias("driver_number"),
        F.col("p_size").cast("string").alias("position"),
        F.col("p_retailprice").alias("duration"),
    )
    landed.write.json(f"{home}/session_result")
    found = readers.read_endpoint(
        spark, home, "session_result", schemas.SESSION_RESULTS, driver_number="Brand#7", position="3"
    )
    return found.select("session_key", "driver_number", "position")


@register("scan_laps_pruned", "SELECT CAST(l_suppkey AS VARCHAR) AS driver_id, l_extendedprice AS lap_time FROM lineitem")
def scan_laps_pruned(spark, d):
    return views.laps(spark, d).select("driver_id", "lap_time")


@register(
    "first_available_column",
    "SELECT s_name AS driver_id, s_name AS driver_name, s_acctbal AS position, CAST(NULL AS DOUBLE) AS q3_time FROM supplier",
)
def first_available_column(spark, d):
    """Suppliers as a result table with only a full name and a grid position."""
    raw = views.table(spark, d, "supplier").select(
        F.col("s_name").alias("FullName"), F.col("s_acctbal").alias("GridPosition")
    )
    return readers.results_from_columns(raw, readers.QUALIFYING_POSITION_COLUMNS)


@register("scan_best_format", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_best_format(spark, d):
    return readers.read_best_format(spark, d, "supplier")


@register(
    "scan_csv_where_no_parquet",
    "SELECT p_partkey, p_name, p_retailprice, CAST(NULL AS INT) AS p_size FROM part",
)
def scan_csv_where_no_parquet(spark, d):
    """Parts landed as CSV only, columns shuffled and one missing: found by the second format, read by name."""
    home = scratch_path(spark, "formats")
    parts = views.table(spark, d, "part")
    sinks.write_csv(parts.select("p_retailprice", "p_name", "p_partkey"), f"{home}/part.csv")
    wanted = parts.select("p_partkey", "p_name", "p_retailprice", "p_size").schema
    return readers.read_best_format(spark, home, "part", wanted)


def _landed_matches(spark, d):
    """Matches as CSV, columns in reverse and without those of expected goals, odds, venue and cards."""
    home, matches = scratch_path(spark, "football"), views.matches(spark, d)
    sinks.write_csv(matches.select(*reversed(matches.columns)), f"{home}/matches.csv")
    return readers.read_matches(spark, home)


@register(
    "scan_teams",
    """SELECT CAST(n_nationkey AS VARCHAR) AS team_id, n_name AS team_name, r_name AS league, n_name AS country, CAST(NULL AS VARCHAR) AS team_aliases
       FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def scan_teams(spark, d):
    """Nations as teams of their region's league, landed without aliases."""
    home = scratch_path(spark, "teams")
    regions = spark.read.schema("r_regionkey int, r_name string").parquet(f"{d}/region.parquet")
    nations = views.table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    landed = nations.select(
        F.col("n_name").alias("country"), F.col("r_name").alias("league"), F.col("n_name").alias("team_name"), F.col("n_nationkey").alias("team_id")
    )
    sinks.write_csv(landed, f"{home}/teams.csv")
    return readers.read_teams(spark, home)


@register(
    "scan_runs",
    """SELECT CAST(c_custkey AS VARCHAR) AS sweep_id, c_mktsegment AS sport, count(o_orderkey) AS runs,
         count(o_orderkey) FILTER (o_orderstatus = 'F') AS done, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
)
def scan_runs(spark, d):
    """Runs, sweeps and their bridge landed in three formats of columns, read by their schemas and joined."""
    home, runs = scratch_path(spark, "experiments"), views.runs(spark, d)
    sinks.write_csv(runs.select("status", "created_at", "sweep_id", "id"), f"{home}/runs.csv")
    runs.select(F.col("id").alias("run_id"), "sweep_id", F.lit("1").alias("param_value")).write.parquet(f"{home}/sweep_runs.parquet")
    sweeps = views.table(spark, d, "customer").select(F.col("c_mktsegment").alias("sport"), F.col("c_custkey").cast("string").alias("id"))
    sinks.write_csv(sweeps, f"{home}/sweeps.csv")
    found, sweeps, bridge = readers.read_experiments(spark, home)
    of_sweep = found.drop("sweep_id", "sport").join(bridge.withColumnRenamed("run_id", "id"), "id")
    joined = sweeps.select(F.col("id").alias("sweep_id"), "sport").join(of_sweep, "sweep_id", "left")
    return joined.groupBy("sweep_id", "sport").agg(
        F.count("id").alias("runs"),
        F.count_if(F.col("status") == "success").alias("done"),
        F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last_day"),
    )


@register(
    "practice_from_results",
    with_views(
        """SELECT year, dense_rank() OVER (PARTITION BY year ORDER BY round_number) AS round_number, driver_id, driver_name,
             fp1_delta, fp1_rank, fp2_delta, fp2_rank, fp3_delta, fp3_rank, round(fp_mean_delta, 6) AS fp_mean_delta FROM features""",
        "features",
    ),
)
def practice_from_results(spark, d):
    """Every driver's best lap as a session result, landed with text durations of which some are missing, in practice tables."""
    base = views.by_driver(spark, d)
    meeting = F.col("year") * 100 + F.col("round_number")
    months = base.select("source", "year", "round_number").distinct()
    meetings = months.select(
        "source", "year", meeting.cast("long").alias("meeting_key"), F.concat(F.lit("M"), meeting.cast("string")).alias("meeting_name"),
        F.lit(None).cast("string").alias("country_name"), meeting.cast("string").alias("date_start"), meeting.cast("long").alias("ord"),
    )
    number = F.col("session").substr(3, 1).cast("int")
    key = (meeting * 10 + number).cast("long")
    sessions = base.select(
        "source", "year", meeting.cast("long").alias("meeting_key"), key.alias("session_key"),
        F.concat(F.lit("Practice "), number.cast("string")).alias("session_name"), key.alias("ord"),
    ).distinct()
    best = best_laps(base, EVENT, "lap_ms")
    entries = best.select(key.alias("session_key"), F.col("driver_id").alias("driver_number"), F.lit("1").alias("position"), F.col("best_lap").cast("string").alias("text"))
    unplaced = entries.select("session_key", F.concat(F.lit("x"), "driver_number").alias("driver_number"), "position", F.lit(None).cast("string").alias("text"))
    home = scratch_path(spark, "results")
    landed = entries.unionByName(unplaced).withColumn("ord", F.xxhash64("session_key", "driver_number"))
    # A duration is a bare number or absent in the documents.
    landed.select("session_key", "driver_number", "position", F.try_parse_json("text").alias("duration"), "ord").write.json(f"{home}/session_result")
    results = readers.read_endpoint(spark, home, "session_result", schemas.SESSION_RESULTS)
    drivers = entries.select("session_key", "driver_number", F.lit("").alias("name_acronym"), F.lit(0).cast("long").alias("ord"))
    rows = practice.practice_from_results(meetings, sessions, results, drivers)
    gaps = [F.col(f"{s.lower()}_delta").cast("bigint").alias(f"{s.lower()}_delta") for s in SESSIONS]
    ranks = [f"{s.lower()}_rank" for s in SESSIONS]
    return rows.select(
        "year", F.col("round_number").cast("bigint").alias("round_number"), "driver_id", "driver_name", *gaps, *ranks, F.round("fp_mean_delta", 6).alias("fp_mean_delta")
    )


@register(
    "fixtures_head",
    with_views(
        """SELECT match_id, date, CAST(season AS VARCHAR) AS season, league, home_team_id, away_team_id
           FROM matches WHERE home_goals IS NULL ORDER BY date, match_id LIMIT 8""",
        "matches",
    ),
)
def fixtures_head(spark, d):
    upcoming = readers.fixtures_of(_landed_matches(spark, d)).orderBy("date", "match_id")
    return readers.fixtures_head(upcoming, 8)


@register(
    "scan_matches",
    with_views(
        """SELECT match_id, strptime(date, '%Y-%m-%d %H:%M') AS kick_off, season, league, home_team_id, away_team_id,
             home_goals, away_goals, home_goals IS NULL AS fixture FROM matches""",
        "matches",
    ),
)
def scan_matches(spark, d):
    return _landed_matches(spark, d).select(
        "match_id",
        readers.match_time(F.col("date")).cast("timestamp_ntz").alias("kick_off"),
        "season",
        "league",
        "home_team_id",
        "away_team_id",
        "home_goals",
        "away_goals",
        F.col("home_goals").isNull().alias("fixture"),
    )


@register(
    "broken_records",
    with_views(
        """SELECT 'row' AS kind, match_id, home_goals, NULL AS reason, count(*) AS records FROM matches
             WHERE match_id::BIGINT % 11 <> 0 AND match_id::BIGINT % 7 <> 0 GROUP BY ALL
           UNION ALL SELECT 'note', NULL, NULL, CASE WHEN match_id::BIGINT % 11 = 0 THEN 'wrong number of fields' ELSE 'home_goals is no int' END, count(*)
             FROM matches WHERE match_id::BIGINT % 11 = 0 OR match_id::BIGINT % 7 = 0 GROUP BY ALL""",
        "matches",
    ),
)
def broken_records(spark, d):
    """Matches landed as CSV lines, some a field short and some with a text for a number: rows and notes hold them all."""
    names = ["match_id", "date", "season", "home_goals"]
    key = F.col("match_id").cast("bigint")
    goals = F.when(key % 7 == 0, "two").otherwise(F.coalesce(F.col("home_goals").cast("string"), F.lit("")))
    fields = [F.col("match_id"), F.col("date"), F.col("season").cast("string")]
    line = F.when(key % 11 == 0, F.concat_ws(",", *fields)).otherwise(F.concat_ws(",", *fields, goals))
    path = scratch_path(spark, "lines")
    views.matches(spark, d).select(line.alias("value")).write.text(path)
    schema = schemas.MATCHES
    schema = type(schema)([schema[c] for c in names])
    rows, notes = readers.read_csv_checked(spark, path, schema, names)
    counted = rows.groupBy(F.lit("row").alias("kind"), "match_id", "home_goals", F.lit(None).cast("string").alias("reason"))
    noted = notes.groupBy(F.lit("note").alias("kind"), F.lit(None).cast("string").alias("match_id"), F.lit(None).cast("int").alias("home_goals"), "reason")
    records = F.count(F.lit(1)).alias("records")
    return counted.agg(records).unionByName(noted.agg(records))


@register("sink_csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def sink_csv_roundtrip(spark, d):
    part = views.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    path = sinks.write_csv(part, scratch_path(spark, "csv"))
    return readers.read_csv(spark, path, part.schema)


@register(
    "sink_parquet_roundtrip",
    with_views("SELECT source, year, round_number, driver_id, session, best_lap FROM best", "best"),
)
def sink_parquet_roundtrip(spark, d):
    """Best laps written by source and year, and read back."""
    best = best_laps(views.laps(spark, d), EVENT, "lap_ms")
    path = sinks.write_parquet(best, scratch_path(spark, "parquet"), ["source", "year"])
    return spark.read.schema(best.schema).parquet(path).select(*EVENT, "driver_id", "session", "best_lap")


PREDICTIONS_SQL = """
  m AS (SELECT source, year, round_number, quantile_cont(fp1_delta, 0.5) AS m1, quantile_cont(fp2_delta, 0.5) AS m2,
          quantile_cont(fp3_delta, 0.5) AS m3, quantile_cont(fp_mean_delta, 0.5) AS m4 FROM features GROUP BY ALL),
  p AS (SELECT f.source, f.year, f.round_number, f.driver_id,
          (coalesce(CAST(fp1_delta AS DOUBLE), m1, 0) + coalesce(CAST(fp2_delta AS DOUBLE), m2, 0)
            + coalesce(CAST(fp3_delta AS DOUBLE), m3, 0) + coalesce(fp_mean_delta, m4, 0)) / 4 AS pred
        FROM features f JOIN m USING (source, year, round_number)),
  top AS (SELECT source, year, round_number, row_number() OVER (PARTITION BY source, year, round_number
            ORDER BY pred, driver_id) AS rank, driver_id AS driver_name, round(pred, 6) AS pred FROM p QUALIFY rank <= 10)
"""


def with_predictions(body: str, *names: str) -> str:
    return with_views("", "features", *names).rstrip() + "," + PREDICTIONS_SQL + body


def heuristic_top(spark, d):
    top = predict_all_heuristic(views.practice_features(spark, d))
    return top.select(
        *EVENT, F.col("rank").cast("bigint").alias("rank"), "driver_name", F.round("pred", 6).alias("pred")
    )


@register(
    "sink_prediction_json",
    with_predictions(
        """SELECT year, round_number, CASE WHEN round_number <= 1 THEN 'V1' ELSE 'V' || round_number END AS version,
             rank, driver_name, pred FROM top"""
    ),
)
def sink_prediction_json(spark, d):
    """One prediction document per round, written as JSON lines and read back."""
    documents = sinks.prediction_documents(
        heuristic_top(spark, d),
        ["year", "round_number"],
        version_label(F.col("round_number")),
        "F1",
        "qualifying",
        "2026-01-01T00:00:00Z",
    )
    path = scratch_path(spark, "documents")
    documents.select("document").write.text(path)
    parsed = spark.read.text(path).select(F.from_json("value", schemas.RESULT_DOCUMENT).alias("result"))
    config = F.col("result.config")
    rows = parsed.select(
        config["year"].cast("int").alias("year"),
        config["round_number"].cast("int").alias("round_number"),
        "result.version",
        F.inline("result.rows"),
    )
    return rows.drop("team", "player", "id", "score", "value").withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "dataset_summary",
    with_views(
        """, drv AS (SELECT source, year, round_number, driver_id FROM wide UNION SELECT source, year, round_number, driver_id FROM quali
               UNION SELECT source, year, round_number, driver_id FROM race
               UNION SELECT source, year, round_number, driver_id FROM standings)
           SELECT (SELECT count(*) FROM drv JOIN calendar USING (source, year, round_number)) AS rows,
             (SELECT count(*) FROM calendar) AS events""",
        "wide",
        "quali",
        "race",
        "standings",
        "calendar",
    ),
)
def dataset_summary(spark, d):
    merged, rounds = cut_lineage(merged_kinds(spark, d), "merged"), views.calendar(spark, d)
    return ds.summary(ds.dataset_rows(rounds, merged), ds.coverage(rounds, merged))


@register("explode_result_rows", with_views("SELECT run_id, driver_name, pred FROM run_results", "run_results"))
def explode_result_rows(spark, d):
    """Order lines as result documents of one row each, parsed and exploded again."""
    rows = views.run_results(spark, d).withColumn("rank", F.lit(1))
    document = F.to_json(F.struct(F.array(F.struct("rank", "driver_name", "pred")).alias("rows")))
    documents = rows.select("run_id", F.from_json(document, schemas.RESULT_DOCUMENT).alias("result"))
    return result_rows(documents).select("run_id", "driver_name", "pred")


@register(
    "scan_result_files",
    """SELECT CAST(n_nationkey AS VARCHAR) AS run_id, CASE WHEN s_suppkey IS NOT NULL THEN CAST(place AS INT) END AS rank, s_name AS driver_name, s_acctbal AS pred
       FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier
         QUALIFY place <= 10) ON s_nationkey = n_nationkey""",
)
def scan_result_files(spark, d):
    """A run per nation that predicts its first ten suppliers, landed as one JSON file a run and read back; a run may be empty."""
    order = [F.desc("s_acctbal"), F.col("s_suppkey")]
    top = first_places(views.table(spark, d, "supplier"), ["s_nationkey"], order, 10, "rank")
    row = F.struct("rank", F.col("s_name").alias("driver_name"), F.col("s_acctbal").alias("pred"))
    listed = top.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    runs = views.table(spark, d, "nation").join(listed, "n_nationkey", "left")
    document = F.to_json(F.struct(F.coalesce("rows", F.array()).alias("rows")))
    path = scratch_path(spark, "runs")
    runs.select(F.col("n_nationkey").alias("run_id"), document.alias("value")).repartition("run_id").write.partitionBy("run_id").text(path)
    return result_rows(readers.read_results(spark, path)).select("run_id", "rank", "driver_name", "pred")


@register("file_inventory")
def file_inventory(spark, d):
    """Paths and sizes of the supplied tables' files."""
    return readers.file_inventory(spark, d, "*.parquet")


@register(
    "notebook_cells",
    """SELECT doc_id, 0 AS cell, 'markdown' AS cell_type, text AS source FROM documents
       UNION ALL SELECT doc_id, 1, 'code', lang FROM documents
       UNION ALL SELECT doc_id, 2, 'code', '' FROM documents""",
)
def notebook_cells(spark, d):
    """Documents as notebooks: a cell of lines, a cell of one text and an empty cell."""
    pieces = F.transform(
        F.split("text", "\n"), lambda line, i: F.when(i > 0, F.concat(F.lit("\n"), line)).otherwise(line)
    )

    def cell(kind, source):
        body = F.struct(F.lit(kind).alias("cell_type"), source.alias("source"))
        return F.to_json(body)

    cells = F.concat_ws(
        ",", cell("markdown", pieces), cell("code", F.col("lang")), cell("code", F.array().cast("array<string>"))
    )
    text = F.concat(F.lit('{"cells":['), cells, F.lit("]}"))
    documents = views.table(spark, d, "documents").select("doc_id", text.alias("text"))
    return readers.notebook_cells(documents, "doc_id", "text")
