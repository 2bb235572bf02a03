"""Sports tables derived from the supplied tables.

A supplier is a driver, a calendar month is a round, a return flag is a
practice session, an order is a run or a match.  Rounds are yyyymm, so a
calendar holds at most 12 rows per year whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.scalars import event_key
from paddock.operators.ordering import known, with_min_rank
from paddock.operators.practice import best_laps, features_from_best, features_from_laps
from paddock.operators.standings import standings_before_round
from paddock.operators.training import qualifying_training, race_training
from paddock.schemas import DRIVER, EVENT
from paddock.session import cut_lineage


# Columns of the supplied tables; with them a scan needs no job to read file footers first.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _round(date: str) -> list:
    return [
        F.lit("main").alias("source"),
        F.year(date).alias("year"),
        F.month(date).alias("round_number"),
    ]


def _cents(col: str):
    return F.rint(F.col(col) * 100).cast("bigint")


def laps(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        *_round("l_shipdate"),
        F.when(flag == "A", "FP1").when(flag == "N", "FP2").otherwise("FP3").alias("session"),
        F.col("l_suppkey").cast("string").alias("driver_id"),
        F.col("l_extendedprice").alias("lap_time"),
        _cents("l_extendedprice").alias("lap_ms"),
        *more,
    )


def by_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and total of every driver's lines by round, session and status.

    Practice, qualifying and race all come from it, and each of them reads it
    for the ranks and again for the rows, so it is written once.
    """
    rows = laps(spark, sf_dir, "l_linestatus")
    grouped = known(rows, *DRIVER).groupBy(*DRIVER, "session", "l_linestatus").agg(
        F.min("lap_time").alias("lap_time"), F.min("lap_ms").alias("lap_ms"), F.sum("lap_ms").alias("total")
    )
    return cut_lineage(grouped, "drivers")


def _driver_rounds(base: DataFrame, status: str) -> DataFrame:
    return base.where(F.col("l_linestatus") == status).groupBy(*DRIVER).agg(
        F.min("lap_time").alias("best"), F.min("lap_ms").alias("best_ms"), F.sum("total").alias("total")
    )


def quali(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    base = by_driver(spark, sf_dir) if base is None else base
    ranked = with_min_rank(_driver_rounds(base, "F"), EVENT, "best_ms", "position")
    third = F.col("best_ms") % 3 != 0  # drivers without a third time, at any position
    return ranked.select(
        *DRIVER, "position", F.when(third, F.col("best")).alias("q3_time"), F.when(third, F.col("best_ms")).alias("q3_ms")
    )


def race(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    base = by_driver(spark, sf_dir) if base is None else base
    ranked = with_min_rank(_driver_rounds(base, "O"), EVENT, "total", "position", descending=True)
    return ranked.select(*DRIVER, "position")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").select(*_round("o_orderdate")).distinct()
    return months.withColumn("event_name", F.concat(F.lit("Round "), F.col("round_number").cast("string")))


def practice_features(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    if base is None:
        return features_from_laps(laps(spark, sf_dir), EVENT, "lap_ms")
    return features_from_best(best_laps(base, EVENT, "lap_ms"))


def standings(spark: SparkSession, sf_dir: str, races: DataFrame | None = None) -> DataFrame:
    races = race(spark, sf_dir) if races is None else races
    return standings_before_round(calendar(spark, sf_dir), races)


def train_qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = by_driver(spark, sf_dir)
    timed = quali(spark, sf_dir, base).drop("q3_time").withColumnRenamed("q3_ms", "q3_time")
    return qualifying_training(practice_features(spark, sf_dir, base), timed)


def train_race(spark: SparkSession, sf_dir: str, with_standings: bool = False) -> DataFrame:
    base = by_driver(spark, sf_dir)
    races = race(spark, sf_dir, base)
    if with_standings:
        races = cut_lineage(races, "race")
    return race_training(
        practice_features(spark, sf_dir, base),
        quali(spark, sf_dir, base),
        races,
        standings(spark, sf_dir, races) if with_standings else None,
    )


def with_event_key(df: DataFrame) -> DataFrame:
    return df.withColumn("event_key", event_key(F.col("year"), F.col("round_number")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("sport"),
        F.when(status == "F", "success").when(status == "P", "failed").otherwise("RUNNING").alias("status"),
        F.col("o_custkey").cast("string").alias("sweep_id"),
    )


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_suppkey").cast("string").alias("driver_name"),
        F.col("l_extendedprice").alias("pred"),
        _cents("l_extendedprice").alias("pred_ms"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    home, order = F.col("o_custkey"), F.col("o_orderkey")
    played = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").select(
        order.cast("string").alias("match_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("date"),
        F.year("o_orderdate").alias("season"),
        F.col("o_orderpriority").alias("league"),
        (home % 20).cast("string").alias("home_team_id"),
        ((home + 1 + order % 19) % 20).cast("string").alias("away_team_id"),
        F.when(played, (order % 5).cast("int")).alias("home_goals"),
        F.when(played, (home % 4).cast("int")).alias("away_goals"),
    )


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country_name"))
    acronym = F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.col("s_name"))
    return (
        table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").cast("string").alias("driver_id"), acronym.alias("name_acronym"), "country_name")
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as research projects: the market segment is the sport."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("sport"),
        F.replace("c_name", F.lit("#"), F.lit("_")).alias("name"),
        F.when(key % 3 != 0, F.lit("Jupyter")).alias("notebook"),
        F.when(key % 5 != 0, F.lit("Python")).alias("python_dir"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as papers: the type is the sport, the file name comes from the part's name."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("sport"),
        F.concat(F.lit("papers/"), F.col("p_type"), F.lit("/"), name, F.lit(".pdf")).alias("path"),
    )
