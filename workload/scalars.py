"""Row-level rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock import schemas
from paddock.functions import scalars as fn
from paddock.functions.parameters import MOTORSPORT, rejections, savings, typed_parameters
from paddock.operators.experiments import display_rows, result_rows
from paddock.operators.training import align, before_target, qualifying_targets
from paddock.schemas import DRIVER, RACE_FEATURES
from workload import views
from workload.registry import register
from workload.sqlviews import with_views


@register(
    "laps_not_null",
    with_views(
        """SELECT driver_id, lap_ms FROM (SELECT CASE WHEN lap_ms % 11 <> 0 THEN driver_id END AS driver_id,
             CASE WHEN lap_ms % 7 <> 0 THEN lap_ms END AS lap_ms FROM laps)
           WHERE driver_id IS NOT NULL AND lap_ms IS NOT NULL""",
        "laps",
    ),
)
def laps_not_null(spark, d):
    ms = F.col("lap_ms")
    holes = views.laps(spark, d).select(
        F.when(ms % 11 != 0, F.col("driver_id")).alias("driver_id"), F.when(ms % 7 != 0, ms).alias("lap_ms")
    )
    return holes.dropna()


@register(
    "to_number_or_null",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN CAST(p_size AS DOUBLE)
         WHEN 2 THEN p_size * 1000.0::DOUBLE END AS value FROM part""",
)
def to_number_or_null(spark, d):
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, size)
        .when(kind == 1, F.concat(F.lit(" "), size, F.lit(".0 ")))
        .when(kind == 2, F.concat(size, F.lit("e3")))
        .when(kind == 3, F.concat(size, F.lit("d")))
        .when(kind == 4, F.lit("DNF"))
    )
    return views.table(spark, d, "part").select("p_partkey", fn.to_number(text).alias("value"))


@register("duration_seconds", "SELECT event_id, (epoch_us(ts) % 86400000000) / 1e6 AS seconds FROM events")
def duration_seconds(spark, d):
    since_midnight = F.col("ts") - F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return views.table(spark, d, "events").select("event_id", fn.interval_seconds(since_midnight).alias("seconds"))


@register("driver_id_string", "SELECT CAST(s_suppkey AS VARCHAR) AS driver_id, s_name AS driver_name FROM supplier")
def driver_id_string(spark, d):
    return views.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("driver_id"), F.col("s_name").alias("driver_name")
    )


@register(
    "name_fallback",
    with_views("SELECT driver_id, CASE WHEN name_acronym <> '' THEN name_acronym ELSE driver_id END AS driver_name FROM drivers", "drivers"),
)
def name_fallback(spark, d):
    name = F.nullif(F.col("name_acronym"), F.lit(""))
    return views.drivers(spark, d).select("driver_id", F.coalesce(name, "driver_id").alias("driver_name"))


@register(
    "event_name_fallback",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN p_brand
         WHEN p_partkey % 4 = 2 THEN p_type ELSE 'Round ' || p_size END AS event_name FROM part""",
)
def event_name_fallback(spark, d):
    kind = F.col("p_partkey") % 4
    label = fn.event_label(
        F.when(kind == 0, F.col("p_name")).when(kind == 1, ""),
        F.when(kind == 1, F.col("p_brand")).when(kind == 2, ""),
        F.when(kind == 2, F.col("p_type")),
        F.col("p_size"),
    )
    return views.table(spark, d, "part").select("p_partkey", label.alias("event_name"))


@register(
    "event_key",
    "SELECT o_orderkey, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS event_key FROM orders",
)
def event_key(spark, d):
    return views.table(spark, d, "orders").select(
        "o_orderkey", fn.event_key(F.year("o_orderdate"), F.month("o_orderdate")).alias("event_key")
    )


@register(
    "session_label",
    """SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'FP1' WHEN 2 THEN 'FP2' WHEN 3 THEN 'FP3' END AS label FROM part""",
)
def session_label(spark, d):
    name = F.concat(F.lit("Practice "), (F.col("p_size") % 4).cast("string"))
    return views.table(spark, d, "part").select("p_partkey", fn.session_label(name).alias("label"))


@register(
    "q3_from_array",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS q3_time FROM part",
)
def q3_from_array(spark, d):
    """Durations as landed JSON: a list of three, a list of two, or a plain number."""
    price = F.col("p_retailprice").cast("string")
    kind = F.col("p_partkey") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("[91.0,null,"), price, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("[91.0,"), price, F.lit("]")))
        .otherwise(price)
    )
    third = F.try_variant_get(F.try_parse_json(text), "$[2]", "double")
    return views.table(spark, d, "part").select("p_partkey", third.alias("q3_time"))


@register(
    "standing_fallback",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey WHEN s_suppkey % 5 = 0 THEN s_nationkey
         ELSE CAST(s_suppkey % 20 AS INT) END AS position_start FROM supplier""",
)
def standing_fallback(spark, d):
    key = F.col("s_suppkey")
    start = F.when(key % 4 == 0, F.lit(None)).when(key % 5 == 0, 0).otherwise(key % 20).cast("int")
    shown = fn.first_nonzero(start, F.col("s_nationkey")).alias("position_start")
    return views.table(spark, d, "supplier").select("s_suppkey", shown)


@register(
    "points_lookup",
    with_views(
        """SELECT source, year, round_number, driver_id, position,
             CASE position WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10 WHEN 6 THEN 8
               WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 END AS points FROM race""",
        "race",
    ),
)
def points_lookup(spark, d):
    return views.race(spark, d).select(*DRIVER, "position", fn.points_for(F.col("position")).alias("points"))


@register(
    "leakage_filter",
    with_views("SELECT source, year, round_number FROM calendar WHERE NOT (year = 1998 AND round_number >= 6)", "calendar"),
)
def leakage_filter(spark, d):
    return views.calendar(spark, d).where(before_target(1998, 6)).select("source", "year", "round_number")


@register("quali_target", with_views("SELECT source, year, round_number, driver_id, target FROM targets", "targets"))
def quali_target(spark, d):
    timed = views.quali(spark, d).select(*DRIVER, F.col("q3_ms").alias("q3_time"))
    return qualifying_targets(timed).select(*DRIVER, "target")


@register(
    "align_features",
    with_views(
        """SELECT source, year, round_number, driver_id, CAST(fp1_delta AS DOUBLE) AS fp1_delta, CAST(fp2_delta AS DOUBLE) AS fp2_delta,
             CAST(fp3_delta AS DOUBLE) AS fp3_delta, fp_mean_delta, CAST(fp1_rank AS DOUBLE) AS fp1_rank,
             CAST(fp2_rank AS DOUBLE) AS fp2_rank, CAST(fp3_rank AS DOUBLE) AS fp3_rank, fp_mean_rank,
             CAST(NULL AS DOUBLE) AS qualy_position FROM features""",
        "features",
    ),
)
def align_features(spark, d):
    return align(views.practice_features(spark, d), RACE_FEATURES, *DRIVER)


@register(
    "version_label",
    with_views(
        "SELECT year, round_number, CASE WHEN round_number <= 1 THEN 'V1' ELSE 'V' || round_number END AS version FROM calendar",
        "calendar",
    ),
)
def version_label(spark, d):
    label = fn.version_label(F.col("round_number")).alias("version")
    return views.calendar(spark, d).select("year", "round_number", label)


@register(
    "parse_year_list",
    """SELECT o_orderkey, array_to_string(list_sort(list_distinct([year(o_orderdate), 2000, 1998])), ',') AS years
       FROM orders""",
)
def parse_year_list(spark, d):
    text = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(", 2000,, 1998 ,"))
    years = F.array_join(fn.year_list(text).cast("array<string>"), ",")
    return views.table(spark, d, "orders").select("o_orderkey", years.alias("years"))


@register(
    "auto_seasons",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0
         THEN (year(o_orderdate) - 2) || ',' || (year(o_orderdate) - 1) || ',' || year(o_orderdate)
         ELSE '1995,1997' END AS seasons FROM orders""",
)
def auto_seasons(spark, d):
    setting = F.when(F.col("o_orderkey") % 2 == 0, "Auto").otherwise(" 1995, 1997,")
    seasons = fn.seasons(setting, F.year("o_orderdate")).cast("array<string>")
    return views.table(spark, d, "orders").select("o_orderkey", F.array_join(seasons, ",").alias("seasons"))


@register(
    "param_extract",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text,
         CAST(1 AS BIGINT) AS round_number, 'qualifying' AS mode, false AS include_standings FROM events""",
)
def param_extract(spark, d):
    props = F.col("props")
    return views.table(spark, d, "events").select(
        "event_id",
        fn.param_int(props, "k").alias("k"),
        fn.param_string(props, "k").alias("k_text"),
        fn.param_int(props, "round_number", 1).alias("round_number"),
        fn.param_string(props, "mode", "qualifying").alias("mode"),
        fn.param_bool(props, "include_standings", False).alias("include_standings"),
    )


@register(
    "param_coerce",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE CAST(p_size AS BIGINT) END AS as_int,
         p_partkey % 2 = 0 AS as_bool FROM part""",
)
def param_coerce(spark, d):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    number = F.when(kind == 0, F.concat(F.lit(" "), size, F.lit("abc"))).when(kind == 1, size).otherwise("abc")
    flag = F.when(F.col("p_partkey") % 2 == 0, "TRUE").otherwise("yes")
    return views.table(spark, d, "part").select(
        "p_partkey", fn.form_int(number).alias("as_int"), fn.form_bool(flag).alias("as_bool")
    )


@register(
    "clamp_with_fallback",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 250.0::DOUBLE
         ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal / 50)) END AS stake FROM customer""",
)
def clamp_with_fallback(spark, d):
    """Balances as stakes: numbers, texts with a unit, and texts without a number."""
    stake, kind = F.col("c_acctbal") / 50, F.col("c_custkey") % 3
    text = F.when(kind == 1, F.concat(stake.cast("string"), F.lit(" EUR"))).otherwise("none")
    number = F.when(kind == 0, stake).otherwise(fn.leading_number(text))
    return views.table(spark, d, "customer").select("c_custkey", fn.clamp(number, 250.0, 0.0, 100.0).alias("stake"))


@register(
    "status_normalise",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'error' ELSE
         CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'queued' END END AS status FROM orders""",
)
def status_normalise(spark, d):
    code = F.col("o_orderstatus")
    raw = F.when(code == "F", "Success").when(code == "P", "FAILED").when(F.col("o_orderkey") % 2 == 0, "RUNNING")
    return views.table(spark, d, "orders").select(
        "o_orderkey", fn.status_word(F.when(F.col("o_orderkey") % 4 == 1, F.coalesce(raw, F.lit(""))).otherwise(raw)).alias("status")
    )


@register(
    "display_projection",
    """SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'S' || l_suppkey WHEN 1 THEN CAST(l_partkey AS VARCHAR) ELSE 'Item' END AS label,
         l_quantity AS value FROM lineitem WHERE l_returnflag <> 'N'""",
)
def display_projection(spark, d):
    """Orders as result documents with a row for each line, parsed and shown again."""
    kind = F.col("l_linenumber") % 3
    row = F.struct(
        F.when(kind == 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("team"),
        F.when(kind == 1, F.col("l_partkey")).alias("rank"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("score"),
    )
    # An order has seven lines at most.
    documents = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("text"))
    parsed = documents.select("l_orderkey", F.from_json("text", schemas.RESULT_DOCUMENT).alias("result"))
    return display_rows(result_rows(parsed, "l_orderkey"))


@register("normalise_text", "SELECT c_custkey, trim(replace(lower(' ' || replace(c_name, '#', '_')), '_', ' ')) AS name FROM customer")
def normalise_text(spark, d):
    raw = F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("_")))
    return views.table(spark, d, "customer").select("c_custkey", fn.normalise(raw).alias("name"))


@register(
    "title_from_path",
    with_views("SELECT path, replace(regexp_extract(path, '([^/]+)\\.pdf$', 1), '-', ' ') AS title FROM papers", "papers"),
)
def title_from_path(spark, d):
    return views.papers(spark, d).select("path", fn.title_of(F.col("path")).alias("title"))


@register(
    "config_fingerprint",
    """SELECT l_orderkey, l_linenumber, md5('driver=' || l_suppkey || '&session=' || l_returnflag || '&year=' || year(l_shipdate)) AS digest
       FROM lineitem""",
)
def config_fingerprint(spark, d):
    params = F.create_map(
        F.lit("year"),
        F.year("l_shipdate").cast("string"),
        F.lit("session"),
        F.col("l_returnflag"),
        F.lit("driver"),
        F.col("l_suppkey").cast("string"),
    )
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.fingerprint(params).alias("digest"))


@register(
    "project_parameters",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'race' ELSE 'qualifying' END AS mode, 'fastf1' AS source,
         CASE WHEN o_orderkey % 3 = 1 THEN CAST(2026 AS BIGINT) ELSE CAST(year(o_orderdate) AS BIGINT) END AS year,
         CAST(month(o_orderdate) AS BIGINT) AS round_number, 'auto' AS train_seasons,
         o_orderkey % 3 = 0 AS include_standings, '.cache/fastf1' AS cache_dir, '' AS meeting_name, '' AS country_name FROM orders""",
)
def project_parameters(spark, d):
    """Orders as run configurations: complete, with texts for numbers, and with gaps."""
    year, month = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    kind = F.col("o_orderkey") % 3
    config = (
        F.when(kind == 0, F.concat(F.lit('{"mode":"race","include_standings":true,"year":'), year, F.lit(',"round_number":'), month, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"include_standings":"true","round_number":"'), month, F.lit('. round"}')))
        .otherwise(F.concat(F.lit('{"mode":null,"year":"'), year, F.lit('","round_number":'), month, F.lit(".7}")))
    )
    return views.table(spark, d, "orders").select("o_orderkey", *typed_parameters(config, MOTORSPORT))


@register(
    "parameter_rejections",
    """SELECT o_orderkey, '[' || array_to_string(list_filter([
         CASE WHEN o_orderkey % 4 = 0 THEN 'mode is missing' WHEN o_orderkey % 4 = 1 THEN 'mode is not one of qualifying, race' END,
         CASE WHEN o_orderkey % 3 = 0 THEN 'year is not a number' WHEN o_orderkey % 3 = 1 THEN 'year is missing' END], lambda x: x IS NOT NULL), ', ') || ']' AS rejections
       FROM orders""",
)
def parameter_rejections(spark, d):
    """Orders as run configurations, some without a mode or a year and some with wrong ones."""
    key = F.col("o_orderkey")
    mode = F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, F.lit('"mode":"sprint",')).otherwise(F.lit('"mode":"race",'))
    year = F.when(key % 3 == 0, F.lit('"year":"soon",')).when(key % 3 == 1, F.lit('"year":null,')).otherwise(F.lit('"year":"1997",'))
    config = F.concat(F.lit("{"), mode, year, F.lit('"source":"openf1","round_number":3}'))
    found = F.array_join(rejections(config, MOTORSPORT), ", ")
    return views.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("["), found, F.lit("]")).alias("rejections"))


@register(
    "savings_in_range",
    """SELECT c_custkey, greatest(0.0::DOUBLE, c_acctbal) AS bankroll, CAST(c_nationkey AS DOUBLE) AS "monthlySavingsTarget",
         0.0::DOUBLE AS "reserveBalance", 10.0::DOUBLE AS "defaultStake", least(100.0::DOUBLE, c_nationkey * 10.0::DOUBLE) AS "maxStakePercent",
         c_custkey % 2 = 0 AS "autoSaveProfit" FROM customer""",
)
def savings_in_range(spark, d):
    """Customers as saved preferences with numbers, texts, a wrong kind and a missing field."""
    nation = F.col("c_nationkey").cast("string")
    config = F.concat(
        F.lit('{"bankroll":'), F.col("c_acctbal").cast("decimal(18,2)").cast("string"),
        F.lit(',"monthlySavingsTarget":"'), nation, F.lit(' per month","reserveBalance":true,"maxStakePercent":'),
        (F.col("c_nationkey") * 10).cast("string"), F.lit(',"autoSaveProfit":'), F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false"), F.lit("}"),
    )
    return views.table(spark, d, "customer").select("c_custkey", *savings(config))
