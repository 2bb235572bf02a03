"""Runs, sweeps and their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.scalars import display_label, json_text, nan_to_null, status_word
from paddock.operators.ordering import keep_last


def current_state(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest row per key of an append-only state log."""
    return keep_last(log, [key], order)


def upsert_latest(existing: DataFrame, changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Table after inserting or replacing one row per key."""
    return keep_last(existing.unionByName(changes), [key], order)


def run_spans(
    changes: DataFrame, key: str, time: str, order: str, state: str, final: Sequence[str], patience_seconds: int
) -> DataFrame:
    """Finished runs of every key: (key, started, ended, state, changes, seconds).

    A run starts with the first change after a finished one and ends with a
    ``final`` state, or as ``aborted`` when no change follows within
    ``patience_seconds``.  Changes of a key are in order of ``time``, then
    ``order``; those without key or time are dropped.
    """
    log = changes.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    log = log.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), order, F.col(state).alias("_state"))
    in_order = Window.partitionBy(key).orderBy("_us", order)
    patience = patience_seconds * 1_000_000
    over = F.lag("_state").over(in_order).isin(*final) | (F.col("_us") >= F.lag("_us").over(in_order) + patience)
    numbered = log.withColumn("_new", F.coalesce(over, F.lit(False))).withColumn("_run", F.count_if("_new").over(in_order))
    spans = numbered.groupBy(key, "_run").agg(
        F.min("_us").alias("_from"),
        F.max("_us").alias("_last"),
        F.max_by("_state", F.struct("_us", order)).alias("_state"),
        F.count(F.lit(1)).alias("changes"),
    )
    finished = F.coalesce(F.col("_state").isin(*final), F.lit(False))
    to = F.when(finished, F.col("_last")).otherwise(F.col("_last") + patience)
    return spans.select(
        key,
        F.timestamp_micros("_from").alias("started"),
        F.timestamp_micros(to).alias("ended"),
        F.when(finished, F.col("_state")).otherwise("aborted").alias("state"),
        "changes",
        ((to - F.col("_from")) / 1_000_000).alias("seconds"),
    )


def abort_cascade(runs: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Unfinished runs of a failed sweep become errors."""
    failed = sweeps.where(status_word(F.col("status")) == "error").select(
        F.col("id").alias("sweep_id"), F.lit(True).alias("_failed")
    )
    unfinished = F.col("status").isin("queued", "running")
    return (
        runs.join(failed, "sweep_id", "left")
        .withColumn("status", F.when(F.col("_failed") & unfinished, "error").otherwise(F.col("status")))
        .select(*runs.columns)
    )


def list_newest_first(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).withColumn("status", status_word(F.col("status"))).orderBy(F.desc("created_at"), "id")


def latest(runs: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recent runs; a top-n heap per task, no full sort."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    """One run by id, empty if there is none; the filter reaches the scan."""
    return runs.where(F.col("id") == run_id)


def result_rows(documents: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per predicted row of a result document; a document without rows keeps one empty row."""
    return documents.select(key, F.explode_outer("result.rows").alias("row")).select(key, "row.*")


def display_rows(rows: DataFrame) -> DataFrame:
    """What is shown of result rows: a label and a value; rows without a value are not shown."""
    label = display_label(F.col("driver_name"), F.col("team"), F.col("player"), F.col("rank"), F.col("id"))
    shown = rows.withColumns({"label": label, "shown": nan_to_null(F.coalesce("pred", "score", "value"))})
    return shown.where("shown IS NOT NULL").select(rows.columns[0], "label", F.col("shown").alias("value"))


def document_score(rows: Column) -> Column:
    """Mean of the numeric predictions in an array of result rows, null if there are none."""
    preds = F.filter(F.transform(rows, lambda r: r["pred"]), lambda p: p.isNotNull())
    total = F.aggregate(preds, F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.size(preds) > 0, total / F.size(preds))


def run_scores(rows: DataFrame, key: str = "run_id", pred: str = "pred") -> DataFrame:
    """Mean prediction per run from result rows, combined on the map side."""
    return rows.groupBy(key).agg(F.avg(pred).alias("score"))


def status_counts(runs: DataFrame) -> DataFrame:
    """Total, done, failed and still pending runs."""
    word = status_word(F.col("status"))
    counted = runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(word == "done").alias("done"),
        F.count_if(word == "error").alias("failed"),
    )
    return counted.withColumn("pending", F.col("total") - F.col("done") - F.col("failed"))


def sweep_status(runs: DataFrame) -> DataFrame:
    """done without failures, error without successes, else partial."""
    word = status_word(F.col("status"))
    failures, successes = F.count_if(word == "error"), F.count_if(word == "done")
    rolled = F.when(failures == 0, "done").when(successes == 0, "error").otherwise("partial")
    return runs.where("sweep_id is not null").groupBy("sweep_id").agg(rolled.alias("status"))


def sweep_progress(runs: DataFrame) -> DataFrame:
    """Finished and total runs per sweep."""
    return (
        runs.where("sweep_id is not null")
        .groupBy("sweep_id")
        .agg(
            F.count_if(status_word(F.col("status")).isin("done", "error")).alias("finished"),
            F.count(F.lit(1)).alias("total"),
        )
    )


def sweep_runs_of(runs: DataFrame, sweep_runs: DataFrame, sweep_id: str) -> DataFrame:
    """Runs of one sweep with their parameter value, oldest first."""
    chosen = sweep_runs.where(F.col("sweep_id") == sweep_id).select(F.col("run_id").alias("id"), "param_value")
    return runs.drop("sweep_id").join(chosen, "id").orderBy("created_at", "id")


def sweep_summary(runs: DataFrame, sweep_runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Score per run of every sweep, with parameter value and status."""
    listed = runs.drop("sweep_id").withColumnRenamed("id", "run_id").join(sweep_runs, "run_id")
    return listed.join(run_scores(rows), "run_id", "left").select(
        "sweep_id", "run_id", "created_at", status_word(F.col("status")).alias("status"), "param_value", "score"
    )


def sweep_grid(sweeps: DataFrame, base: str, param: str, values: str) -> DataFrame:
    """One parameter map per swept value: the base parameters with one key replaced.

    ``values`` is a JSON array; scalars become plain text and anything else JSON.
    """
    items = F.try_variant_get(F.try_parse_json(F.col(values)), "$", "array<variant>")
    exploded = sweeps.withColumn("_value", F.explode(items)).withColumn("param_value", json_text(F.col("_value")))
    others = F.map_filter(F.col(base), lambda k, v: k != F.col(param))
    return exploded.withColumn(
        "params", F.map_concat(others, F.create_map(F.col(param), F.col("param_value")))
    ).drop("_value")


def runs_compare(rows: DataFrame, run_ids: Sequence[str]) -> DataFrame:
    """Predictions of the chosen runs side by side, one row per competitor."""
    chosen = rows.where(F.col("run_id").isin(list(run_ids)))
    return chosen.groupBy("driver_name").pivot("run_id", list(run_ids)).agg(F.max("pred"))


def daily_counts(spark, created: DataFrame, last_day: str, days: int) -> DataFrame:
    """Runs per day for the ``days`` days up to ``last_day`` (UTC), zeros included."""
    end = F.to_date(F.lit(last_day))
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    recent = created.where(
        (F.col("created_at") >= F.date_sub(end, days - 1)) & (F.col("created_at") < F.date_add(end, 1))
    )
    counts = recent.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("runs"))
    # Both sides have at most ``days`` rows.
    return calendar.join(F.broadcast(counts), "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("runs", F.lit(0).cast("bigint")).alias("runs")
    )


def readiness(status: DataFrame) -> DataFrame:
    """Number of existing tables, and whether both matches and fixtures exist."""
    return status.agg(
        F.count_if("exists").alias("ready"),
        F.bool_and(F.when(F.col("name").isin("matches", "fixtures"), F.col("exists"))).alias("usable"),
    )
