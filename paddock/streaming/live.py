"""Run state, run durations and daily counts kept up to date from a stream of state changes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from paddock.operators.ordering import keep_last
from paddock.session import scratch_path


def stream_table(spark: SparkSession, folder: str, file_pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", file_pattern).parquet(folder)


def live_state(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest change per key; state holds one row per key."""
    rest = [c for c in changes.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return changes.groupBy(key).agg(last).select(key, "_last.*").select(*changes.columns)


def live_daily_counts(changes: DataFrame, time: str, lateness: str = "2 days") -> DataFrame:
    """Changes per day; in update mode a day leaves the state once it is older than the allowed lateness."""
    stamped = changes.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    days = stamped.groupBy(F.window("_at", "1 day").alias("_day")).agg(F.count(F.lit(1)).alias("runs"))
    return days.select(F.date_format("_day.start", "yyyy-MM-dd").alias("day"), "runs")


def live_spans(
    changes: DataFrame,
    key: str,
    time: str,
    order: str,
    state: str,
    final: Sequence[str],
    patience_seconds: int,
    lateness: str = "2 days",
) -> DataFrame:
    """Finished runs of every key (key, started, ended, state, changes, seconds), each as soon as it is certain, in append mode.

    The same runs as ``experiments.run_spans``, but for those that end at the
    watermark or later.  The state of a key is its open run and the changes
    the watermark hasn't passed, so changes may come in any order within
    ``lateness``; later ones are dropped.  A timer closes a run that waits in
    vain.  Changes without key or time are dropped.
    """
    kinds = dict(changes.dtypes)
    patience, ends = patience_seconds * 1_000_000, tuple(final)

    def follow(keys: tuple, batches: Iterator, held) -> Iterator:
        import pandas as pd

        started, last, n, waiting = 0, 0, 0, []
        if held.exists:
            started, last, n, *parts = held.get
            waiting = list(zip(*parts))
        for batch in batches:
            waiting += zip(batch["_us"].tolist(), batch["_order"].tolist(), batch["_state"].tolist())
        passed = held.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda change: change[:2])
        ready = [change for change in waiting if change[0] < passed]
        waiting, out = waiting[len(ready) :], []
        for at, _, word in ready:
            if n and at >= last + patience:
                out.append((started, last + patience, "aborted", n))
                n = 0
            started, last, n = (started if n else at), at, n + 1
            if word in ends:
                out.append((started, at, word, n))
                n = 0
        if n and last + patience < passed:
            out.append((started, last + patience, "aborted", n))
            n = 0
        due = [waiting[0][0]] if waiting else []
        due += [last + patience] if n else []
        if due:
            at, number, word = (list(part) for part in zip(*waiting)) if waiting else ([], [], [])
            held.update((started, last, n, at, number, word))
            held.setTimeoutTimestamp(max(min(due) // 1000, held.getCurrentWatermarkMs(), 1))
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame([(keys[0], *row) for row in out], columns=[key, "_from", "_to", "state", "changes"])

    stamped = changes.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        key, F.col(time).cast("timestamp").alias("_at"), F.col(order).cast("long").alias("_order"), F.col(state).alias("_state")
    )
    spans = (
        stamped.withWatermark("_at", lateness)
        .withColumn("_us", F.unix_micros("_at"))
        .groupBy(key)
        .applyInPandasWithState(
            follow,
            f"{key} {kinds[key]}, _from long, _to long, state string, changes long",
            "started long, last long, n long, at array<long>, number array<long>, word array<string>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return spans.select(
        key,
        F.timestamp_micros("_from").alias("started"),
        F.timestamp_micros("_to").alias("ended"),
        "state",
        "changes",
        ((F.col("_to") - F.col("_from")) / 1_000_000).alias("seconds"),
    )


def drain(df: DataFrame, label: str, mode: str = "complete", keys: Sequence[str] = ()) -> DataFrame:
    """Process everything available, then return the whole result.

    Complete mode: what the last batch wrote.  Append mode: what all batches
    wrote.  Update mode: the last row of each of ``keys``.  Each batch replaces
    a folder of its own in the shared directory, so a restarted batch writes
    the same place again.  A source without data gives no rows.
    """
    spark = df.sparkSession
    home = scratch_path(spark, label)
    seen: list[int] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/batch={batch_id}")
        seen.append(batch_id)

    query: StreamingQuery = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{home}/_progress")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], df.schema)
    used = [max(seen)] if mode == "complete" else seen
    written = spark.read.schema(df.schema).option("basePath", home).parquet(*[f"{home}/batch={b}" for b in used])
    if mode != "update":
        return written.select(*df.columns)
    numbered = written.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long"))
    return keep_last(numbered, list(keys), ["_batch"]).select(*df.columns)
