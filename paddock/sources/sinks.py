"""Writers for datasets and prediction documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.dataset import dataset_order
from paddock.operators.ordering import attach
from paddock.session import cut_lineage


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return path


#: Rows that a file of a partitioned table aims at.
FILE_ROWS = 2_000_000


def clustered(df: DataFrame, keys: Sequence[str], file_rows: int = FILE_ROWS) -> DataFrame:
    """The rows dealt out so that each value of the keys is in one task, or in as many as its rows fill files.

    The task within a large value depends on the row alone, so one that runs
    again writes the same rows.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(file_rows)).cast("int").alias("_files"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row a folder
    sizes = cut_lineage(sizes.withColumn("_first", F.coalesce(F.sum("_files").over(before), F.lit(0))), "sizes")
    tasks = sizes.agg(F.sum("_files")).first()[0] or 1
    task = (F.col("_first") + F.pmod(F.xxhash64(*df.columns), F.col("_files"))).cast("int")
    placed = attach(df, sizes, keys).withColumn("_task", task)
    return placed.repartitionById(tasks, "_task").drop("_task", "_files", "_first")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), file_rows: int = FILE_ROWS) -> str:
    """Parquet, in one folder per value of ``partition_by`` with as few files as its rows need."""
    rows = clustered(df, partition_by, file_rows) if partition_by else df
    rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def in_order(df: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Range partitions, each sorted: globally ordered files without a single sorting task."""
    keys = list(order) if order is not None else dataset_order()
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def prediction_documents(
    predictions: DataFrame, group: Sequence[str], version: Column, sport: str, project: str, generated_at: str
) -> DataFrame:
    """One JSON document per group from its top rows (rank, driver_name, pred), in rank order.

    The input is a top-n report, so a group is at most n rows.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "driver_name", "pred")))
    config = F.struct(*group)
    packed = predictions.groupBy(*group).agg(rows.alias("rows"))
    document = F.to_json(
        F.struct(
            version.alias("version"),
            F.lit(sport).alias("sport"),
            F.lit(project).alias("project"),
            config.alias("config"),
            "rows",
            F.array().cast("array<string>").alias("notes"),
            F.lit(generated_at).alias("generated_at"),
        )
    )
    return packed.select(*group, document.alias("document"))
