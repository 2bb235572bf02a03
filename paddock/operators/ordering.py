"""Ranks, medians and carries that never put an unbounded group into one task.

A plain ``Window.partitionBy(group)`` sorts each group in a single task, and
one event may hold a third of all rows.  Here values are first counted
(map-side combine), then dealt out in ranges of (group, value) of about equal
size, whatever the values are; inside a range a window orders them, and only
range totals are accumulated per group.  The answers are exact, null is a group
like any other, and any type that can be ordered can be ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.scalars import nan_to_null
from paddock.session import cut_lineage


def known(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which all the columns have a value.

    Stated once at the bottom of a pipeline, this is also what joins infer for
    their keys, so all branches over the same input share one exchange.
    """
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in cols]))


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one-row-per-group statistics to the rows of the groups; null keys meet null keys.

    Small statistics become a broadcast by their size at run time; else a hot
    group's rows are one side of a sort-merge join, which Spark splits
    (``forceOptimizeSkewedJoin``), while its statistics are a single row.
    """
    nullable = {f.name for df in (rows, stats) for f in df.schema.fields if f.nullable}
    if not nullable.intersection(keys):
        return rows.join(stats, list(keys), how)
    names = {k: f"_{k}_of_group" for k in keys}
    tests = [F.col(k).eqNullSafe(F.col(names[k])) if k in nullable else F.col(k) == F.col(names[k]) for k in keys]
    return rows.join(stats.withColumnsRenamed(names), reduce(and_, tests), how).drop(*names.values())


def in_ranges(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt out in ranges of the order ``by``, with the number of their range in ``_range``.

    Ranges follow the sampled distribution, so outliers, infinities and gaps
    don't matter, and equal rows share one.  They are written, as two branches
    read them and must see the same ranges.
    """
    return cut_lineage(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")


def totals_before(
    counts: DataFrame,
    group: Sequence[str],
    key: str,
    weight: str,
    out: str = "before",
    lowest: str | None = None,
    total: str | None = None,
    few: bool = False,
) -> DataFrame:
    """Sum of ``weight`` over the smaller keys of the same group.

    ``counts`` holds one row per (group, key), the key non-null.  ``few`` says
    that the keys of a group are few (points, positions of a fixed table).  The
    smallest key and the total weight of the group can be had from the same pass.
    """
    zero = F.lit(0).cast("bigint")
    whole = Window.partitionBy(*group)

    def extras(key_col: str, weight_col: str) -> dict[str, Column]:
        found = {}
        if lowest:
            found[lowest] = F.min(key_col).over(whole)
        if total:
            found[total] = F.sum(weight_col).over(whole)
        return found

    def running(weight_col: str, *, by: Sequence[str], order: str) -> Column:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(weight_col).over(w), zero)

    if few:
        return counts.withColumns({out: running(weight, by=group, order=key), **extras(key, weight)})
    placed = in_ranges(counts, *group, key)
    # A group has as many rows here as ranges, which the partition setting bounds.
    offsets = (
        placed.groupBy(*group, "_range")
        .agg(F.sum(weight).alias("_total"), F.min(key).alias("_lowest"))
        .withColumns({"_offset": running("_total", by=group, order="_range"), **extras("_lowest", "_total")})
        .drop("_total", "_lowest")
    )
    within = placed.withColumn("_within", running(weight, by=[*group, "_range"], order=key))
    return (
        attach(within, offsets, [*group, "_range"], "inner")
        .withColumn(out, F.col("_offset") + F.col("_within"))
        .drop("_range", "_offset", "_within")
    )


def value_ranks(df: DataFrame, group: Sequence[str], key: str, few: bool = False, **extra: str) -> DataFrame:
    """One row per distinct non-null key of a group: how many rows come before it and how many tie."""
    counts = df.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count(F.lit(1)).alias("ties"))
    return totals_before(counts, group, key, "ties", few=few, **extra)


def with_min_rank(
    df: DataFrame, group: Sequence[str], key: str, out: str, descending: bool = False, few: bool = False
) -> DataFrame:
    """Add the rank of ``key`` in its group, ties sharing the smallest rank; null keys have no rank."""
    ranks = value_ranks(df, group, key, few, total="_n")
    place = F.col("_n") - F.col("before") - F.col("ties") if descending else F.col("before")
    return attach(df, ranks.select(*group, key, (place + 1).alias(out)), [*group, key])


def with_average_rank(df: DataFrame, group: Sequence[str], key: str, out: str) -> DataFrame:
    """Add the rank of ``key`` in its group, ties sharing the mean of their places."""
    place = F.col("before") + (F.col("ties") + 1) / F.lit(2)
    return attach(df, value_ranks(df, group, key).select(*group, key, place.alias(out)), [*group, key])


def melt(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows (group, name, value) for the non-null values of ``cols``, as doubles."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), nan_to_null(F.col(c).cast("double")).alias("value")) for c in cols])
    long = df.select(*group, F.inline(pairs))
    return long.where(F.col("value").isNotNull())


def exact_medians(long: DataFrame, group: Sequence[str], value: str = "value", few: bool = False) -> DataFrame:
    """Exact median per group as a double: the middle value, or the mean of the two middle ones.

    Picked from running counts, so no large group is buffered as a whole.
    """
    doubles = long.select(*group, nan_to_null(F.col(value).cast("double")).alias(value))
    placed = value_ranks(doubles, group, value, few, total="_n")
    last = F.col("before") + F.col("ties")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") < place) & (place <= last), F.col(value)))

    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    # Halved first, so that the sum of two very large values is no infinity.
    return placed.groupBy(*group).agg((at(low) / 2 + at(high) / 2).alias("median"))


def wide_medians(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per group with the median of every column as ``<col>_median``, null for an all-null column."""
    medians = exact_medians(melt(df, group, cols), [*group, "name"])
    picks = [F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"{c}_median") for c in cols]
    return medians.groupBy(*group).agg(*picks)


def impute_medians(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Fill nulls and NaN of ``cols`` with the median of their group, then with 0.

    The frame is read for the medians and again to be filled, so it is written once.
    """
    df = cut_lineage(df, "impute")
    filled = attach(df, wide_medians(df, group, cols), group)
    values = {
        c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.col(f"{c}_median"), F.lit(0.0)) for c in cols
    }
    return filled.withColumns(values).drop(*[f"{c}_median" for c in cols])


def first_places(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, out: str) -> DataFrame:
    """The first ``n`` rows of every group, numbered from 1.

    Spark keeps at most ``n`` rows per group and task before the exchange.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` for every key, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def carry_forward(df: DataFrame, group: Sequence[str], position: str, cols: Sequence[str]) -> DataFrame:
    """Replace nulls of ``cols`` by the latest earlier non-null value of the same group.

    Rows are filled inside ranges of (group, position), whose ends are carried
    over to the ranges behind; rows without a position come first.
    """
    cut = in_ranges(df, *group, position)
    order = F.col(position).asc_nulls_first()
    inside = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    here = cut.withColumns({f"_{c}_here": F.last(c, ignorenulls=True).over(inside) for c in cols})
    placed = F.struct(F.col(position).isNotNull(), F.col(position))
    ends = cut.groupBy(*group, "_range").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), placed)).alias(f"_{c}_end") for c in cols]
    )
    starts = ends.select(
        *group, "_range", *[F.last(f"_{c}_end", ignorenulls=True).over(earlier).alias(f"_{c}_start") for c in cols]
    )
    return attach(here, starts, [*group, "_range"]).withColumns(
        {c: F.coalesce(F.col(f"_{c}_here"), F.col(f"_{c}_start")) for c in cols}
    ).select(*df.columns)
