"""Ranges, null groups and intermediate tables."""

import os
from datetime import date

from pyspark.sql import functions as F

from paddock.operators import ordering
from paddock.session import cut_lineage, drop_stages, scratch_path, shared_dir

SUPPLIER = "/root/testdata/sf0.001/supplier.parquet"


def ranks(df, key, **more):
    return sorted(((r["g"] is not None, r["g"] or "", r[key] is not None, r[key] or 0, r["r"] or 0) for r in ordering.with_min_rank(df, ["g"], key, "r", **more).collect()))


def test_null_is_a_group_like_any_other(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 3.0), (None, None), ("a", 1.0), ("a", 1.0)], "g string, v double")
    assert ranks(df, "v") == [(False, "", False, 0, 0), (False, "", True, 3.0, 1), (False, "", True, 5.0, 2), (True, "a", True, 1.0, 1), (True, "a", True, 1.0, 1)]
    filled = sorted((r["g"] or "", r["v"]) for r in ordering.impute_medians(df, ["g"], ["v"]).collect())
    assert filled == [("", 3.0), ("", 4.0), ("", 5.0), ("a", 1.0), ("a", 1.0)]


def test_medians_of_large_whole_numbers_and_nan(spark):
    df = spark.createDataFrame([("a", 2_000_000_000), ("a", 2_000_000_001)], "g string, value int")
    assert ordering.exact_medians(df, ["g"]).first()["median"] == 2000000000.5
    holes = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("a", 4.0)], "g string, v double")
    assert sorted(r["v"] for r in ordering.impute_medians(holes, ["g"], ["v"]).collect()) == [2.0, 3.0, 4.0]


def test_dates_and_texts_have_ranks(spark):
    rows = [("a", date(2024, 1, d), t) for d, t in ((3, "x"), (1, "z"), (3, "y"), (2, "x"))]
    df = spark.createDataFrame(rows, "g string, d date, t string")
    assert sorted(r["r"] for r in ordering.with_min_rank(df, ["g"], "d", "r").collect()) == [1, 2, 3, 3]
    assert sorted((r["t"], r["r"]) for r in ordering.with_min_rank(df, ["g"], "t", "r", descending=True).collect()) == [("x", 3), ("x", 3), ("y", 2), ("z", 1)]
    carried = spark.createDataFrame([("a", date(2024, 1, 1), "x"), ("a", date(2024, 2, 1), None), (None, date(2024, 1, 1), None)], "g string, d date, v string")
    assert sorted((r["g"] or "", r["v"] or "") for r in ordering.carry_forward(carried, ["g"], "d", ["v"]).collect()) == [("", ""), ("a", "x"), ("a", "x")]


def test_ranges_cannot_collapse(spark):
    """Outliers, infinities and wide gaps leave ranges of about equal size, as many as partitions at most."""
    inf = float("inf")
    for values in ([float(x) for x in range(20_000)] + [1e15, inf, -inf], [x * 1e6 for x in range(20_000)]):
        df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            sizes = [r["count"] for r in ordering.in_ranges(df, "g", "v").groupBy("_range").count().collect()]
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert 2 <= len(sizes) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert max(sizes) < 2.5 * len(values) / len(sizes)


def test_written_stage_keeps_rows_and_schema(spark):
    df = spark.read.parquet(SUPPLIER).withColumn("twice", F.col("s_acctbal") * 2)
    stage = cut_lineage(df)
    assert stage.schema.names == df.schema.names and stage.count() == df.count()


def test_stages_are_gone_afterwards(spark):
    folder = shared_dir(spark).removeprefix("file:")
    cut_lineage(spark.range(5), "gone")
    scratch_path(spark, "never")
    assert any(x.startswith("gone-") for x in os.listdir(folder))
    drop_stages()
    assert not any(x.startswith(("gone-", "never-")) for x in os.listdir(folder))
