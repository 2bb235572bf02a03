"""The distributed ordering operators against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paddock.operators import ordering


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 400
    frame = pd.DataFrame(
        {
            "g": rng.choice(["hot", "a", "b"], n, p=[0.6, 0.3, 0.1]),
            "id": np.arange(n),
            "v": rng.integers(-300_000, 300_000, n),
            "w": rng.integers(0, 6, n),
        }
    )
    frame.loc[frame["id"] % 9 == 0, "v"] = 77  # a hot tie
    return frame


def to_spark(spark, frame, holes=None):
    df = spark.createDataFrame(frame)
    return df if holes is None else df.withColumn("v", F.when(F.col("id") % holes != 0, F.col("v")))


@pytest.mark.parametrize("descending", [False, True])
def test_min_rank(spark, sample, descending):
    df = ordering.with_min_rank(to_spark(spark, sample), ["g"], "v", "r", descending)
    got = df.toPandas().set_index("id")["r"].sort_index()
    want = sample.set_index("id").groupby("g")["v"].rank(method="min", ascending=not descending)
    assert (got == want.astype(int).sort_index()).all()


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e12])
def test_fractions_of_any_unit(spark, sample, scale):
    df = to_spark(spark, sample).withColumn("x", F.col("v") * F.lit(scale))
    got = ordering.with_min_rank(df, ["g"], "x", "r").toPandas().set_index("id")["r"].sort_index()
    want = sample.set_index("id").groupby("g")["v"].rank(method="min").astype(int).sort_index()
    assert (got == want).all()


def test_infinite_keys(spark):
    inf = float("inf")
    rows = [("a", x) for x in (2.0, -inf, inf, 1.0, inf)] + [("b", inf)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted((r.g, r.v, r.r) for r in ordering.with_min_rank(df, ["g"], "v", "r").collect())
    assert got == [("a", -inf, 1), ("a", 1.0, 2), ("a", 2.0, 3), ("a", inf, 4), ("a", inf, 4), ("b", inf, 1)]


def test_null_keys_have_no_rank(spark, sample):
    got = ordering.with_min_rank(to_spark(spark, sample, holes=7), ["g"], "v", "r").toPandas()
    assert len(got) == len(sample)
    assert got.loc[got["id"] % 7 == 0, "r"].isna().all() and got.loc[got["id"] % 7 != 0, "r"].notna().all()


def test_average_rank(spark, sample):
    got = ordering.with_average_rank(to_spark(spark, sample), ["g"], "w", "r").toPandas().set_index("id")["r"]
    want = sample.set_index("id").groupby("g")["w"].rank(method="average")
    assert (got.sort_index() == want.sort_index()).all()


def test_medians_and_imputation(spark, sample):
    frame = sample.assign(v=sample["v"].where(sample["id"] % 5 != 0), e=np.nan)
    frame.loc[frame["g"] == "b", "v"] = np.nan
    df = spark.createDataFrame(frame).select(
        "g", "id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("v", "e")], F.col("w").cast("double").alias("w")
    )
    got = ordering.impute_medians(df, ["g"], ["v", "e", "w"]).toPandas().set_index("id").sort_index()
    want = frame.copy()
    for c in ("v", "e", "w"):
        want[c] = want[c].fillna(want.groupby("g")[c].transform("median")).fillna(0.0)
    want = want.set_index("id").sort_index()
    assert np.allclose(got[["v", "e", "w"]], want[["v", "e", "w"]], rtol=0, atol=0)


def test_median_of_even_and_odd(spark):
    rows = [("a", float(x)) for x in (1, 2, 10, 20)] + [("b", 5.0), ("c", 1.0), ("c", 2.0), ("c", 100.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    assert dict(ordering.exact_medians(df, ["g"]).collect()) == {"a": 6.0, "b": 5.0, "c": 2.0}


def test_carry_forward(spark):
    rows = [("a", 0, None), ("a", 1, "x"), ("a", 2, None), ("a", 9, None), ("a", 10, "y"), ("a", 25, None), ("b", 3, None)]
    df = spark.createDataFrame(rows, "g string, p int, v string")
    got = ordering.carry_forward(df, ["g"], "p", ["v"]).collect()
    assert sorted((r.g, r.p, r.v or "") for r in got) == [
        ("a", 0, ""), ("a", 1, "x"), ("a", 2, "x"), ("a", 9, "x"), ("a", 10, "y"), ("a", 25, "y"), ("b", 3, ""),
    ]


def test_keep_last_and_first_places(spark, sample):
    df = to_spark(spark, sample)
    last = ordering.keep_last(df, ["g"], ["w", "id"]).toPandas().set_index("g")["id"]
    want = sample.sort_values(["w", "id"]).groupby("g")["id"].last()
    assert (last.sort_index() == want.sort_index()).all()
    top = ordering.first_places(df, ["g"], [F.col("v"), F.col("id")], 3, "r").toPandas()
    assert sorted(top["r"]) == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_attach_keeps_rows(spark, sample):
    df = to_spark(spark, sample)
    stats = df.groupBy("g").agg(F.max("v").alias("m")).where("g <> 'b'")
    got = ordering.attach(df, stats, ["g"])
    assert got.count() == len(sample) and got.where("m is null").count() == (sample["g"] == "b").sum()


def test_partitioning_does_not_matter(spark, sample):
    df = to_spark(spark, sample)
    ranks = [
        sorted(map(tuple, ordering.with_min_rank(df.repartition(n), ["g"], "v", "r").collect())) for n in (1, 7)
    ]
    assert ranks[0] == ranks[1]


def test_top_n_is_cut_before_the_exchange(spark, sample):
    top = ordering.first_places(to_spark(spark, sample), ["g"], [F.col("v"), F.col("id")], 3, "r")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
