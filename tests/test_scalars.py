import datetime as dt

import pytest
from pyspark.sql import functions as F

from paddock.functions import scalars as fn


def column(spark, kind, items, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_to_number(spark):
    texts = ["1.5", " 5 ", "1e3", "DNF", "", "1d", "2F", "0x1p3", "nan", "-inf", None]
    got = column(spark, "string", texts, fn.to_number)
    assert got == [1.5, 5.0, 1000.0, None, None, None, None, None, None, float("-inf"), None]


def test_points(spark):
    got = column(spark, "double", [1.0, 10.0, 11.0, None, 0.0, 2.9, -1.0], fn.points_for)
    assert got == [25, 1, None, None, 0, 18, 0]


def test_status_words(spark):
    got = column(spark, "string", ["success", "FAILED", "Running", "", None, "weird"], fn.status_word)
    assert got == ["done", "error", "running", "queued", "queued", "weird"]


def test_clamp(spark):
    texts = ["7.5", "-3", "x", "250", "12abc", None, "  4e1 kg"]
    got = column(spark, "string", texts, lambda c: fn.clamp(fn.leading_number(c), 2.0, 0.0, 100.0))
    assert got == [7.5, 0.0, 2.0, 100.0, 12.0, 2.0, 40.0]
    numbers = column(spark, "double", [float("nan"), float("inf"), 5.0], lambda c: fn.clamp(c, 250.0, 0.0, 100.0))
    assert numbers == [250.0, 250.0, 5.0]


def test_fallbacks(spark):
    df = spark.createDataFrame(
        [("", "M", "C", 1), (None, "", "C", 2), (None, None, None, 3), ("", "", "", 4)],
        "e string, m string, c string, r int",
    )
    got = df.orderBy("r").select(fn.event_label(F.col("e"), F.col("m"), F.col("c"), F.col("r"))).collect()
    assert [r[0] for r in got] == ["M", "C", "Round 3", ""]
    pairs = spark.createDataFrame([(0, 4), (3, 4), (None, 4), (0, 0)], "s int, c int")
    assert [r[0] for r in pairs.select(fn.first_nonzero(F.col("s"), F.col("c"))).collect()] == [4, 3, 4, 0]


def test_row_mean(spark):
    df = spark.createDataFrame([(0.4, None, 0.2), (None, None, None), (1.0, 2.0, 3.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(fn.row_mean([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got[0] == pytest.approx(0.3) and got[1] is None and got[2] == 2.0


def test_interval_seconds(spark):
    spans = [dt.timedelta(days=1, hours=2, minutes=3, seconds=4, microseconds=125000), dt.timedelta(0), None]
    assert column(spark, "interval day to second", spans, fn.interval_seconds) == [93784.125, 0.0, None]


def test_duration_variants(spark):
    texts = ["90.1", "[91.0,90.5,89.9]", "[91.0,90.5]", "null", "[91.0,90.5,null]"]

    def both(c):
        v = F.try_parse_json(c)
        return F.struct(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$[2]", "double"))

    got = [tuple(r) for r in column(spark, "string", texts, both)]
    assert got == [(90.1, None), (None, 89.9), (None, None), (None, None), (None, None)]


def test_lists(spark):
    assert column(spark, "string", ["2024, 2023,,2024 "], fn.year_list) == [[2023, 2024]]
    year = F.lit(2026)
    got = column(spark, "string", ["auto", "Default", "2020, 2018,"], lambda c: fn.seasons(c, year))
    assert got == [[2024, 2025, 2026], [2024, 2025, 2026], [2020, 2018]]


def test_params(spark):
    texts = ['{"a": 7}', '{"a": "12abc"}', '{"a": 3.9}', '{"a": null}', '{"a": true}', '{"b": 1}', '{"a": "x"}']
    assert column(spark, "string", texts, lambda c: fn.param_int(c, "a", 5)) == [7, 12, 3, 5, None, 5, None]
    assert column(spark, "string", texts, lambda c: fn.param_bool(c, "a", False)) == [False] * 4 + [True] + [False] * 2
    assert column(spark, "string", texts[:2], lambda c: fn.param_string(c, "a", "z")) == ["7", "12abc"]
    assert column(spark, "string", ["12abc", "x", " -4"], fn.form_int) == [12, 0, -4]
    assert column(spark, "string", ["True", "yes"], fn.form_bool) == [True, False]


def test_titles_and_names(spark):
    paths = ["papers/F1/lap-time-model.pdf", "noext", "a/b.c/x-y.v2.pdf"]
    assert column(spark, "string", paths, fn.title_of) == ["lap time model", "noext", "x y.v2"]
    assert column(spark, "string", [" Match_Result "], fn.normalise) == ["match result"]


def test_fingerprint(spark):
    import hashlib

    got = spark.range(1).select(fn.fingerprint(F.create_map(*map(F.lit, ["b", "2", "a", "1"])))).first()[0]
    assert got == hashlib.md5(b"a=1&b=2").hexdigest()


def test_version(spark):
    assert column(spark, "int", [0, 1, 2, 14], fn.version_label) == ["V1", "V1", "V2", "V14"]


def test_json_text(spark):
    texts = ["1", "2.5", '"a"', "true", "[1,2]", '{"k":1}']
    assert column(spark, "string", texts, lambda c: fn.json_text(F.try_parse_json(c))) == [
        "1", "2.5", "a", "true", "[1,2]", '{"k":1}',
    ]
