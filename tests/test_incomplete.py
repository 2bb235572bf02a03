"""Incomplete and odd input: tables by name, streams in every mode, predictions without data."""

import pytest
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import functions as F

from paddock.functions.parameters import MOTORSPORT, rejections
from paddock.functions.scalars import param_int
from paddock.operators import dataset as ds
from paddock.operators import models, practice
from paddock.plans.predict import Tables, predict_round
from paddock.sources import readers, sinks
from paddock.streaming import live


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,match_id,goals\n2024-01-02,m1,3\n,m2,1d\n")
    schema = spark.createDataFrame([], "match_id string, date date, goals double, venue string").schema
    rows = sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "t.csv"), schema).collect()))
    assert [(r[0], str(r[1]), *r[2:]) for r in rows] == [("m1", "2024-01-02", 3.0, None), ("m2", "None", None, None)]


def test_numbers_follow_one_rule(spark):
    raw = spark.createDataFrame([("A", "1d", "NaN", 0), ("B", "2", "88.5", 1)], "Driver string, Position string, Q3 string, ord int")
    got = readers.results_from_columns(raw, readers.QUALIFYING_POSITION_COLUMNS)
    assert sorted((r["driver_id"], r["position"], r["q3_time"], r["ord"]) for r in got.collect()) == [("A", None, None, 0), ("B", 2.0, 88.5, 1)]
    results = spark.createDataFrame([(1, 4, "2f", "90.5", 0), (1, 5, "3", "null", 1)], "session_key int, driver_number int, position string, text string, ord int")
    results = results.withColumn("duration", F.try_parse_json("text"))
    drivers = spark.createDataFrame([(1, 4, "NOR", 0)], "session_key int, driver_number int, name_acronym string, ord int")
    named = practice.results_with_names(results, drivers).collect()
    assert sorted((r["driver_name"], r["position"], r["seconds"]) for r in named) == [("5", 3.0, None), ("NOR", None, 90.5)]


@pytest.mark.parametrize("text,want", [('{"n": "1e3"}', 1), ('{"n": 1e3}', 1000), ('{"n": ".5"}', None), ('{"n": 2.9}', 2), ("{}", 7)])
def test_whole_parameters_by_kind(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(param_int(F.col("c"), "n", 7)).first()[0] == want


def test_streams_are_complete_in_every_mode(spark, tmp_path):
    schema = "key string, at long, day string"
    folder = str(tmp_path / "log")
    for i, rows in enumerate(([("a", 1, "x")], [("a", 2, "x"), ("b", 3, "y")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert live.drain(stream, "append", "append").count() == 3
    counts = stream.groupBy("day").count()
    assert sorted(map(tuple, live.drain(counts, "update", "update", ["day"]).collect())) == [("x", 2), ("y", 1)]
    assert sorted(map(tuple, live.drain(counts, "complete").collect())) == [("x", 2), ("y", 1)]
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    assert live.drain(empty, "empty", "append").collect() == []


def tables(spark, targets=True, practice_rows=True):
    cols = ["fp1_delta", "fp2_delta", "fp3_delta", "fp1_rank", "fp2_rank", "fp3_rank", "fp_mean_delta", "fp_mean_rank"]
    laps = [("s", 2024, r, f"D{d}", f"D{d}", *[float(d + r % 3)] * len(cols)) for r in range(1, 8) for d in range(6)]
    fp = spark.createDataFrame(laps, "source string, year int, round_number int, driver_id string, driver_name string, " + ", ".join(f"{c} double" for c in cols))
    results = fp.select("source", "year", "round_number", "driver_id", "driver_name")
    position = (F.substring("driver_id", 2, 3).cast("double") + 1) if targets else F.lit(None).cast("double")
    quali = results.withColumns({"position": position, "q3_time": position + 80, "ord": F.lit(0)})
    if not practice_rows:
        fp = fp.where("round_number <> 7")
    return Tables(fp, quali, results.withColumns({"position": position, "ord": F.lit(0)}))


def ridge():
    return next(m for m in models.candidates() if m.name == "ridge")


def test_standings_may_be_missing(spark):
    got = predict_round(tables(spark), "race", 2024, 7, [2024], include_standings=True, candidates=[ridge()])
    assert got.model == "ridge" and [r["driver_name"] for r in got.table.orderBy("rank").collect()][:2] == ["D0", "D1"]
    assert any("no standings" in n for n in got.notes)


def test_failing_candidates_are_left_out(spark):
    def fail(*_):
        raise RuntimeError("no library")

    broken = models.Candidate("broken", 0, fail, fail)
    late = models.Candidate("late", 1, ridge().errors, fail)
    got = predict_round(tables(spark), "qualifying", 2024, 7, [2024], candidates=[broken, late, ridge()])
    assert got.model == "ridge" and sum("failed" in n for n in got.notes) == 2
    alone = predict_round(tables(spark), "qualifying", 2024, 7, [2024], candidates=[broken])
    assert alone.model == "heuristic" and alone.table.count() == 6


def test_failures_are_no_results(spark, monkeypatch):
    """A job's failure is raised, a candidate left out is named, and the queries, which return the table alone, leave none out."""
    from workload import training

    def fail(error):
        def run(*_):
            raise error
        return run

    def broken(error):
        return models.Candidate("broken", 0, fail(error), fail(error)), models.Candidate("late", 0, ridge().errors, fail(error))

    for candidate, kind in ((broken(ValueError("singular"))[0], ValueError), (broken(PySparkRuntimeError("job aborted"))[1], PySparkRuntimeError)):
        with pytest.raises(kind):
            predict_round(tables(spark), "qualifying", 2024, 7, [2024], candidates=[candidate, ridge()])
    left_out, late = broken(RuntimeError("no library"))
    got = predict_round(tables(spark), "qualifying", 2024, 7, [2024], candidates=[left_out, ridge()])
    assert got.failures == {"broken": "RuntimeError: no library"} and got.model == "ridge"
    now, ridge_candidate = tables(spark), ridge()
    then = Tables(*(t.withColumns({"year": F.lit(1998), "round_number": F.col("round_number") - 1}) for t in (now.practice, now.qualifying, now.race)))
    monkeypatch.setattr(training, "_tables", lambda *_: then)
    for candidate in (left_out, late):
        monkeypatch.setattr(models, "candidates", lambda c=candidate: [c, ridge_candidate])
        with pytest.raises(RuntimeError, match="no library"):
            training.predict_qualifying(spark, "")


def test_no_targets_and_no_practice(spark):
    got = predict_round(tables(spark, targets=False), "qualifying", 2024, 7, [2024], candidates=[ridge()])
    assert got.model == "heuristic" and got.table.count() == 6
    none = predict_round(tables(spark, practice_rows=False), "qualifying", 2024, 7, [2024], candidates=[ridge()])
    assert none.table.collect() == [] and any("no practice" in n for n in none.notes)


def test_broken_records_become_notes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('match_id,goals,date\nm1,3,2024-01-02\nm2,three,2024-01-02\nm3,1\nm4,,\nm5,1,2024-01-02,more\nm6,x,soon\n"m,7",0,2024-02-30\n')
    schema = spark.createDataFrame([], "match_id string, goals int, date date, venue string").schema
    rows, notes = readers.read_csv_checked(spark, str(tmp_path / "t.csv"), schema)
    assert sorted((r["match_id"], r["goals"], str(r["date"]), r["venue"]) for r in rows.collect()) == [("m1", 3, "2024-01-02", None), ("m4", None, "None", None)]
    got = sorted(r["reason"] for r in notes.collect())
    assert got == ["date is no date", "goals is no int", "goals is no int; date is no date", "wrong number of fields", "wrong number of fields"]


def test_files_of_a_clustered_sink(spark, tmp_path):
    """A large value has as many files as its rows need, a small one has one, wherever the rows were."""
    rows = spark.range(3000).select((F.col("id") % 30 == 0).cast("int").alias("year"), F.lit("s").alias("source"), "id").repartition(8)
    path = sinks.write_parquet(rows, str(tmp_path / "out"), ["source", "year"], file_rows=1000)
    files = {y: len(list((tmp_path / "out" / "source=s" / f"year={y}").glob("*.parquet"))) for y in (0, 1)}
    assert files[1] == 1 and 1 < files[0] <= 3
    assert spark.read.parquet(path).count() == 3000


def test_rounds_of_meetings(spark):
    kind = "source string, year int, meeting_key long, meeting_name string, country_name string, date_start string, ord long"
    meetings = spark.createDataFrame([("a", 2024, 1, "One", "X", "2024-03-01", 0), ("a", 2024, 2, "Two", "Y", "2024-02-01", 1)], kind)
    assert practice.required_meeting(meetings, 2024, 9, meeting_name="One")["round_number"] == 2
    with pytest.raises(LookupError, match="round 9 in 2024"):
        practice.required_meeting(meetings, 2024, 9)


def test_rejections(spark):
    configs = ['{"mode":"race","source":"openf1","year":2024,"round_number":"3"}', '{"mode":"sprint","source":" ","year":"x"}', "no json", None]
    df = spark.createDataFrame([(c,) for c in configs], "c string")
    got = [r[0] for r in df.select(rejections(F.col("c"), MOTORSPORT)).collect()]
    missing = [f"{n} is missing" for n in ("mode", "source", "year", "round_number")]
    assert got == [[], ["mode is not one of qualifying, race", "source is missing", "year is not a number", "round_number is missing"], missing, missing]


def test_last_row_without_ordinal_is_defined(spark):
    rows = [("s", 2024, 1, "A", "A", p, None) for p in (3.0, 1.0, 2.0)]
    kind = "source string, year int, round_number int, driver_id string, driver_name string, position double, q3_time double"
    quali = spark.createDataFrame(rows, kind)
    none = quali.where("false")
    for parts in (1, 3):
        merged = ds.merge_kinds(ds.stack_kinds(none, quali.repartition(parts), none, none)).collect()
        assert [r["qualy_position"] for r in merged] == [3.0]


def test_spans_from_a_stream_of_shuffled_files(spark, tmp_path):
    """Files whose changes overlap in time, one file a batch: the runs of the batch operator that end before the watermark."""
    from paddock.operators import experiments as ex

    hour = 3_600_000_000
    words = ("queued", "running", "done", None)
    log = [(k if k % 9 else None, (i * i * 3 + k * 5) % 400 * hour + k, k * 1000 + i, words[(i * i + k) % 4]) for k in range(12) for i in range(60)]
    log += [(3, 90 * hour, 1, "done"), (3, 90 * hour, 2, "queued")]  # ties in time
    log.sort(key=lambda r: (r[1] // (20 * hour), r[2] % 13))  # out of order by less than the lateness
    part = len(log) // 4 + 1
    frames = [spark.createDataFrame(log[i : i + part], "id int, us long, n long, state string") for i in range(0, len(log), part)]
    frames = [f.withColumn("at", F.timestamp_micros("us")) for f in frames]
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{tmp_path}/log/{i}")
    rule = {"key": "id", "time": "at", "order": "n", "state": "state", "final": ["done"], "patience_seconds": 10 * 3600}
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
    got = live.drain(live.live_spans(stream, **rule, lateness="2 days"), "spans", "append")
    whole = ex.run_spans(spark.read.schema(frames[0].schema).parquet(f"{tmp_path}/log/*"), **rule)
    until = max(us for k, us, _, _ in log if k is not None) // 1000 * 1000 - 48 * hour
    want = whole.where(F.unix_micros("ended") < until)
    assert got.where("state = 'aborted'").count() > 5
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
