"""Experiments, catalogue, sources, sinks and the incremental modes."""

import json

import pytest
from pyspark.sql import functions as F
from rows import values

from paddock import schemas
from paddock.operators import catalog
from paddock.operators import experiments as ex
from paddock.plans.sweep import sweep_predictions, sweep_scores
from paddock.sources import readers, sinks
from paddock.streaming import live


def test_sweep_roll_up(spark):
    rows = [("a", "done"), ("a", "success"), ("b", "done"), ("b", "failed"), ("c", "error"), ("d", "running"), (None, "done")]
    runs = spark.createDataFrame(rows, "sweep_id string, status string")
    assert dict(ex.sweep_status(runs).collect()) == {"a": "done", "b": "partial", "c": "error", "d": "done"}
    assert values(ex.sweep_progress(runs)) == [("a", 2, 2), ("b", 2, 2), ("c", 1, 1), ("d", 0, 1)]
    assert tuple(ex.status_counts(runs).first()) == (7, 4, 2, 1)


def test_abort_cascade(spark):
    runs = spark.createDataFrame([("1", "queued", "x"), ("2", "done", "x"), ("3", "running", "y"), ("4", "queued", None)], "id string, status string, sweep_id string")
    sweeps = spark.createDataFrame([("x", "failed"), ("y", "running")], "id string, status string")
    assert values(ex.abort_cascade(runs, sweeps).select("id", "status")) == [("1", "error"), ("2", "done"), ("3", "running"), ("4", "queued")]


def test_sweep_grid(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, "a", '[5, "x", true, [1]]')], "base map<string,string>, param string, vals string")
    got = ex.sweep_grid(df, "base", "param", "vals").select("param_value", "params").collect()
    assert [(r[0], r[1]) for r in got] == [(v, {"b": "2", "a": v}) for v in ("5", "x", "true", "[1]")]


def test_result_documents(spark, tmp_path):
    for run, rows in (("r1", [{"rank": 1, "driver_name": "A", "pred": 2.0}, {"rank": 2, "driver_name": "B", "pred": None}, {"rank": 3, "driver_name": "C", "pred": 3.0}]), ("r2", [])):
        (tmp_path / run).mkdir()
        (tmp_path / run / "result.json").write_text(json.dumps({"version": "V1", "rows": rows, "notes": []}))
    docs = readers.read_results(spark, f"{tmp_path}/*/result.json")
    assert values(docs.select("run_id", ex.document_score(F.col("result.rows")))) == [("r1", 2.5), ("r2", None)]
    assert ex.result_rows(docs).count() == 4
    assert dict(ex.run_scores(ex.result_rows(docs)).collect()) == {"r1": 2.5, "r2": None}


def test_sweep_plan(spark):
    def predict(year, rnd):
        return spark.createDataFrame([(float(year + rnd),), (float(rnd),)], "pred double")

    got = sweep_scores(sweep_predictions(predict, {"year": 10, "rnd": 1}, "rnd", [2, 4]))
    assert values(got) == [("2", 7.0), ("4", 9.0)]


def test_upsert_and_compare(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id int, v string, at int")
    assert values(ex.upsert_latest(old, new, "id", ["at"])) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    rows = spark.createDataFrame([("x", "A", 1.0), ("y", "A", 2.0), ("y", "B", 3.0), ("z", "A", 9.0)], "run_id string, driver_name string, pred double")
    assert values(ex.runs_compare(rows, ["x", "y", "gone"])) == [("A", 1.0, 2.0, None), ("B", None, 3.0, None)]


def test_daily_counts(spark):
    runs = spark.createDataFrame([("2024-03-01 23:59:59",), ("2024-03-03 00:00:00",), ("2024-02-01 00:00:00",)], "t string")
    got = ex.daily_counts(spark, runs.select(F.to_timestamp("t").alias("created_at")), "2024-03-03", 3)
    assert values(got) == [("2024-03-01", 1), ("2024-03-02", 0), ("2024-03-03", 1)]


INDEX = """**Research papers**
**F1**
- Lap times
- File: `papers/F1/laps.pdf`
- Source: http://a.example/x:1
- Orphan source title
- Source: http://ignored.example

**Football**
- Goals
- File: papers/Football/goals.pdf
- File: `papers/Football/more.pdf`
- Source: http://b.example
"""


def test_paper_index(spark, tmp_path):
    (tmp_path / "README.md").write_text(INDEX)
    got = catalog.parse_index(readers.index_lines(spark, f"{tmp_path}/README.md"))
    assert values(got.select("file", "title", "sport", "source")) == [
        ("goals.pdf", "Goals", "Football", None),
        ("laps.pdf", "Lap times", "F1", "http://a.example/x:1"),
        ("more.pdf", "Goals", "Football", "http://b.example"),
    ]


def test_research_tree(spark, tmp_path):
    for path in ("papers/F1/lap-times.pdf", "papers/F1/note.txt", "projects/F1/Quali/Jupyter/a.ipynb", "projects/F1/Quali/data/b.ipynb"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("{}")
    papers = readers.papers_under(spark, f"{tmp_path}/papers")
    assert [r.sport for r in papers.collect()] == ["F1"]
    index = spark.createDataFrame([("other.pdf", "T", "S", "u")], "file string, title string, sport string, source string")
    assert catalog.enrich_papers(papers, index).select("sport", "title", "source").first() == ("F1", "lap times", None)
    (tmp_path / "projects/F1/Quali/Jupyter/model-research.ipynb").write_text("{}")
    (tmp_path / "projects/Tennis/Serve/Python").mkdir(parents=True)
    (tmp_path / "projects/Tennis/Serve/Python/run.py").write_text("pass")
    found = values(readers.projects_under(spark, f"{tmp_path}/projects"))
    assert [(r[0], r[1], bool(r[2]), (r[3] or "")[-7:]) for r in found] == [("F1", "Quali", True, ""), ("Tennis", "Serve", False, "/Python")]
    books = readers.notebooks_under(spark, f"{tmp_path}/projects").collect()
    assert [(b.sport, b.project, b.file.rsplit("/", 1)[1]) for b in sorted(books, key=lambda b: b.file)] == [("F1", "Quali", "a.ipynb"), ("F1", "Quali", "model-research.ipynb")]


def test_search_and_resolve(spark):
    items = spark.createDataFrame([("F1", "Rain_Model"), ("F1", "Rain"), ("Football", "Goals")], "sport string, name string")
    assert catalog.keyword_search(items, " rain ", ["name"], "f1").count() == 2
    assert catalog.resolve_unique(items, "rain model", ["name"]).first() == ("F1", "Rain_Model")
    assert catalog.resolve_unique(items, "rain", ["name"]).count() == 0
    assert catalog.resolve_exact(items, "RAIN", "f1", "name").first() == ("F1", "Rain")
    assert catalog.resolve_nth(items, 2, ["sport", "name"]).first() == ("F1", "Rain_Model")
    assert catalog.resolve_nth(items, 1, ["name"], "football").first() == ("Football", "Goals")
    assert catalog.resolve_nth(items, 9, ["name"]).count() == 0 and catalog.resolve_nth(items, 0, ["name"]).count() == 0
    papers = spark.createDataFrame([("F1", "Wet laps", "rain.pdf")], "sport string, title string, file string")
    assert values(catalog.search_scopes(items, papers, "rain")) == [("papers", "F1", "Wet laps"), ("projects", "F1", "Rain"), ("projects", "F1", "Rain_Model")]
    assert catalog.search_scopes(items, papers, "rain", "papers").count() == 1


def test_overview(spark):
    projects = spark.createDataFrame([("F1", "nb", None), ("F1", None, "py")], "sport string, notebook string, python_dir string")
    papers = spark.createDataFrame([("F1",), ("Tennis",)], "sport string")
    assert values(catalog.overview_counts(projects, papers)) == [("F1", 2, 1, 1, 1), ("Tennis", 0, 0, 0, 1)]


def test_formats_and_fixtures(spark, tmp_path):
    rows = 'match_id,date,season,league,home_team_id,away_team_id,home_goals,away_goals\n'
    rows += 'm1,2026-02-14 15:00,2026,"Ligue ""1"", top",A,B,,\nm2,2026-02-14,2026,,C,D,1,2\n'
    (tmp_path / "fixtures.csv").write_text(rows)
    names = "match_id date season league home_team_id away_team_id home_goals away_goals".split()
    schema = type(schemas.MATCHES)([schemas.MATCHES[n] for n in names])
    table = readers.read_best_format(spark, str(tmp_path), "fixtures", schema)
    assert values(readers.fixtures_head(table, 0)) == [
        ("m1", "2026-02-14 15:00", "2026", 'Ligue "1", top', "A", "B"), ("m2", "2026-02-14", "2026", "", "C", "D")]
    assert readers.fixtures_head(table, 1).count() == 1
    assert [r.match_id for r in readers.fixtures_of(table).collect()] == ["m1"]
    times = [str(r[0]) for r in table.orderBy("match_id").select(readers.match_time(F.col("date"))).collect()]
    assert times == ["2026-02-14 15:00:00", "2026-02-14 00:00:00"]
    status = readers.table_status(spark, str(tmp_path), ["teams", "matches", "fixtures"])
    assert values(status.select("name", "format", "exists")) == [("fixtures", "csv", True), ("matches", "parquet", False), ("teams", "parquet", False)]
    assert tuple(ex.readiness(status).first()) == (1, False)
    with pytest.raises(FileNotFoundError):
        readers.read_best_format(spark, str(tmp_path), "matches")


def test_result_columns(spark):
    raw = spark.createDataFrame([("VER", "1", 3.0, 88.5), ("HAM", "44", float("nan"), None)], "Abbreviation string, DriverNumber string, ClassifiedPosition double, Q3 double")
    got = readers.results_from_columns(raw, readers.RACE_POSITION_COLUMNS)
    assert values(got) == [("HAM", "HAM", None, None), ("VER", "VER", 3.0, 88.5)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all'), (2, None)], "i int, s string")
    path = sinks.write_csv(df, f"{tmp_path}/out")
    assert values(readers.read_csv(spark, path, df.schema)) == values(df)


def test_ordered_write(spark, tmp_path):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("k"))
    path = sinks.write_parquet(sinks.in_order(df, [F.col("k")]), f"{tmp_path}/sorted")
    assert spark.read.parquet(path).count() == 200


def test_streams_equal_batch(spark, tmp_path):
    log = spark.createDataFrame([(1, "queued", 1), (1, "done", 3), (2, "queued", 2), (1, "running", 2)], "id int, status string, at int")
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    stream = live.stream_table(spark, f"{tmp_path}/log", "*.parquet", log.schema)
    assert values(live.drain(live.live_state(stream, "id", ["at"]), "t")) == values(ex.current_state(log, "id", ["at"]))
