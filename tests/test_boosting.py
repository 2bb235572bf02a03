"""Boosted trees of all folds against one loop per fold."""

import numpy as np
import pandas as pd
import pytest

from paddock.operators import boosting

SMALL = boosting.Settings(iterations=6, step=0.3, depth=3, bins=16, least_rows=5)
NAMES = ["a", "b", "c"]


def table(n=400, seed=3, missing=0.1):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"a": rng.integers(0, 9, n).astype(float), "b": rng.integers(0, 5, n).astype(float), "c": rng.integers(0, 2, n).astype(float)})
    rows["target"] = rows.a * 2 + rows.b * rows.c + rng.normal(size=n)
    rows["event_key"] = (np.arange(n) // 40 + 199501).astype("int32")
    for c in NAMES:
        rows.loc[rng.random(n) < missing, c] = np.nan
    return rows


def plain(train, rows, settings):
    """Trees grown node by node on values; all values of a feature are cuts, as they are fewer than bins."""
    x, y = train[NAMES].to_numpy(float), train["target"].to_numpy(float)
    x, z = (np.where(np.isnan(v), np.nan_to_num(np.nanmedian(v, axis=0)), v) for v in (x, rows[NAMES].to_numpy(float)))
    pred, out = np.full(len(y), y.mean()), np.full(len(z), y.mean())

    def grow(mine, theirs, depth):
        r = (y - pred)[mine]
        best = (1e-9, None, None)
        for j in range(x.shape[1]) if depth < settings.depth else ():
            for cut in np.unique(x[:, j]):
                left = x[mine, j] <= cut
                if min(left.sum(), (~left).sum()) >= settings.least_rows:
                    gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, cut)
        if best[1] is None:
            step[mine] = settings.step * r.mean()
            held[theirs] = settings.step * r.mean()
            return
        for side in (True, False):
            grow(mine[(x[mine, best[1]] <= best[2]) == side], theirs[(z[theirs, best[1]] <= best[2]) == side], depth + 1)

    for _ in range(settings.iterations):
        step, held = np.zeros(len(y)), np.zeros(len(z))
        grow(np.arange(len(y)), np.arange(len(z)), 0)
        pred, out = pred + step, out + held
    return out


@pytest.mark.parametrize("block", [16_384, 60])
def test_folds_and_whole_table_equal_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(boosting, "BLOCK", block)
    monkeypatch.setattr(boosting, "PENDING", 2)
    monkeypatch.setattr(boosting, "CUT", 4)
    rows = table()
    folds = sorted(rows["event_key"].unique())[5:]
    found = boosting.fit(spark.createDataFrame(rows), NAMES, [int(k) for k in folds], SMALL)
    got = {(r["event_key"], round(r["target"], 9)): r["pred"] for r in found.validation.collect()}
    assert len(got) == int((rows["event_key"] >= folds[0]).sum())
    for k in folds:
        mine = rows[rows["event_key"] == k]
        want = plain(rows[rows["event_key"] < k], mine, SMALL)
        assert [got[k, round(t, 9)] for t in mine["target"]] == pytest.approx(list(want), abs=1e-9)
    complete = rows.fillna(rows[NAMES].median())
    scored = boosting.score(found.forest, spark.createDataFrame(complete), NAMES).toPandas().sort_values("target")
    want = plain(rows, complete, SMALL)[np.argsort(complete["target"].to_numpy())]
    assert scored["pred"].tolist() == pytest.approx(list(want), abs=1e-9)


def test_jobs_and_rows_of_a_task(spark, monkeypatch):
    """A small table meets every core; blocks beyond the tasks share them, and a tree whose guess holds is one job."""
    monkeypatch.setattr(boosting, "LEAST", 50)
    rows = pd.concat([table(seed=s, missing=0) for s in range(3)])
    cores = spark.sparkContext.defaultParallelism
    blocks = boosting._blocks(spark.createDataFrame(rows), NAMES, np.array([], np.int64), [np.arange(9.0)] * 3, np.zeros(1))
    assert blocks.getNumPartitions() == cores
    monkeypatch.setattr(boosting, "BLOCK", 20)
    many = boosting._blocks(spark.createDataFrame(rows), NAMES, np.array([], np.int64), [np.arange(9.0)] * 3, np.zeros(1))
    assert many.getNumPartitions() == boosting.WAVES * cores
    assert sum(many.map(lambda b: b["count"].sum()).collect()) == len(rows)
    monkeypatch.setattr(boosting, "BLOCK", 16_384)
    context, jobs = spark.sparkContext, {}
    for n in (5, 25):
        context.setJobGroup(f"trees-{n}", "")
        boosting.fit(spark.createDataFrame(rows), NAMES, settings=boosting.Settings(iterations=n, step=0.3, depth=4, bins=16, least_rows=5))
        jobs[n] = len(context.statusTracker().getJobIdsForGroup(f"trees-{n}"))
    # The rows fit the guide, so guesses hold but for ties: 20 trees more are some 20 jobs, not 80.
    assert jobs[25] - jobs[5] <= 30


def test_cells_that_a_task_holds_take_as_many_jobs_for_any_trees(spark):
    rows, jobs = spark.createDataFrame(table(n=800)), {}
    folds = [199511, 199512, 199513]
    for n in (2, 60):
        spark.sparkContext.setJobGroup(f"held-{n}", "")
        boosting.fit(rows, NAMES, folds, boosting.Settings(iterations=n, step=0.3, depth=4, bins=16, least_rows=5))
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"held-{n}"))
    assert jobs[60] == jobs[2]


@pytest.mark.parametrize("names", [NAMES, ["a"]])
def test_trees_grown_in_a_task_equal_those_of_jobs(spark, monkeypatch, names):
    """Also with cells of several rows, rows without event and an event after all others."""
    rows = table(n=900, seed=5)
    rows["event_key"] = rows["event_key"].astype("Int32").mask(np.arange(900) % 50 == 7)
    train, folds, got = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "a double, b double, c double, target double, event_key int"), [199510, 199515, 199517], []
    for held in (boosting.HELD, 0):
        monkeypatch.setattr(boosting, "HELD", held)
        found = boosting.fit(train, names, folds, boosting.Settings(iterations=12, step=0.3, depth=4, bins=16, least_rows=5))
        values = rows[names].fillna(rows[names].median()).to_numpy(float)
        got.append((sorted(map(tuple, found.validation.collect())), found.forest.score(values), len(found.forest.trees)))
    (held_out, scores, n), (held_out_jobs, scores_jobs, n_jobs) = got
    assert n == n_jobs == 12 and len(held_out) == len(held_out_jobs) == int(rows["event_key"].isin(folds).sum())
    assert scores == pytest.approx(scores_jobs, abs=1e-9)
    assert np.array(held_out) == pytest.approx(np.array(held_out_jobs), abs=1e-9)


@pytest.mark.parametrize("block", [16_384, 60])
def test_jobs_of_large_tables_equal_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(boosting, "HELD", 0)
    test_folds_and_whole_table_equal_a_loop(spark, monkeypatch, block)


def test_guesses_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(boosting, "HELD", 0)
    test_jobs_and_rows_of_a_task(spark, monkeypatch)


def test_rows_alike_are_one_cell(spark):
    rows = table(n=4_000, missing=0)
    rows["a"] = (rows["a"] > 4).astype(float)
    folds = np.array(sorted(rows["event_key"].unique())[50:], np.int64)
    blocks = boosting._blocks(spark.createDataFrame(rows), ["a"], folds, [np.array([0.0])], np.zeros(len(folds) + 1))
    for block in blocks.collect():
        assert block["pred"].shape == (len(folds) + 1, len(block["count"])) and len(block["count"]) <= 2 * (len(folds) + 1)
        assert (np.diff(block["first"]) >= 0).all() and len(block["row_cell"]) == len(block["row_target"])
    assert blocks.map(lambda b: b["count"].sum()).sum() == len(rows)
    assert blocks.map(lambda b: len(b["row_cell"])).sum() == int((rows["event_key"] >= folds[0]).sum())


def test_sums_of_upper_nodes_follow_from_the_deepest():
    rng = np.random.default_rng(2)
    n, p = 500, 2
    block = {"bins": rng.integers(0, 4, (p, n)).astype(np.uint8), "target": rng.normal(size=n), "first": np.zeros(n, np.int32), "pred": np.zeros((1, n))}
    block["count"] = np.ones(n)
    block["bins"][0, :50] = boosting.MISSING
    levels = [boosting.Level(np.array([[1]]), np.array([[2]])), boosting.Level(np.array([[0, -1]]), np.array([[1, 0]]))]
    fills = np.array([[2, 1]])
    found = boosting._by_depth(boosting._sums(block, levels, fills, 4), 0)
    assert [f.shape[2] for f in found] == [1, 2, 4]
    for depth, sums in enumerate(found):
        want = boosting._sums(block, levels[:depth], fills, 4)
        assert np.array_equal(sums[1], want[1]) and np.allclose(sums[0], want[0], atol=1e-12)


def test_odd_tables(spark):
    kind = "a double, b double, c double, target double, event_key int"
    empty = boosting.fit(spark.createDataFrame([], kind), NAMES, [1], SMALL)
    assert empty.validation.isEmpty() and empty.forest.base == 0.0
    rows = [(None, None, None, 2.0, 1), (None, 1.0, None, 4.0, None), (1.0, 1.0, 1.0, None, 2), (1.0, 1.0, None, 9.0, 2)]
    few = boosting.fit(spark.createDataFrame(rows, kind), NAMES, [2], SMALL)
    assert [tuple(r) for r in few.validation.collect()] == [(2, 9.0, 2.0)]
    assert few.forest.base == 5.0 and not few.forest.trees


def test_trees_of_two_groups_end_at_their_means(spark):
    rows = table(missing=0)
    rows["a"] = (rows["a"] > 4).astype(float)
    forest = boosting.fit(spark.createDataFrame(rows), ["a"], settings=boosting.Settings(iterations=60, step=0.5)).forest
    means = rows.groupby("a")["target"].mean()
    assert forest.score(np.array([[0.0], [1.0]])) == pytest.approx(means.to_numpy(), abs=1e-9)
