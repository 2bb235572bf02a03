"""Hard negatives against brute force, and the bounds of the tree."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clashing import CLASHING
from paddock.llm import negatives

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3, least=50, most=95, scale=256):
    usable = [
        (i, [math.floor(scale * float(x)) for x in e], label)
        for i, e, label in rows
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for n, (i, e, label) in enumerate(usable):
        if i % 50:
            continue
        scored = [(sum(map(lambda a, b: a * b, e, f)), j, other == label) for m, (j, f, other) in enumerate(usable) if m != n and len(f) == len(e)]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for s, j, _ in [r for r in scored if r[2]][:positives]:
            found = [r for r in scored if not r[2] and least * s <= 100 * r[0] <= most * s][:negatives]
            out += [(i, j, rank, r[1], s, r[0]) for rank, r in enumerate(found, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 50 == 0, **options).collect()))


def vectors(n, seed, copies=0):
    """Clusters of several sizes, copies of one vector, and every odd kind of row."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(n):
        x = centres[rng.integers(6)] + rng.standard_normal(12) * rng.choice([0.05, 0.5])
        if rng.random() < copies:
            x = centres[0]
        rows.append((i, [float(v) for v in np.float32(x / np.linalg.norm(x) * rng.choice([1, 1, 3]))], int(rng.integers(4))))
    return rows


ODD = [
    (None, [0.5] * 12, 1), (1000, None, 1), (1050, [0.5] * 12, None), (1100, [], 2), (1101, [], 3), (1102, [], 2), (1150, [float("nan")] * 12, 1),
    (1200, [0.5, None] * 6, 1), (1250, [float("inf")] * 12, 2), (1300, [0.0] * 12, 0), (1350, [0.5] * 5, 1), (1351, [0.5] * 5, 1),
    (1352, [0.375] * 5, 2), (1400, [0.25] * 12, 3), (1400, [0.25] * 12, 3), (1400, [0.25] * 12, 2), (-50, [-0.5] * 12, 0),
]


@pytest.mark.parametrize("seed, copies", [(1, 0.0), (2, 0.4)])
def test_equals_brute_force(spark, seed, copies):
    rows = vectors(600, seed, copies) + ODD
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("own") for c in CLASHING if c not in ("id",)})
    want = brute(rows)
    assert want and mined(df) == want


def test_small_blocks_and_slices(spark, monkeypatch):
    """Leaves over several blocks and anchors over several slices give the same rows."""
    rows = vectors(400, 3, 0.5)
    monkeypatch.setattr(negatives, "BLOCK", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    assert mined(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_other_parameters(spark):
    rows = vectors(300, 4)
    assert mined(spark.createDataFrame(rows, KIND), positives=2, negatives=4, least=20, most=101, scale=64) == brute(rows, 2, 4, 20, 101, 64)


def test_large_components(spark):
    """Sums beyond 2^53 stay exact."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(2e5, 3e5) for _ in range(8)], i % 2) for i in range(120)]
    rows = [(i, [float(np.float32(x)) for x in e], label) for i, e, label in rows]
    assert mined(spark.createDataFrame(rows, KIND), scale=1024) == brute(rows, scale=1024)


def test_empty_and_unusable_tables(spark):
    assert mined(spark.createDataFrame([], KIND)) == []
    assert mined(spark.createDataFrame([(50, None, 1), (None, [1.0], 1)], KIND)) == []
    assert mined(spark.createDataFrame([(50, [1.0], 1)], KIND)) == []


def test_tree_drops_no_row_of_a_window(spark):
    """What the tree leaves out holds nothing of the window, and it does leave out something."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-200, 200, (20, 16))
    rows = centres[rng.integers(20, size=3000)] + rng.integers(-9, 10, (3000, 16))
    longest = int((rows**2).sum(axis=1).max()) + 1
    tree = negatives.grow(rows[:500], longest)
    seen: dict = {}
    leaf = tree.place(rows, seen)
    tree.low = [np.full((len(s), len(s)), np.inf) for s in tree.splits]
    tree.high = [np.full((len(s), len(s)), -np.inf) for s in tree.splits]
    for (node, child), (lo, hi) in seen.items():
        tree.low[node][:, child], tree.high[node][:, child] = lo, hi
    anchors = rows[:40]
    scores = anchors @ rows.T
    dropped = 0
    for share in (0.5, 0.8, 0.95):
        top = scores.max(axis=1) * share
        alive = tree.remaining(anchors, np.arange(40), top, scores.max(axis=1).astype(float))
        for a in range(40):
            inside = (scores[a] >= top[a]) & (scores[a] <= scores[a].max())
            assert alive[a][leaf[inside]].all()
        dropped += (~alive).sum()
    assert dropped > 40 * tree.leaves
