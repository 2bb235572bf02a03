"""Near-duplicates and repeats against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paddock.llm import minhash, suffix, vectors
from paddock.llm.components import components


def joined(nodes, links):
    """Smallest node that links reach."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(201, 320)] + [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(40)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: r for n, r in joined({x for e in links for x in e}, links).items() if n != r}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def sets_of(rows, n):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(n, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    links = []
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and (rows[i][0] == rows[j][0] or 100 * both >= percent * len(sets[i] | sets[j])):
            links.append((rows[i][0], rows[j][0]))
    root = joined({r[0] for r in rows}, links)
    return sorted((r[0], len(s), root[r[0]], r[0] == root[r[0]]) for r, s in zip(rows, sets))


def near_copies(rng, words, count, edits):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(copy)


def test_near_duplicates(spark, make, odd):
    rng = random.Random(11)
    texts = [t for words, count, edits in ((200, 40, 16), (60, 30, 5), (9, 6, 1), (500, 5, 200)) for t in near_copies(rng, words, count, edits)]
    texts += ["alpha", "Alpha", "alpha beta", "ALPHA\tBETA", "beta alpha"] + ["same text again and again"] * 30
    rng.shuffle(texts)
    rows = [(100 + i, t) for i, t in enumerate(texts)] + odd + [(9, "another text of document nine")]
    for n in (2, 5):
        got = minhash.near_duplicates(make(rows), n=n).collect()
        assert sorted(map(tuple, got)) == brute(rows, n, 80)
    assert minhash.near_duplicates(make([])).collect() == []
    kept = minhash.keep_first(make(rows), n=5)
    want = {r[0] for r in brute(rows, 5, 80) if r[3]}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == make(rows).columns


def test_copies_without_doc_id(spark, make):
    """Null ids share sets with other rows, are near copies of others, and are all there is in some groups."""
    rng = random.Random(21)
    a, b, c, d = (list(near_copies(rng, 120, 4, 1)) for _ in range(4))
    rows = [(5, a[0]), (None, a[0]), (6, a[0]), (7, a[1]), (None, a[2])]
    rows += [(None, b[0]), (None, b[1]), (12, b[2])]
    rows += [(None, c[0]), (None, c[0]), (None, c[1]), (None, c[2])]
    rows += [(20, d[0]), (20, d[1]), (None, None), (None, None), (None, " ")]
    own = [(-1000 - i if r[0] is None else r[0], r[1]) for i, r in enumerate(rows)]
    # Brute force with numbers for nulls that come after all others.
    stood = {r[0]: 1000 - r[0] if r[0] < 0 else r[0] for r in own}
    root = {r[0]: r[2] for r in brute([(stood[i], t) for i, t in own], 5, 80)}
    want = Counter()
    for i, _ in own:
        top = root[stood[i]]
        want[None if i < 0 else i, None if top >= 1000 else top, top] += 1
    got = minhash.near_duplicates(make(rows)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter({k[:2]: sum(n for m, n in want.items() if m[:2] == k[:2]) for k in want})
    assert {r["doc_id"] for r in got if r["kept"] and r["doc_id"] is not None} == {5, 12, 20}
    # Of the group that has only nulls one row, and the three empty ones.
    assert sum(r["kept"] for r in got if r["doc_id"] is None) == 4


def test_one_row_of_each_group_stays(spark, make):
    """Equal rows, copies without doc_id and groups of nulls only; what stays has its whole text in the next stage."""
    rng = random.Random(22)
    a, b, c, d = (list(near_copies(rng, 120, 4, 1)) for _ in range(4))
    rows = [(5, a[0]), (5, a[0]), (None, a[0]), (6, a[1]), (None, b[0]), (12, b[1]), (None, c[0]), (None, c[0]), (None, c[1])]
    rows += [(20, d[0]), (20, "document twenty again"), (None, None), (None, None), (30, None), (30, None), (31, "")]
    docs = make(rows)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [5, 12, 20, 30, 31]
    assert sorted((r["text"] or "")[:20] for r in got if r["doc_id"] is None) in [sorted(["", "", x[:20]]) for x in c[:2]]
    left = suffix.without_repeats(kept).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted((r["doc_id"] or 0, r["text"] or "") for r in got)


def test_large_group_of_near_copies(spark, make, monkeypatch):
    """A group in which no single document is near all others, cut into many blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(2)
    rows = list(enumerate(near_copies(rng, 300, 150, 30)))
    assert sorted(map(tuple, minhash.near_duplicates(make(rows, False)).collect())) == brute(rows, 5, 80)


def test_long_documents_of_one_bucket(spark, make, monkeypatch):
    """One very long document and many shorter ones share a bucket, whose blocks hold few shingles."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    rng = random.Random(12)
    texts = [*near_copies(rng, 300, 40, 30), *near_copies(rng, 6000, 3, 600), "word " * 50_000, "word " * 50_001 + "end"]
    rows = list(enumerate(texts))
    assert sorted(map(tuple, minhash.near_duplicates(make(rows, False)).collect())) == brute(rows, 5, 80)


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for same in (0.8, 0.9, 0.97):
        n, k = 2000, int(2000 * same * 2 / (1 + same) / 1)
        pool = rng.integers(0, 1 << 63, 2 * n - k, np.uint64)
        a, b = (np.unique(x) for x in (pool[:n], pool[n - k :]))
        x, y = (np.array(minhash.signature(s)[1], np.int64) for s in (a, b))
        bits = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert bits < minhash.far_apart()


def vector_rows(rng):
    rows, base = [], rng.standard_normal((12, 16))
    for label in (0, 1, None):
        for c in base:
            rows += [(c + rng.standard_normal(16) * s, label) for s in (0, 0.02, 0.05, 0.12, 0.13, 0.2)]
    rows += [(base[0], 0)] * 5 + [(base[0] * 3, 0), (-base[0], 0), (base[0] * 1e-30, 1), (base[0] * 1e30, 1)]
    rows = [([float(np.float32(x)) for x in v], l) for v, l in rows]
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([float("inf"), *[0.0] * 15], 0), ([None, *[1.0] * 15], 0), ([1.0, 0.0], 0), ([1.0, 0.001], 0)]
    return [(i, v, l) for i, (v, l) in enumerate(rows)]


def brute_vectors(rows):
    fit = {i: np.array(v) for i, (_, v, l) in enumerate(rows) if l is not None and vectors.usable(v)}
    n, links = Counter(), []
    for i, j in combinations(fit, 2):
        a, b = fit[i], fit[j]
        if rows[i][2] == rows[j][2] and len(a) == len(b):
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                n.update((i, j))
                links.append((rows[i][0], rows[j][0]))
    root = joined({r[0] for r in rows}, links)
    return sorted((r[0], n[i], root[r[0]], r[0] == root[r[0]]) for i, r in enumerate(rows))


def test_near_vectors(spark, monkeypatch):
    rows = vector_rows(np.random.default_rng(7))
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS cid", "'x' AS keys", "2 AS root", "3 AS n", "4 AS fit", "5 AS links")
    want = brute_vectors(rows)
    assert sorted(map(tuple, vectors.near_vectors(df).collect())) == want
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert sorted(map(tuple, vectors.near_vectors(df).collect())) == want
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []


def test_vectors_without_vec_id(spark):
    """They are linked like others, but name no component that holds a vec_id, and stay."""
    east, north = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, east, 1), (4, [1.0, 0.01, 0.0], 1), (3, east, 1), (None, north, 1), (None, north, 1), (9, north, 2)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        map(str, [(None, 2, 3, True), (4, 2, 3, False), (3, 2, 3, True), (None, 1, None, True), (None, 1, None, True), (9, 0, 9, True)])
    )


@pytest.mark.parametrize("rows", [2, 5_000, 10**9])
def test_keys_of_near_and_unrelated_vectors(rows):
    """Pairs at the limit share a key at any number of rows, unrelated ones seldom: less than one in a table."""
    rng = np.random.default_rng(rows)
    a, b = (vectors._unit(rng.standard_normal((4_000, 64))) for _ in range(2))
    across = vectors._unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * across
    own, others, apart = (vectors._keys(x, 3, rows, 0.98) for x in (a, near, b))
    assert (own == others).any(axis=1).mean() > 0.999
    tables, projections = vectors.tables_for(rows)
    assert own.shape == (4_000, tables) and (own == apart).mean() <= max(1 / rows, 1e-3)
    # Vectors taken one by one get the keys they have in a batch.
    assert all((vectors._keys(a[i : i + 1], 3, rows, 0.98)[0] == own[i]).all() for i in range(0, 4_000, 400))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=40) | st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=12), st.integers(1, 9))
def test_collections_find_all_repeats(strings, length):
    counts = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    want = [(n, i) for n, s in enumerate(strings) for i in range(len(s) - length + 1) if counts[s[i : i + length]] > 1]
    assert list(zip(*(x.tolist() for x in suffix.repeated_starts(strings, length)))) == want


def brute_removal(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int)) == -1).sum())
        left = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((doc_id, len(t), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def repeating(rng):
    shared = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (30, 45, 60, 200, 19, 25)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 80)))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            low = rng.randint(0, 5)
            text += part[low : len(part) - rng.randint(0, 5)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))
        rows.append((i, text))
    return rows + [(60, rows[7][1]), (61, "ab" * 200), (62, "q" * 500)]


def test_repeats_are_removed(spark, make, odd, monkeypatch):
    rng = random.Random(4)
    rows = repeating(rng) + odd
    want = brute_removal(rows, 20)
    got = suffix.removal_report(make(rows), length=20, seed=8)
    assert sorted(map(tuple, got.collect())) == want
    # The same with collections of few pieces, and with counts for all groups.
    monkeypatch.setattr(suffix, "COLLECTION", 4)
    monkeypatch.setattr(suffix, "MOST_PIECES", 1)
    assert sorted(map(tuple, suffix.removal_report(make(rows), length=20, seed=8).collect())) == want
    assert suffix.removal_report(make([])).collect() == []


def test_long_texts_are_cut_into_spans(monkeypatch):
    data = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    whole = suffix.minimizers(data, 40, 8)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(whole[0], whole[1])])
    assert (starts == np.arange(len(data) - 39)).all()
    for a, n, p in zip(*whole[:3]):
        assert a + n - 1 <= p <= a + 32


def test_texts_without_repeats_keep_columns_and_characters(spark, make):
    rng = random.Random(9)
    rows = repeating(rng) + [(70, None), (71, "")]
    df = make(rows)
    got = suffix.without_repeats(df, length=20, seed=8)
    assert got.columns == df.columns and got.count() == len(rows)
    report = {r["doc_id"]: r for r in suffix.removal_report(df, length=20, seed=8).collect()}
    for r in got.collect():
        if r["text"] is not None:
            left = report[r["doc_id"]]["n_bytes"] - report[r["doc_id"]]["n_removed"]
            assert left <= len(r["text"].encode()) <= left + 2 * report[r["doc_id"]]["n_spans"]
            assert r["n_chars"] == len(r["text"]) and r["_pieces"] == "own _pieces"
        else:
            assert r["doc_id"] == 70


def test_only_pieces_of_recurring_minimizers_are_compared(spark, make, monkeypatch):
    """Texts that share nothing take no part after their hashes were counted."""
    rng, staged = random.Random(21), {}
    keep = suffix.stage

    def counted(df, label):
        out = keep(df, label)
        staged[label] = staged.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(suffix, "stage", counted)
    alone = [(i, "".join(rng.choice("abcdefgh") for _ in range(90))) for i in range(40)]
    part = "".join(rng.choice("ijklmnop") for _ in range(40))
    rows = alone + [(50, part + "1" * 15), (51, "2" * 15 + part), (51, "2" * 15 + part), (52, None)]
    got = suffix.removal_report(make(rows), length=20, seed=8).collect()
    assert sorted(map(tuple, got)) == brute_removal(rows, 20)
    assert 0 < staged["shared"] < staged["pieces"] / 4
