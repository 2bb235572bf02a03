"""Divergence of sources against a dense loop, and the merge of sparse arrays."""

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clashing import CLASHING
from paddock.llm import audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
UNIT = 1_000_000_000


def brute(rows, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in spread if spread[t] >= 3]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if spread[t] >= 3) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + UNIT * (c[t] + 1) // (sum(c.values()) + len(kept))

        f = lambda x, y: (x - y) * (x - y) // y
        for s, c in counts.items():
            pairs = [(sum(f(p(c, t), p(counts[o], t)) for t in kept), o) for o in counts if o != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, v, rank) for rank, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("own") for c in CLASHING})
    out = audit.source_divergence(df)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, out.collect()))


def sample(seed, n=150):
    rng = random.Random(seed)
    pool = ["The", "the", "été", "日本", "a1b", "x-y", "Zoë", "q"] + ["".join(rng.choices("abcd", k=3)) for _ in range(40)]
    rows = []
    for _ in range(n):
        source = rng.choice(["web", "web", "web", "books", "wiki", "a/b", None, "é"])
        words = rng.choices(pool[:20] if source == "books" else pool, k=rng.randrange(30))
        rows.append((" ".join(words), rng.choice(["en", "en", "fr", None]), source))
    odd = [(None, "en", "silent"), ("", "fr", "silent"), ("rare words only", "xx", "one"), ("other text", "xx", "two"), (None, None, None), ("1 2 3", "yy", "lone")]
    return rows + odd + [("same row", "en", "web")] * 4 + [("big " * 5_000, "en", "wiki")] * 3


def test_equals_dense_loop(spark):
    for seed in range(2):
        rows = sample(seed)
        assert got(spark, rows) == brute(rows)


def test_small_chunks_and_blocks(spark, monkeypatch):
    rows = sample(7)
    monkeypatch.setattr(audit, "CHUNK", 5)
    monkeypatch.setattr(audit, "BLOCK", 2)
    monkeypatch.setattr(audit, "HELD", 3)
    assert got(spark, rows) == brute(rows)


def test_term_ranks_end(spark, monkeypatch):
    rows = sample(8)
    monkeypatch.setattr(audit, "TOP_TERMS", 4)
    assert got(spark, rows) == brute(rows, 4)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_probability_of_large_counts(spark):
    n, total, size = 3 * 10**13, 9 * 10**15, 123_456_789
    row = spark.range(1).select(audit._probability(F.lit(n), F.lit(total), F.lit(size))).first()
    assert row[0] == 1 + UNIT * (n + 1) // (total + size)


sparse = st.dictionaries(st.integers(1, 60), st.integers(1, UNIT), max_size=40)


@given(sparse, sparse, st.integers(1, UNIT), st.integers(1, UNIT))
def test_merge(a, b, none_a, none_b):
    arrays = [np.array(x, np.int64) for d in (a, b) for x in (sorted(d), [d[k] for k in sorted(d)])]
    either = set(a) | set(b)
    x = {t: a.get(t, none_a) for t in either}
    y = {t: b.get(t, none_b) for t in either}
    want = [sum((u[t] - v[t]) ** 2 // v[t] for t in either) for u, v in ((x, y), (y, x))]
    if max(want) < 1 << 62:
        assert audit.merged(*arrays, none_a, none_b) == (*want, len(either))
