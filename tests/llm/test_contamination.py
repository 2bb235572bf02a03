"""Benchmark windows in documents, against a plain search."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from paddock.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        ws = words(text)
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            windows.setdefault(tuple(ws[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        ws, hit, named = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(ws) - size + 1):
                if found := windows.get(tuple(ws[i : i + size])):
                    hit.update(range(i, i + size))
                    named |= found
        ids = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(named), ids, bool(hit)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("n_words", "spans", "_text", "items")})
    return d, spark.createDataFrame(items, "item_id long, text string")


def sample(seed, n_docs=60):
    rng = random.Random(seed)
    pool = [rng.choice("ab") + rng.choice("cdE") for _ in range(6)] + ["naïve", "日本", "x9"]

    def text(n):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", "_\n", " — "[:2]]) for _ in range(n))

    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(25)] + [(3, text(12)), (90, None), (91, ""), (92, " ,;"), (None, text(14))]
    docs = [(i, text(rng.randrange(60))) for i in range(n_docs)]
    for i in range(0, n_docs, 3):
        item = rng.choice(items[:25])[1]
        docs[i] = (i, docs[i][1] + item.upper().replace(" ", "  ") + docs[i][1])
    return docs + [(500, None), (501, ""), (None, docs[0][1]), (7, docs[7][1]), (7, docs[7][1]), (502, "zz " * 20_000 + items[5][1] + " zz" * 9)], items


def test_equals_plain_search(spark):
    for seed in range(3):
        docs, items = sample(seed)
        got = contamination.report(*tables(spark, docs, items)).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_many_parts_give_the_same(spark, monkeypatch):
    docs, items = sample(9, 20)
    monkeypatch.setattr(contamination, "PART_BYTES", 150)
    got = contamination.report(*tables(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all windows, verification alone decides."""
    monkeypatch.setattr(contamination, "_hashes", lambda values, size: values[: len(values) - size + 1] * 0)
    table = contamination.WindowTable([("1", "a b c"), ("2", "b c d"), ("3", "c d")], window=3)
    counts, spans, items = table.scan(["a b c d", "x b c d", "c d", "d c", None], [[]] * 5, [[]] * 5)
    assert counts == [4, 4, 2, 2, 0]
    assert items == [["1", "2", "3"], ["2", "3"], ["3"], [], []]
    assert spans == [[{"start": 0, "end": 4}], [{"start": 1, "end": 4}], [{"start": 0, "end": 2}], [], []]


def test_spans_and_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"Before: {item.upper()}! After é."), (2, "clean text"), (3, None), (4, item), (5, f"{item} mid {item}"), (6, "")]
    d, items = tables(spark, docs, [(1, item)])
    kept = {r["doc_id"]: r["text"] for r in contamination.without_contamination(d, items).collect()}
    assert kept == {1: "Before: ! After é.", 2: "clean text", 3: None, 4: "", 5: " mid ", 6: ""}
    clean = contamination.without_contaminated(d, items)
    assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 6]


def test_empty_tables(spark):
    d, items = tables(spark, [(1, "a b")], [])
    assert [tuple(r)[:4] for r in contamination.report(d, items).collect()] == [(1, 2, 0, 0)]
    d, items = tables(spark, [], [(1, "a b")])
    assert contamination.report(d, items).collect() == []
