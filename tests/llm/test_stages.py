"""Every stage of the pipeline, on what the one before kept, against plain Python."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

import corpus_pipeline
from paddock.llm import mixing, quality
from test_dedup import brute
from test_text_rules import brute_statistics

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    """Some hundred documents with copies, near copies, a shared passage, nulls and repeated rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [r.asDict() for r in docs.where("doc_id < 400").collect()]
    long = [r for r in rows if len((r["text"] or "").split()) > 200][:6]
    passage = "a passage that many of the documents share, word for word, " * 4
    for k, r in enumerate(long):
        words = r["text"].split(" ")
        near = " ".join([*words[:50], "changed", *words[51:]])
        for n, text in enumerate((r["text"], near, r["text"][: len(r["text"]) // 2] + f" {k} " + passage + f" {k} end")):
            rows.append({**r, "doc_id": 10_000 + 10 * k + n, "text": text})
    rows += [{**rows[0], "doc_id": 20_000, "text": None}, {**rows[0], "doc_id": 20_001, "text": ""}, rows[5], {**rows[6], "source": None}]
    return spark.createDataFrame(rows, docs.schema)


def features_of(text):
    text = text or ""
    n_words, chars, symbols, dup_lines, repeats = brute_statistics(text)
    found = {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
        "n_lines": sum(bool(x.strip(" \t\n\v\f\r")) for x in text.split("\n")),
        "n_distinct": len({x for x in re.split(r"[\x20\x09-\x0D]+", text) if x}),
        "n_upper": len(regex.findall(r"\p{Lu}", text)),
        "n_marks": len(regex.findall(r"[^\p{L}\p{N}\x20\x09-\x0D]", text)),
        "n_digits": len(regex.findall(r"\p{Nd}", text)),
    }
    share = lambda over, under: float(found[over]) if under is None else (found[over] / found[under] if found[under] else 0.0)
    return found, {name: share(*parts) for name, parts in quality.FEATURES.items()}


def without_passages(texts, length=200):
    """Texts without the characters that lie wholly in bytes of a string of this length that starts elsewhere too."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for text, d in zip(texts, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        at, left = 0, []
        for c in text or "":
            width = len(c.encode())
            if not gone[at : at + width].all():
                left.append(c)
            at += width
        yield None if text is None else "".join(left)


def poisson(doc_id, rate):
    u = int(hashlib.md5(f"{mixing.SEED}:count:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    n, p = 0, math.exp(-rate)
    total = p
    while total <= u and n < rate + 12 * math.sqrt(rate) + 32:
        n += 1
        p *= rate / n
        total += p
    return n


def test_stages(spark, documents, tmp_path):
    held, docs = {}, documents
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        held[name] = (before.collect(), docs.collect())
    columns = ["doc_id", "text", "lang", "source"]
    plain = lambda rows: Counter(tuple(r[c] for c in columns) for r in rows)

    before, after = held["quality_rules"]
    rules = quality.learn_from(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    kept = []
    for r in before:
        found, features = features_of(r["text"])
        failed = found["n_words"] < 10 or 100 * found["n_repeat_words"] > 20 * found["n_words"]
        if not failed and not rules.rejects(features):
            kept.append(r)
    assert rules.rules and len(kept) < len(before) and plain(after) == plain(kept)

    before, after = held["near_duplicates"]
    groups = defaultdict(list)
    for doc_id, _, root, _ in brute([(r["doc_id"], r["text"]) for r in before], 5, 80):
        groups[root].append(doc_id)
    assert sorted(r["doc_id"] for r in after) == sorted(groups) and len(after) < len(before) - 6
    assert not plain(after) - plain(before)

    before, after = held["repeated_passages"]
    want = Counter((r["doc_id"], t) for r, t in zip(before, without_passages([r["text"] for r in before])))
    assert Counter((r["doc_id"], r["text"]) for r in after) == want
    assert any(r["text"] != t for (r, t) in zip(before, without_passages([r["text"] for r in before])))
    assert all(r["n_chars"] == len(r["text"] or "") for r in after)

    before, after = held["source_mix"]
    chars = Counter()
    for r in before:
        chars[r["source"]] += len(r["text"] or "")
    weights = {s: n**mixing.TEMPERATURE for s, n in chars.items()}
    rates = {s: weights[s] / sum(weights.values()) * sum(chars.values()) / n if n else 1.0 for s, n in chars.items()}
    want = Counter()
    for r in before:
        want[tuple(r[c] for c in columns)] += poisson(r["doc_id"], rates[r["source"]])
    assert plain(after) == +want and len(after) > 0

    before, after = held["token_ids"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in before:
        ids = library.encode_ordinary(r["text"] or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want[r["doc_id"], len(ids), digest(" ".join(map(str, ids)).encode()), digest((r["text"] or "").encode())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in after) == want
