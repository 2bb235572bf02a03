"""Language identification, HTML extraction, quality rules and mixing."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
import public_tokenizers as P

from paddock.llm import html, langid, mixing, quality

PIECES = P.path("piece_bpe_32k.model")


# --- language identification


def small_model():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab"]
    table = np.random.default_rng(0).random((len(pieces), 2)) / 10
    return langid.Model(["x", "y"], pieces, table)


def all_cuts(word, model):
    marked = langid.WORD_START + word
    n = len(marked)
    for breaks in product((0, 1), repeat=n - 1):
        places = [0, *[i + 1 for i, b in enumerate(breaks) if b], n]
        parts = [marked[a:b] for a, b in zip(places, places[1:])]
        rows = [model.index.get(p, len(model.index) if len(p) == 1 else None) for p in parts]
        if None not in rows:
            yield rows


def test_forward_sums_all_segmentations():
    model = small_model()
    for word in ("a", "abab", "cab", "babcba", "zz"):
        want = [sum(math.prod(model.table[r, lang] for r in rows) for rows in all_cuts(word, model)) for lang in (0, 1)]
        assert np.allclose(langid.forward([word], model)[0], np.log(want))
        uses = langid.expected_uses([word], np.array([1]), np.array([3.0]), model)
        expected = np.zeros_like(model.table)
        for rows in all_cuts(word, model):
            p = math.prod(model.table[r, 1] for r in rows) / want[1]
            for r in rows:
                expected[r, 1] += 3 * p
        assert np.allclose(uses, expected)


def test_languages(spark, make, odd):
    rng = random.Random(1)
    vocab = {"en": "the of and with house river".split(), "de": "der und nicht straße haus fluß".split(), "xx": "ка на река дом тот".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(3, 30))), lang) for i, lang in enumerate(list(vocab) * 40)]
    docs = make(rows + [(1000, "the", None), (None, "x", "en")])
    model = langid.learn(docs, PIECES)
    assert model.langs == ["de", "en", "xx"]
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and got[1000]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    strange = langid.predict(make(odd), model).collect()
    assert len(strange) == len(odd)
    assert {r["doc_id"] for r in strange if r["lang_pred"] == "und"} == {1, 2, 3}
    nothing = langid.learn(make([]), PIECES)
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(make([]), model).collect() == []
    few = langid.sampled(docs, 10)
    assert few.count() == 10 and sorted(map(tuple, few.collect())) == sorted(map(tuple, langid.sampled(docs.repartition(7), 10).collect()))


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{content:"</p>"}</style><script>var a="<p>no</p>";</script></head>
<body class="article-page"><header><h2>Site</h2></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies a lot on this site</div><!-- <p>hidden</p> --><div class="ad">Buy these good things now please</div>
<form><label>Mail</label><input name="x"><button>Send</button></form>
<article><header><h1>The  title</h1></header><p>First&nbsp;<b>bo</b>ld &lt;part&gt;<br>and more &eacute;t&#233; 3 < 4<p>Second one, <a title="a > b" href='c'>linked</a>.
<aside>Related: this</aside><p>Third
 <div id="comments"><p>A reader says no</p><div class="content"><p>and another says yes</p></div></div></article>
<aside class="sidebar"><p>A long text in the side bar of the page with many words in it that nobody wants to read at all</p></aside>
<footer>&copy; us</footer></body></html>"""


def test_main_text():
    text = html.main_text(PAGE, html.train())
    assert text == "The title First bold <part> and more été 3 < 4 Second one, linked. Third"


def test_pages_without_marks():
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    page = f'<div><a href="/">Home</a></div><div><a href="/x">All of it</a></div><p>{words(80)}</p><p>{words(60)}</p><p>{words(70)}</p><div><a href="#">Up</a></div>'
    assert html.main_text(page, html.train()) == " ".join((words(80), words(60), words(70)))


def test_elements_that_end_early_or_never():
    tree = html.train()
    for odd in ("<svg/>", "<svg class=i/>", "<svg class='i' />", "<video-player></video-player>", "<button-bar>", "<title-x>", "<svg>", "<canvas>", "<math/>"):
        assert html.main_text(f"<article><p>one</p>{odd}<p>two</p><p>three</p></article>", tree) == "one two three"
    page = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds<svg><text>no</text></svg> <video>no</video>here</p><script>no"
    assert html.main_text(page, tree) == "so x=2 holds here"
    for piece in ("<svg>", "<video>", "<button>", "<svg/>"):
        html.main_text(piece * 50_000, tree)


def test_names_that_only_mention_a_side():
    tree = html.train()
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    text = f"<p>{words(80)}</p><p>{words(60)}</p>"
    for name in ("layout has-sidebar", "post comments-open", "no-sidebar", "post category-social", "page header-fixed"):
        assert html.main_text(f'<div class="{name}">{text}</div>', tree) == f"{words(80)} {words(60)}"
    assert html.main_text(f'<div class="post"><div class="entry-header"><h1>The title</h1></div>{text}</div>', tree).startswith("The title w0")
    for name in ("sidebar", "left-sidebar", "sidebar-left", "comments-area", "cookie-notice", "main-nav", "site-header", "post-comments", "widget_area"):
        assert html.main_text(f'<div class="{name}">{text}</div>', tree) == ""


def test_tree_learns_the_table():
    tree = html.train()
    assert all(tree.decide(x) == y for x, y in html.LABELLED)
    rng = random.Random(0)
    for _ in range(5000):
        x = (rng.randint(0, 300), rng.random(), rng.randint(0, 300), rng.random(), rng.randint(0, 300), rng.random())
        assert tree.decide((*x, 1)) and not tree.decide((*x, -1))
    assert not html.train([]).decide((1, 0, 1, 0, 1, 0, 1))


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain"), (5, "u", "<p" * 5000), (6, "u", "<div " + "\"'" * 5000), (7, "u", "</div>" * 3000 + "<article>x &amp"), (7, "u", "</div>" * 3000 + "<article>x &amp")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect())
    assert got[0][2] == len(got[0][1]) > 50
    assert got[1:3] == [(2, "", 0), (3, "", 0)] and got[-2:] == [(7, "x &", 3)] * 2
    assert html.extract(df.where("false")).collect() == []


def test_long_broken_pages_take_linear_time():
    tree = html.train()
    for piece in ("<", "<a ", '<a b="', "<!--", "<script>", "&", "<p>x", "<a href='"):
        html.main_text(piece * 50_000, tree)


# --- quality


def brute_statistics(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, make, odd):
    rng = random.Random(2)
    rows = odd + [(100 + i, rng.choice(["\n", " "]).join(rng.choice(["a", "b b", "a\tb", "#x", "É<"]) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    got = quality.with_statistics(make(rows))
    assert "own _body" in got.first().asDict().values()
    found = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got.collect())
    assert found == sorted((i, *brute_statistics(t)) for i, t in rows)
    assert quality.with_statistics(make([])).collect() == []


def test_decision_list(spark, make, odd):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    kinds = {
        "good": lambda: " ".join(word() for _ in range(60)),
        "symbols": lambda: " ".join(word() + rng.choice("#$%*") * 3 for _ in range(60)),
        "table": lambda: " | ".join(word() for _ in range(60)),
        "shout": lambda: " ".join(word().upper() + "!!" for _ in range(60)),
    }
    names = ["good"] * 6 + ["symbols", "table", "shout"]
    rows = [(i, kinds[rng.choice(names)](), None) for i in range(1000, 1500)]
    kind_of = {i: "good" if not re.search(r"[#$%*|!]", t) else "bad" for i, t, _ in rows}
    docs = make(rows + odd)
    labels = spark.createDataFrame([(i, int(k == "good"), 0) for i, k in kind_of.items()] + [(None, 1, 0), (1, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn_from(docs, labels)
    assert 1 <= len(rules.rules) <= quality.MOST_RULES
    judged = {r["doc_id"]: r for r in quality.judge(docs, rules).collect()}
    for i, k in kind_of.items():
        assert judged[i]["kept"] == (k == "good" and not judged[i]["base_failed"])
    for i in (1, 2, 3, 4, 9):
        assert judged[i]["base_failed"] and not judged[i]["kept"]
    kept = quality.accepted(docs, rules)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in judged.items() if r["kept"])
    nothing = quality.learn_from(docs, labels.where("false"))
    assert nothing.rules == () and quality.judge(docs, nothing).where("rule IS NOT NULL").count() == 0
    # The rules as Spark conditions and in Python agree.
    features = quality.with_statistics(docs).select(*[quality.feature(f).alias(f) for f in quality.FEATURES], rules.rejected().alias("rule")).collect()
    assert all(rules.rejects(r.asDict()) == (r["rule"] is not None) for r in features)


# --- mixing


def test_counts_are_poisson_quantiles(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(rng.choice([0.0, 0.1, 0.7, 1.0, 3.5, 40.0, 400.0]), rng.random()) for _ in range(400)] + [(1.0, 0.0), (5.0, 1 - 2**-52)]
    got = spark.createDataFrame(rows, "rate double, u double").select("rate", "u", mixing.copies(F.col("rate"), F.col("u")).alias("n")).collect()
    for r in got:
        p = cdf = math.exp(-r["rate"])
        k = 0
        while cdf <= r["u"] and k < 2000:
            k += 1
            p *= r["rate"] / k
            cdf += p
        assert r["n"] == min(k, math.ceil(r["rate"] + 12 * math.sqrt(r["rate"]) + 32))


def test_mix(spark, make):
    rows = [(i, "x" * (10 + i % 7), "en", None if i % 5 == 0 else f"s{i % 5}") for i in range(4000)] + [(9000, None, None, "empty"), (9001, "", None, "empty")]
    docs = make(rows)
    out = mixing.mix(docs)
    got = out.collect()
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy", "shuffle_key"]
    chars = Counter()
    for r in got:
        chars[r["source"]] += len(r["text"] or "")
    shares = {s: n / sum(chars.values()) for s, n in chars.items() if s != "empty"}
    assert all(abs(x - 0.2) < 0.03 for x in shares.values())
    again = mixing.mix(docs.repartition(9))
    assert sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in got) == sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in again.collect())
    for r in got[:50]:
        key = int(hashlib.md5(f"{mixing.SEED}:place:{r['doc_id']}:{r['copy']}".encode()).hexdigest()[:13], 16)
        assert r["shuffle_key"] == key and r["_gone"] == "own _gone" and r["rate"] == "own rate"
    weights = spark.createDataFrame([("s1", 3.0), ("s2", 1.0), ("gone", 5.0)], "source string, weight double")
    named = Counter(r["source"] for r in mixing.mix(docs, weights).collect())
    assert set(named) <= {"s1", "s2"} and 2.4 < named["s1"] / named["s2"] < 3.7
    assert mixing.mix(make([])).collect() == []
    with pytest.raises(Exception, match="500 copies"):
        mixing.mix(make([(1, "x", None, "a"), (2, "x" * 3000, None, "b")]), weights.selectExpr("'a' AS source", "1.0 AS weight").limit(1)).collect()


def test_mix_of_a_tiny_source(spark, make, tmp_path):
    """One character against millions: a rate in the thousands, in the query and in the pipeline's stage."""
    import corpus_pipeline
    from paddock.llm.queries import QUERIES

    rows = [(1, "x", None, "tiny"), (2, "y", None, None)] + [(10 + i, "x" * 300_000, None, f"s{i % 3}") for i in range(60)]
    docs = make(rows, False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rate = {r["source"]: r["rate"] for r in mixing.source_rates(docs, most_copies=None).collect()}
    assert rate["tiny"] == rate[None] > 2 * mixing.MOST_COPIES
    for out in (QUERIES["op4_mixing"](spark, str(tmp_path)), corpus_pipeline.source_mix(spark, docs, str(tmp_path))):
        n = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        assert all(abs(n[i] - rate["tiny"]) < 6 * math.sqrt(rate["tiny"]) for i in (1, 2)) and n[1] != n[2]


def test_mix_of_rows_without_doc_id(spark, make):
    """They are drawn and placed one by one, not all together."""
    rows = [(None, f"text {i:04d}", None, "big") for i in range(1000)] + [(i, f"x{i:08d}", None, "small") for i in range(100)]
    docs = make(rows)
    rate = {r["source"]: r["rate"] for r in mixing.source_rates(docs).collect()}["big"]
    got = [r for r in mixing.mix(docs).collect() if r["source"] == "big"]
    assert abs(len(got) - 1000 * rate) < 6 * math.sqrt(1000 * rate)
    assert len({r["shuffle_key"] for r in got}) == len(got)


def test_counts_of_large_means(spark):
    """Mean and variance of a Poisson variable, below and above the mean that one draw serves."""
    from pyspark.sql import functions as F

    for rate in (499.0, 501.0, 5000.0):
        uniform = lambda part: mixing.hashed("id", *([] if part is None else [part.cast("string")])) / F.lit(2.0**52)
        n = [r[0] for r in spark.range(2000).withColumn("id", F.col("id").cast("string")).select(mixing.draws(F.lit(rate), uniform)).collect()]
        assert abs(np.mean(n) - rate) < 5 * math.sqrt(rate / 2000) and 0.8 * rate < np.var(n) < 1.2 * rate


ASIDE = (
    "related-posts related-articles recommended-stories popular-posts social-share-buttons share-buttons sponsored-content advert-text promo-card "
    "adsbygoogle comment-body comment-text comment-thread comments__body reply-thread cookie_policy breadcrumb-trail tag-list left-sidebar"
).split()


@pytest.mark.parametrize("name", ASIDE)
def test_parts_inside_an_article_that_are_aside(name):
    page = f"<article><p>one</p><div class='{name}'><p>not this</p><ul><li>nor <a href=x>that</a></li></ul></div><p>two</p></article>"
    assert html.main_text(page, html.train()) == "one two"


def test_pages_of_a_sentence():
    tree = html.train()
    assert html.main_text("<p>Just one sentence here.</p>", tree) == "Just one sentence here."
    text = " ".join(["word"] * 15)
    assert html.main_text(f"<h1>A short title</h1><p>{text}</p>", tree) == f"A short title {text}"
    assert html.main_text("<p><a href=x>only links</a></p>", tree) == ""
