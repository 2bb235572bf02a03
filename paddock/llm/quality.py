"""Quality rules: decision lists learned by sequential covering, as Spark expressions.

Statistics of a text are built-in functions over its words and lines.  A
decision list holds ordered rules, each a conjunction of thresholds on the
statistics; the first rule that holds decides, else the default does.  Rules
are learned from labelled statistics: a rule grows by the threshold with the
best information gain until it covers no other class, is pruned from its end on
rows held back, and the rows that it covers are set aside for the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.texts import stage

#: Labelled rows learned from at most: those with the smallest hashes of doc_id.
TRAINING_ROWS = 5_000
#: Of the labelled rows, one in so many is held back for pruning.
PRUNE_EVERY = 3
MOST_RULES = 8
MOST_CONDITIONS = 3
#: Thresholds tried for each statistic, at even steps of its sorted values.
THRESHOLDS = 48
#: Rejecting rules must be right about this share of the rows held back that they cover, and cover so many.
LEAST_PRECISION = 0.9
LEAST_COVERED = 5
WINDOW = 5

#: Shares that rules test; each is a statistic over another, so long texts and short ones compare.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "n_words": ("n_words", None),
}
_SPACE = r"[\x20\x09-\x0D]+"


def _spans(places: Column, n_words: Column) -> Column:
    """Number of words within ``WINDOW`` words from any of the ascending places."""
    step = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))

    def add(state: Column, place: Column) -> Column:
        return F.struct(
            (state["sum"] + F.least(F.lit(WINDOW), place - state["last"])).alias("sum"), place.alias("last")
        )

    return F.aggregate(places, step, add, lambda s: s["sum"])


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of ``text`` to every row; a null text has none, as an empty one.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (with a word),
    ``n_dup_lines``, ``n_repeat_words``, ``n_distinct`` (words),
    ``n_upper``, ``n_marks``, ``n_digits``; columns of these names in ``docs`` give way.
    """
    given = [c for c in docs.columns if c not in STATISTICS]
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.col("_body"), _SPACE), lambda w: w != "")
    lines = F.filter(F.split(F.col("_body"), "\n"), lambda x: F.regexp_replace(x, _SPACE, "") != "")
    count = lambda pattern: (F.length("_body") - F.length(F.regexp_replace("_body", pattern, ""))).cast("long")
    base = docs.select(F.struct(*given).alias("_row"), body.alias("_body")).select("*", words.alias("_words"), lines.alias("_lines"))
    # Windows as 64-bit hashes; a text without equal ones, that is nearly every text, needs no more than this.
    windows = F.when(
        F.size("_words") >= WINDOW,
        F.transform(
            F.arrays_zip(*[F.slice(F.col("_words"), F.lit(i + 1), F.size("_words") - (WINDOW - 1)).alias(f"w{i}") for i in range(WINDOW)]),
            lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = base.withColumn("_windows", windows)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.array_sort(F.transform(F.col("_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = hashed.withColumn("_sorted", F.when(repeats, placed))
    n = F.size("_sorted")
    alike = F.zip_with(
        F.col("_sorted"),
        F.slice(F.col("_sorted"), F.lit(2), n),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(alike, lambda x: x.isNotNull()))))
    found = marked.withColumn("_places", F.when(F.col("_sorted").isNotNull(), places))
    return found.select(
        "_row.*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_body", _SPACE, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_places").isNotNull(), _spans(F.col("_places"), F.size("_words"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[^\p{L}\p{N}\s]").alias("n_marks"),
        count(r"\p{Nd}").alias("n_digits"),
    )


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks", "n_digits")


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    value = F.col(over).cast("double")
    return value if under is None else F.coalesce(value / F.nullif(F.col(under), F.lit(0)), F.lit(0.0))


def base_failed() -> Column:
    """Too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.name] > self.threshold if self.above else row[self.name] <= self.threshold

    def column(self) -> Column:
        return feature(self.name) > self.threshold if self.above else feature(self.name) <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject a text, in order; what no rule rejects is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejected(self) -> Column:
        """Number of the rejecting rule from 1, null if none holds."""
        verdict = F.lit(None).cast("int")
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.column()
            verdict = F.when(holds, F.lit(number)).otherwise(verdict)
        return verdict

    def rejects(self, row: dict[str, float]) -> bool:
        return any(all(c.holds(row) for c in rule) for rule in self.rules)


Row = tuple[dict[str, float], bool]


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gain of a condition for the rows it still covers, weighted by the rows of the class to reject."""
    if bad == 0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _thresholds(rows: list[Row], name: str) -> list[float]:
    values = sorted({r[name] for r, _ in rows})
    return sorted({values[i * (len(values) - 1) // THRESHOLDS] for i in range(THRESHOLDS)}) if values else []


def _grow(rows: list[Row]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS:
        bad = sum(b for _, b in rows)
        good = len(rows) - bad
        if not good or not bad:
            break
        best, chosen = 1e-9, None
        for name in FEATURES:
            ordered = sorted((r[name], b) for r, b in rows)
            cuts, at, below_bad = _thresholds(rows, name), 0, 0
            for t in cuts:
                while at < len(ordered) and ordered[at][0] <= t:
                    below_bad += ordered[at][1]
                    at += 1
                for above, b, g in ((False, below_bad, at - below_bad), (True, bad - below_bad, good - at + below_bad)):
                    gain = _gain(b, g, bad, good)
                    if gain > best:
                        best, chosen = gain, Condition(name, above, t)
        if chosen is None:
            break
        rule.append(chosen)
        rows = [x for x in rows if chosen.holds(x[0])]
    return rule


def _prune(rule: list[Condition], rows: list[Row]) -> tuple[list[Condition], float, int]:
    """The beginning of the rule that tells the classes apart best on rows held back; its precision and cover there."""
    best = ([], 0.0, 0)
    score = -math.inf
    for n in range(1, len(rule) + 1):
        covered = [b for r, b in rows if all(c.holds(r) for c in rule[:n])]
        bad = sum(covered)
        good = len(covered) - bad
        if covered and (bad - good) / len(covered) >= score:
            score = (bad - good) / len(covered)
            best = (rule[:n], bad / len(covered), len(covered))
    return best


def learn(labelled: DataFrame, most: int = TRAINING_ROWS) -> DecisionList:
    """A decision list from rows with the statistics, ``doc_id`` and ``quality`` (0 is rejected, 1 kept).

    Rows without quality or doc_id are left out, and so are those that fail the
    base rules, which need no learning.  At most ``most`` rows reach the driver,
    those with the smallest hashes of doc_id.  Without rows of both kinds the
    list is empty and rejects nothing.
    """
    usable = labelled.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~base_failed())
    picked = (
        usable.select("doc_id", (F.col("quality") == 0).alias("bad"), *[feature(f).alias(f) for f in FEATURES])
        .orderBy(F.xxhash64("doc_id"), "doc_id", "bad", *FEATURES)
        .limit(most)
        .collect()
    )
    rows = [({f: r[f] for f in FEATURES}, bool(r["bad"])) for r in picked]
    growing, held = [x for i, x in enumerate(rows) if i % PRUNE_EVERY], rows[::PRUNE_EVERY]
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MOST_RULES:
        rule = _grow(growing)
        if not rule:
            break
        rule, precision, covered = _prune(rule, held)
        if not rule or precision < LEAST_PRECISION or covered < LEAST_COVERED:
            break
        rules.append(tuple(rule))
        growing, held = ([x for x in part if not all(c.holds(x[0]) for c in rule)] for part in (growing, held))
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Add the statistics, ``base_failed``, ``rule`` (of the list, null if none) and ``kept`` to every row."""
    rated = with_statistics(docs.drop("base_failed", "rule", "kept"))
    return rated.withColumns({"base_failed": base_failed(), "rule": rules.rejected()}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def learn_from(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DecisionList:
    """A decision list from ``labels`` (doc_id, quality) and the documents they name.

    The labels to learn from are picked before any text is read, twice as many
    as rows learned from, as some fail the base rules.
    """
    picked = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(2 * most)
    )
    # Broadcast: two numbers for each of at most 2 * most rows.  Written: a filter on statistics that
    # aren't columns yet would be computed from the text anew, once for each mention.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return learn(stage(with_statistics(texts), "statistics"), most)


def accepted(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the list rejects, with their own columns."""
    wrapped = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    keep = ~base_failed() & rules.rejected().isNull()
    # A row, or none; a filter would move below the statistics and compute them anew, once for each mention.
    return with_statistics(wrapped, "_text").select(F.explode(F.when(keep, F.array("_row"))).alias("_row")).select("_row.*")
