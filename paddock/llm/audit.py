"""How the sources of a language differ in their words, as exact divergences.

Counts of kept terms are sparse arrays per group (language and source), sorted
by term id and cut into chunks of bounded size.  For every unordered pair of
groups of a language a task merges two arrays of one chunk: it looks up the
shorter one's ids in the longer one, prices terms that both have, terms of one
side only, and counts the union; what neither has is priced once for all
chunks.  Both directions come from the same merge.  Groups meet in blocks, so
an array is copied once per block of partners instead of once per partner.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.texts import small_batches, stage
from paddock.operators.ordering import first_places

#: Documents of a language that a kept term is in.
LEAST_DOCS = 3
#: Ranks of the terms that are returned.
TOP_TERMS = 200
#: Probabilities are whole numbers of this part.
UNIT = 1_000_000_000
#: Terms in a chunk, groups in a block, and counters that a task holds before it hands them on.
CHUNK, BLOCK, HELD = 32_768, 32, 500_000

_SPACE = 0x20
_LOWER = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
_TABLE = bytes([b if 0x61 <= b <= 0x7A or b >= 0x80 else _SPACE for b in _LOWER])


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (A-Z lower-cased) and of anything beyond ASCII, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in a group, counted in the tasks first.

    Each group also has a row with a null term, so that groups without terms are known.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                found = [None, *n]
                size = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int64))),
                        pa.array([source], pa.string()).take(pa.array(np.zeros(size, np.int64))),
                        pa.array(found, pa.binary()).cast(pa.string()),
                        pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *[docs[t] for t in n]], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in batches:
            for text, lang, source in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from drain()
        yield from drain()

    named = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    parts = named.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _probability(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + size)), exact at any count."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + size).cast("decimal(20,0)")).cast("long") + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def price(p: np.ndarray | int, q: np.ndarray | int) -> np.ndarray | int:
    """floor((p - q)^2 / q) in whole numbers."""
    return (p - q) * (p - q) // q


def merged(ids_a: np.ndarray, p_a: np.ndarray, ids_b: np.ndarray, p_b: np.ndarray, none_a: int, none_b: int) -> tuple[int, int, int]:
    """Two sorted sparse arrays: divergence of a from b and of b from a over the terms of either, and their number.

    ``none_a`` and ``none_b`` are the probabilities of terms that a side lacks.
    """
    short, long = (ids_a, ids_b) if len(ids_a) <= len(ids_b) else (ids_b, ids_a)
    # The shorter one's ids jump into the part of the longer one that they span.
    low, high = np.searchsorted(long, [short[0], short[-1] + 1]) if len(short) else (0, 0)
    at = low + np.searchsorted(long[low:high], short)
    both = at < high
    both[both] = long[at[both]] == short[both]
    in_short, in_long = np.flatnonzero(both), at[both]
    in_a, in_b = (in_short, in_long) if short is ids_a else (in_long, in_short)
    only_a, only_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    only_a[in_a] = only_b[in_b] = False
    a, b, x, y = p_a[in_a], p_b[in_b], p_a[only_a], p_b[only_b]
    ab = price(a, b).sum() + price(x, none_b).sum() + price(none_a, y).sum()
    ba = price(b, a).sum() + price(none_b, x).sum() + price(y, none_a).sum()
    return int(ab), int(ba), len(ids_a) + len(ids_b) - len(in_a)


def _pair_sums(arrays: DataFrame) -> DataFrame:
    """From (lang, chunk, i, j, g, none, ids, ps): (lang, a, b, ab, ba, either) for each pair of a chunk.

    A task holds the arrays of two blocks of groups in one chunk.
    """

    def pairs(lang: str, same: bool, rows: list[tuple]) -> Iterator[tuple]:
        left = rows if same else [r for r in rows if r[0] // BLOCK == rows[0][0] // BLOCK]
        right = rows if same else rows[len(left) :]
        for ga, none_a, ids_a, p_a in left:
            for gb, none_b, ids_b, p_b in right:
                if ga < gb and (len(ids_a) or len(ids_b)):
                    yield lang, ga, gb, *merged(ids_a, p_a, ids_b, p_b, none_a, none_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def out():
            if len(rows) > 1 and (found := list(pairs(group[0], group[2] == group[3], rows))):
                kinds = [pa.string()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["lang", "a", "b", "ab", "ba", "either"])

        for batch in batches:
            ids, ps = (batch.column(c).flatten().to_numpy() for c in (6, 7))
            ends = np.cumsum(pc.list_value_length(batch.column(6)).to_numpy()).tolist()
            for lang, chunk, i, j, g, none, low, high in zip(*[batch.column(c).to_pylist() for c in range(6)], [0, *ends], ends):
                if (lang, chunk, i, j) != group:
                    yield from out()
                    group, rows = (lang, chunk, i, j), []
                rows.append((g, none, ids[low:high], ps[low:high]))
        yield from out()

    by = ["lang", "chunk", "i", "j"]
    ordered = arrays.select(*by, "g", "none", "ids", "ps").repartition(*by).sortWithinPartitions(*by, "g")
    return ordered.mapInArrow(run, "lang string, a long, b long, ab long, ba long, either long")


def source_divergence(docs: DataFrame) -> DataFrame:
    """Divergence of every group (lang, source) of ``docs`` (text, lang, source) from its language's other sources and terms.

    A language keeps the terms that at least ``LEAST_DOCS`` of its documents
    hold.  A kept term's probability in a group, or in the language, is
    ``1 + floor(UNIT * (count + 1) / (N + V))``, N being the sum of counts and
    V the number of kept terms; the divergence of p from q is
    ``floor((p - q)^2 / q)``.  Part ``pair``: the sum over all kept terms
    against each other source of the language, 0 without kept terms.  Part
    ``term``: each kept term that the group holds and that is more probable
    there than in the language, the first ``TOP_TERMS``.  Ranks go by value
    downwards, then by item.

    Null text, lang and source count as empty; rows repeated are documents of
    their own; an empty table gives no rows; other columns are not read.
    """
    counts = stage(term_counts(docs), "counts")
    said = counts.where("term IS NOT NULL")
    kept = said.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = stage(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("n_lang").alias("total_lang"))
    most = langs.agg(F.max("size")).first()[0] or 0
    chunks = max(1, -(-most // CHUNK))
    chunk = F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")
    numbered = kept.withColumn("chunk", chunk).withColumn("id", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    sparse = stage(said.drop("docs").join(numbered, ["lang", "term"]), "sparse")

    totals = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    nothing = F.lit(0).cast("long")
    # One row a group; the pairs of a language's groups are the result.
    groups = (
        counts.where("term IS NULL")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, nothing).alias(c) for c in ("total", "size", "total_lang")])
        .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
        .withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("lang")))
        .withColumn("none", F.when(F.col("size") > 0, _probability(nothing, F.col("total"), F.col("size"))).otherwise(F.lit(1).cast("long")))
    )
    groups = stage(groups, "groups")

    priced = sparse.join(groups, ["lang", "source"]).withColumn("p", _probability(F.col("n"), F.col("total"), F.col("size")))
    arrays = priced.groupBy("lang", "chunk", "g").agg(F.array_sort(F.collect_list(F.struct("id", "p"))).alias("entries"))  # at most a chunk
    block, blocks = F.floor(F.col("g") / BLOCK), F.ceil(F.col("groups") / BLOCK)
    none = F.array().cast("array<struct<id: int, p: long>>")
    spread = (
        groups.where("size > 0 AND groups > 1")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .join(arrays, ["lang", "chunk", "g"], "left")
        .withColumn("entries", F.coalesce("entries", none))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select(
            "lang", "chunk", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "g", "none",
            F.col("entries.id").cast("array<long>").alias("ids"), F.col("entries.p").alias("ps"),
        )
    )
    sums = _pair_sums(spread).groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("ab", "ba", "either")])

    side = groups.select("lang", "g", "source", "none", "size")
    a, b = (side.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("g", "source", "none", "size")]) for s in "ab")
    pairs = a.join(b, "lang").where("g_a < g_b").join(sums.withColumnsRenamed({"a": "g_a", "b": "g_b"}), ["lang", "g_a", "g_b"], "left")
    rest = F.col("size_a") - F.coalesce("either", nothing)

    def way(x: str, y: str, shared: str) -> Column:
        value = F.coalesce(shared, nothing) + rest * _divergence(F.col(f"none_{x}"), F.col(f"none_{y}"))
        return F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"), value.alias("value"))

    pairs = pairs.select("lang", F.inline(F.array(way("a", "b", "ab"), way("b", "a", "ba"))))
    order = [F.col("value").desc(), F.col("item")]
    by = ["lang", "source"]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    q = _probability(F.col("n_lang"), F.col("total_lang"), F.col("size"))
    found = priced.withColumn("q", q).where("p > q").select(*by, F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    found = first_places(found, by, order, TOP_TERMS, "rank")
    return pairs.withColumn("part", F.lit("pair")).unionByName(found.withColumn("part", F.lit("term"))).select(
        *by, "part", "item", "value", F.col("rank").cast("int").alias("rank")
    )
