"""Research catalogue: papers, notebooks and projects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.scalars import first_filled, normalise, title_of
from paddock.operators.ordering import carry_forward


def _in_sport(items: DataFrame, sport: str | None) -> DataFrame:
    return items if not sport else items.where(normalise(F.col("sport")) == normalise(F.lit(sport)))


def _matching(items: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    wanted = normalise(F.lit(query))
    return items.where(reduce(or_, [normalise(F.col(f)).contains(wanted) for f in fields]))


def keyword_search(items: DataFrame, query: str, fields: Sequence[str], sport: str | None = None) -> DataFrame:
    """Items with the query anywhere in one of the fields, case and underscores ignored."""
    return _matching(_in_sport(items, sport), query, fields)


def search_scopes(
    projects: DataFrame, papers: DataFrame, query: str, scope: str = "all", sport: str | None = None
) -> DataFrame:
    """Matches among projects and papers as (scope, sport, title)."""
    parts = []
    if scope in ("projects", "all"):
        hits = keyword_search(projects, query, ["name"], sport)
        parts.append(hits.select(F.lit("projects").alias("scope"), "sport", F.col("name").alias("title")))
    if scope in ("papers", "all"):
        hits = keyword_search(papers, query, ["title", "file"], sport)
        parts.append(hits.select(F.lit("papers").alias("scope"), "sport", "title"))
    return reduce(DataFrame.unionByName, parts)


def resolve_unique(items: DataFrame, query: str, fields: Sequence[str], sport: str | None = None) -> DataFrame:
    """The only item that contains the query; empty if there is none or more than one."""
    hits = _matching(_in_sport(items, sport), query, fields)
    one = hits.agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*items.columns)).alias("_item"))
    return one.where("_n = 1").select("_item.*")


def resolve_exact(items: DataFrame, name: str, sport: str, order: str) -> DataFrame:
    """The first item whose normalised name and sport equal the given ones."""
    same = normalise(F.col("name")) == normalise(F.lit(name))
    return _in_sport(items, sport).where(same).orderBy(order).limit(1)


def resolve_nth(items: DataFrame, n: int, order: Sequence[str], sport: str | None = None) -> DataFrame:
    """The n-th item of the ordered list, counted from 1; empty outside the list."""
    listed = _in_sport(items, sport)
    return listed.orderBy(*order).offset(n - 1).limit(1) if n >= 1 else listed.limit(0)


def parse_index(lines: DataFrame) -> DataFrame:
    """Paper index lines (doc, line, text) to one row per file: title, sport, source.

    Section headers and titles hold for the lines below them; a title ends the
    file of the title before it.
    """
    text = F.trim("text")
    bold = text.startswith("**") & text.endswith("**") & (F.regexp_count(text, F.lit(r"\*\*")) >= 2)
    label = F.trim(F.translate(text, "*", ""))
    is_file, is_source = text.startswith("- File:"), text.startswith("- Source:")
    is_title = text.startswith("- ") & ~is_file & ~is_source & ~bold
    after_colon = F.trim(F.regexp_extract(text, r"^[^:]*:(.*)$", 1))
    quoted = F.trim(F.regexp_extract(text, r"`([^`]*)`?", 1))
    name = F.regexp_extract(F.when(text.contains("`"), quoted).otherwise(after_colon), r"([^/]*)/*$", 1)
    marked = lines.where(text != "").select(
        "doc",
        "line",
        F.when(bold & (F.lower(label) != "research papers"), label).alias("sport"),
        F.when(is_title, F.trim(F.substring(text, 3, 1_000_000))).alias("title"),
        F.when(is_title, F.lit("")).when(is_file, name).alias("file"),
        F.when(is_source, after_colon).alias("source"),
        is_file.alias("is_file"),
    )
    filled = carry_forward(marked, ["doc"], "line", ["sport", "title", "file"])
    named = filled.where("file <> ''")

    def last(col: str, when):
        return F.max_by(col, F.when(when & F.col(col).isNotNull(), F.col("line"))).alias(col)

    return named.groupBy("doc", "file").agg(
        last("title", F.col("is_file")), last("sport", F.col("is_file")), last("source", F.lit(True))
    )


def enrich_papers(papers: DataFrame, index: DataFrame) -> DataFrame:
    """Papers (sport, path) with title, sport and source from the index where it knows the file."""
    keyed = papers.withColumn("file", F.regexp_extract("path", r"([^/]*)$", 1))
    known = index.select("file", F.col("title").alias("_title"), F.col("sport").alias("_sport"), "source")
    return keyed.join(known, "file", "left").select(
        F.coalesce("_sport", "sport").alias("sport"),
        first_filled(F.col("_title"), title_of(F.col("file"))).alias("title"),
        F.col("path").alias("file"),
        "source",
    )


def overview_counts(projects: DataFrame, papers: DataFrame) -> DataFrame:
    """Projects, notebooks, code folders and papers per sport, zeros filled."""
    by_project = projects.groupBy("sport").agg(
        F.count(F.lit(1)).alias("projects"),
        F.count("notebook").alias("notebooks"),
        F.count("python_dir").alias("python"),
    )
    by_paper = papers.groupBy("sport").agg(F.count(F.lit(1)).alias("papers"))
    return by_project.join(by_paper, "sport", "full").fillna(0, subset=["projects", "notebooks", "python", "papers"])
