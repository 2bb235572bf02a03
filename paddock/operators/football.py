"""Form, home advantage, strength, odds and scorelines of teams."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.ordering import attach, first_places, in_ranges
from paddock.session import cut_lineage

# Points of a win and a draw, matches that make up the form, goals a side in a scoreline grid.
WIN, DRAW = 3, 1
FORM = 5
MOST_GOALS = 10
#: Steps of the search for an exponent: each halves the range from 0 to ``WIDEST``.
HALVINGS, WIDEST = 60, 64.0


def played(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())


def team_matches(matches: DataFrame) -> DataFrame:
    """Each played match once for either team: league, team_id, opponent_id, at_home, goals_for, goals_against, points."""

    def side(own: str, other: str) -> Column:
        goals, against = F.col(f"{own}_goals"), F.col(f"{other}_goals")
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.lit(own == "home").alias("at_home"),
            goals.alias("goals_for"),
            against.alias("goals_against"),
            F.when(goals > against, WIN).when(goals == against, DRAW).otherwise(0).alias("points"),
        )

    return played(matches).select("match_id", "date", "season", "league", F.inline(F.array(side("home", "away"), side("away", "home"))))


def before_each(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], k: int, found: dict[str, Callable[[Column], Column]], over: Sequence[str]
) -> DataFrame:
    """Aggregates over the ``k`` rows of the same group before each row, in the order of ``order`` (which has no ties).

    ``found`` maps new columns to functions of an array of structs of the columns
    ``over``, oldest first.  Rows are dealt out in ranges of (group, order); a
    range also gets the last ``k`` rows of its group before it, so that a group
    of any size is spread over as many tasks as it has ranges.
    """
    placed = in_ranges(rows, *group, *order)
    down = [F.col(c).desc_nulls_last() for c in order]
    key = F.struct(*order, *over)
    tails = (
        first_places(placed, [*group, "_range"], down, k, "_place")
        .groupBy(*group, "_range")
        .agg(F.array_sort(F.collect_list(key)).alias("_tail"))  # at most k
    )
    # Every range of a group holds one row at least, so k ranges before it hold the last k.
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(-k, -1)
    halo = tails.select(*group, "_range", F.flatten(F.collect_list("_tail").over(earlier)).alias("_halo"))
    halo = halo.select(*group, "_range", F.slice(F.col("_halo"), F.greatest(F.size("_halo") - k + 1, F.lit(1)), k).alias("_halo"))
    inside = Window.partitionBy(*group, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(-k, -1)
    joined = attach(placed.withColumn("_own", F.collect_list(key).over(inside)), halo, [*group, "_range"])
    history = F.concat("_halo", "_own")
    last = F.slice(history, F.greatest(F.size(history) - k + 1, F.lit(1)), k)
    return joined.withColumn("_last", last).withColumns({c: f(F.col("_last")) for c, f in found.items()}).drop(
        "_range", "_own", "_halo", "_last"
    )


def _total(column: str) -> Callable[[Column], Column]:
    return lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: s + r[column])


def form(matches: DataFrame, k: int = FORM) -> DataFrame:
    """Points and goals of each team over its last ``k`` played matches before each match, and how many there are."""
    found = {
        "form_points": _total("points"),
        "form_for": _total("goals_for"),
        "form_against": _total("goals_against"),
        "form_matches": lambda rows: F.size(rows).cast("long"),
    }
    over = ["points", "goals_for", "goals_against"]
    return before_each(team_matches(matches), ["league", "team_id"], ["date", "match_id"], k, found, over)


def home_advantage(matches: DataFrame) -> DataFrame:
    """Per league and season: matches, goals and points a match that the home side has more, and shares of results."""
    difference = F.col("home_goals") - F.col("away_goals")
    points = F.when(difference > 0, WIN).when(difference < 0, -WIN).otherwise(0)
    return played(matches).groupBy("league", "season").agg(
        F.count(F.lit(1)).alias("matches"),
        F.avg(difference).alias("goals_more"),
        F.avg(points).alias("points_more"),
        F.avg((difference > 0).cast("double")).alias("home_share"),
        F.avg((difference == 0).cast("double")).alias("draw_share"),
        F.avg((difference < 0).cast("double")).alias("away_share"),
    )


def strength(matches: DataFrame, tolerance: float = 1e-12, most_rounds: int = 200) -> DataFrame:
    """Attack and defence of each team: goals are near attack times the opponent's defence, summed over its matches.

    Both are scaled in turn until neither moves by more than ``tolerance``; the
    mean attack of a league is 1.  Matches are counted per pair of teams first,
    so a round reads as many rows as there are pairs.
    """
    pairs = team_matches(matches).groupBy("league", "team_id", "opponent_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("goals_for").alias("scored"), F.sum("goals_against").alias("conceded")
    )
    pairs = cut_lineage(pairs, "pairs")
    state = pairs.select("league", "team_id").distinct().withColumns({"attack": F.lit(1.0), "defence": F.lit(1.0)})
    by = ["league", "team_id"]

    def scaled(state: DataFrame, column: str, goals: str, against: str) -> DataFrame:
        other = state.select("league", F.col("team_id").alias("opponent_id"), F.col(against).alias("_of"))
        sums = pairs.join(other, ["league", "opponent_id"]).groupBy(*by).agg(
            (F.sum(goals) / F.nullif(F.sum(F.col("n") * F.col("_of")), F.lit(0.0))).alias("_new")
        )
        return state.join(sums, by).withColumn(column, F.coalesce("_new", F.lit(0.0))).drop("_new")

    state = cut_lineage(state, "strength")
    for _ in range(most_rounds):
        after = cut_lineage(scaled(scaled(state, "attack", "scored", "defence"), "defence", "conceded", "attack"), "strength")
        moved = after.join(state.select(*by, F.col("attack").alias("a"), F.col("defence").alias("d")), by).agg(
            F.max(F.greatest(F.abs(F.col("attack") - F.col("a")), F.abs(F.col("defence") - F.col("d"))))
        ).first()[0]
        state = after
        if moved is None or moved <= tolerance:
            break
    means = state.groupBy("league").agg(F.avg("attack").alias("_mean"))
    scale = F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(1.0)
    return attach(state, means, ["league"]).select(
        *by, (F.col("attack") / scale).alias("attack"), (F.col("defence") * scale).alias("defence")
    )


def fair_probabilities(odds: Sequence[Column]) -> Column:
    """Probabilities behind decimal odds of all outcomes, without the margin: powers of 1 / odds that sum to 1.

    The exponent is found by a fixed number of halvings in one expression: the
    odds are inverted once a row, and a halving sums the powers once.
    Null unless all odds are above 1.
    """
    implied = F.array(*[1 / o.cast("double") for o in odds])

    def powers(values: Column, k: Column) -> list[Column]:
        return [F.pow(F.get(values, F.lit(i)), k) for i in range(len(odds))]

    def found(values: Column) -> Column:
        def higher(low: Column, width: Column) -> Column:
            middle = low + width
            return F.when(reduce(add, powers(values, middle)) > 1, middle).otherwise(low)

        widths = F.array(*[F.lit(WIDEST / 2**i) for i in range(1, HALVINGS + 1)])
        last = F.lit(WIDEST / 2 ** (HALVINGS + 1))
        return F.aggregate(widths, F.lit(0.0), higher, lambda low: F.array(*powers(values, low + last)))

    known = F.forall(F.array(*[o.cast("double") for o in odds]), lambda o: F.coalesce(o > 1, F.lit(False)))
    # A lambda's argument is computed once, however often the lambda reads it.
    return F.when(known, F.get(F.transform(F.array(implied), found), F.lit(0)))


def poisson(rate: Column, most: int = MOST_GOALS) -> Column:
    """Probabilities of 0 to ``most`` goals."""
    terms = [F.exp(-rate) * F.pow(rate, F.lit(i)) / F.lit(float(math.factorial(i))) for i in range(most + 1)]
    return F.array(*terms)


def scorelines(rates: DataFrame, home: str = "home_rate", away: str = "away_rate", most: int = MOST_GOALS) -> DataFrame:
    """The rows with p_home, p_draw, p_away and the likeliest score, from a grid of two independent counts of goals.

    Shares are of the scores up to ``most`` goals a side; the score with fewer home, then away goals wins ties.
    """
    grid = rates.withColumns({"_h": poisson(F.col(home), most), "_a": poisson(F.col(away), most)})
    cells = F.flatten(
        F.transform("_h", lambda p, i: F.transform("_a", lambda q, j: F.struct((p * q).alias("p"), (-i).alias("i"), (-j).alias("j"))))
    )

    def share(test: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("_cells", test), F.lit(0.0), lambda s, c: s + c["p"])

    best = F.array_max("_cells")
    return (
        grid.withColumn("_cells", cells)
        .withColumns({"_home": share(lambda c: c["i"] < c["j"]), "_draw": share(lambda c: c["i"] == c["j"]), "_away": share(lambda c: c["i"] > c["j"])})
        .withColumn("_all", F.col("_home") + F.col("_draw") + F.col("_away"))
        .withColumns({f"p_{x}": F.col(f"_{x}") / F.col("_all") for x in ("home", "draw", "away")})
        .withColumns({"home_score": -best["i"], "away_score": -best["j"]})
        .drop("_h", "_a", "_cells", "_home", "_draw", "_away", "_all")
    )
