"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the characters of the mix; its rate is the
target share over its own share.  A document appears as often as a Poisson
variable with that mean says, whose uniform number comes from a hash of seed
and doc_id: ``count = number of k with P(X <= k) <= u``.  All copies are dealt
out in the order of a second hash, which shuffles the mix globally.  The same
seed gives the same mix, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.texts import fresh, stage

#: Target shares are proportional to the source's characters to this power, unless weights are given.
TEMPERATURE = 0.5
SEED = 42
#: 13 hexadecimal digits of an MD5: 52 bits, exact in a double.
_BITS = 52
#: A mean number of copies above which a mix is refused, unless another limit or none (null) is given.
MOST_COPIES = 500.0
#: Means above this are drawn as the sum of that many equal draws, as exp(-rate) of a large rate is zero in a double.
_ONE_DRAW = 500.0


def hashed(*parts: Column | str) -> Column:
    """A uniform 52-bit number from the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_rates(
    docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE, most_copies: float | None = MOST_COPIES
) -> DataFrame:
    """Per source (null is a source too): characters and rate, the mean number of copies.

    ``weights`` (source, weight) states target shares up to a factor; sources
    it doesn't name get none.  Without it shares follow ``temperature``.  A
    source without characters has rate 1 if it takes part: its documents carry no weight.
    A rate above ``most_copies`` is an error; with None every rate holds.
    """
    # Two steps, so that a hot source is added up in many tasks first.
    held = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(held).alias("chars"))
    if weights is None:
        targets = sizes.withColumns({"_weight": F.pow(F.col("chars").cast("double"), F.lit(temperature)), "_plain": F.lit(1.0)})
    else:
        named = weights.groupBy(F.col("source").alias("_source")).agg(F.sum("weight").cast("double").alias("_weight"))
        targets = sizes.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        weight = F.coalesce("_weight", F.lit(0.0))
        targets = targets.withColumns({"_weight": F.when(F.col("chars") > 0, weight).otherwise(0.0), "_plain": F.when(weight > 0, 1.0).otherwise(0.0)})
    targets = stage(targets, "targets")
    all_chars, weights_sum = targets.agg(F.sum("chars")).scalar(), targets.agg(F.sum("_weight")).scalar()
    rate = F.col("_weight") / F.nullif(weights_sum, F.lit(0.0)) * all_chars / F.nullif(F.col("chars"), F.lit(0))
    rate = F.when(F.col("chars") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(F.col("_plain"))
    if most_copies is not None:
        too_often = F.raise_error(F.lit(f"a rate above {most_copies:g} copies of a document"))
        rate = F.when(rate > most_copies, too_often.cast("double")).otherwise(rate)
    return targets.select("source", "chars", rate.alias("rate"))


def copies(rate: Column, u: Column) -> Column:
    """The Poisson count of mean ``rate`` at the quantile ``u`` (0 <= u < 1).

    Terms are added up to ``rate + 12 sqrt(rate) + 32``; what lies beyond has a
    probability below 2^-52 and no ``u`` reaches it.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 32).cast("int")
    step = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        beyond = state["cdf"] <= u
        return F.struct(
            F.when(beyond, state["n"] + 1).otherwise(state["n"]).alias("n"),
            p.alias("p"),
            F.when(beyond, state["cdf"] + p).otherwise(state["cdf"]).alias("cdf"),
        )

    return F.aggregate(F.sequence(F.lit(1), most), step, add, lambda s: s["n"])


def draws(rate: Column, uniform: Callable[[Column | None], Column]) -> Column:
    """A Poisson count of mean ``rate``, of any finite size.

    ``uniform(None)`` is the number in [0, 1) that decides up to ``_ONE_DRAW``; a larger mean
    is the sum of ``k`` independent counts of mean rate / k, decided by ``uniform(1)`` .. ``uniform(k)``.
    """
    k = F.ceil(rate / _ONE_DRAW).cast("int")
    several = F.aggregate(F.sequence(F.lit(1), k), F.lit(0).cast("long"), lambda n, i: n + copies(rate / k, uniform(i)))
    return F.when(rate <= _ONE_DRAW, copies(rate, uniform(None)).cast("long")).otherwise(several)


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    most_copies: float | None = MOST_COPIES,
) -> DataFrame:
    """The mix: the columns of ``docs``, then ``copy`` (from 1) and ``shuffle_key``.

    The key deals every copy to a partition and orders it there.

    Rows with the same doc_id and source are replicated alike; rows of a null
    doc_id are told apart by text and source.  Sources with rate 0 and empty tables give no
    rows.  A source whose rate is above ``most_copies`` makes the mix fail; None
    sets no limit.  Columns named ``copy`` or ``shuffle_key`` in ``docs`` give way to those
    of the mix.
    """
    docs = docs.drop("copy", "shuffle_key")
    named, rate, count = fresh(docs, "_source", "_rate", "_count")
    # Written, so that its real size decides on a broadcast; sources may be many.
    rates = stage(source_rates(docs, weights, temperature, most_copies), "rates").select(F.col("source").alias(named), F.col("rate").alias(rate))
    content = F.concat_ws(":", F.md5(F.coalesce("text", F.lit(""))), "source")
    doc_id = F.coalesce(F.col("doc_id").cast("string"), content)

    def uniform(part: Column | None) -> Column:
        return hashed(F.lit(f"{seed}:count"), doc_id, *([] if part is None else [part.cast("string")])) / F.lit(float(1 << _BITS))

    rated = docs.join(rates, F.col("source").eqNullSafe(F.col(named)))
    drawn = rated.withColumn(count, draws(F.col(rate), uniform)).where(F.col(count) > 0)
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).withColumn(
        "shuffle_key", hashed(F.lit(f"{seed}:place"), doc_id, F.col("copy").cast("string"))
    )
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        out.select(*docs.columns, F.col("copy").cast("long"), "shuffle_key")
        .repartition(parts, "shuffle_key")
        .sortWithinPartitions("shuffle_key", "doc_id", "copy")
    )
