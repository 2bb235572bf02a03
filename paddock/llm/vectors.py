"""Near-duplicate vectors by p-stable hashing and exact cosines.

Normalised vectors of cosine 0.98 or more are at most 0.2 apart.  A table's key
joins the quantised projections of a vector on Gaussian directions; near
vectors share a key in some table, and vectors that share one are compared
exactly.  The number of projections in a key grows with the logarithm of the
rows of a label, so that unrelated vectors seldom meet in a table of any size,
and the number of tables with it, so that near ones always do.  Only ids go
through the buckets.  A bucket of any size is cut into blocks, of which each
task compares two by one matrix product.  Only sums per vector and a spanning
forest leave a task, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from paddock.llm.components import components
from paddock.llm.texts import small_batches, stage, worker_cache

LEAST_COSINE = 0.98
#: Chance that a pair at the limit shares no key.
MISSED = 4e-6
#: Projections of a key beyond those that leave a vector one unrelated partner in a table.
SPARE = 2
#: Width of a slot, in distances of a pair at the limit.
WIDTH = 7.5
#: Vectors of one bucket that one task compares with as many others.
BLOCK = 1024
#: Components and directions are rounded to these fractions, which makes sums of their products exact in any order.
UNIT_STEPS, DIRECTION_STEPS = 1 << 20, 1 << 16
_SEED = 20240301


def _same_slot(width: float) -> float:
    """Chance that two points share a slot of this width, in distances between them."""
    return math.erf(width / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def tables_for(rows: int, least: float = LEAST_COSINE) -> tuple[int, int]:
    """Tables, and projections of each key, for a label with so many different vectors."""
    unrelated, near = _same_slot(WIDTH * math.sqrt(1 - least)), _same_slot(WIDTH)
    projections = SPARE + max(1, math.ceil(math.log(rows) / -math.log(unrelated)))
    return math.ceil(math.log(MISSED) / math.log1p(-(near**projections))), projections


def usable(vector: list[float | None] | None) -> bool:
    """Whether a vector has a direction: finite components, none null, not all zero."""
    return bool(vector) and None not in vector and all(map(math.isfinite, vector)) and any(vector)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that no square overflows or vanishes.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _directions(size: int, tables: int, projections: int) -> tuple[np.ndarray, ...]:
    """Rounded directions, shifts of the slots, and factors and first terms of the keys."""
    rng = np.random.default_rng((_SEED, size, projections))
    along = np.rint(rng.standard_normal((size, tables * projections)) * DIRECTION_STEPS)
    factors = rng.integers(0, 1 << 63, (tables, projections), np.uint64) * np.uint64(2) + np.uint64(1)
    return along, rng.random(tables * projections), factors, rng.integers(0, 1 << 63, (2, tables), np.uint64)


def _keys(units: np.ndarray, label: int, rows: int, least: float) -> np.ndarray:
    """A row of keys, one for each table, for every unit vector of a label with so many different vectors.

    The same vector gets the same keys in every task, as no sum is rounded.
    """
    tables, projections = tables_for(rows, least)
    name = f"directions {units.shape[1]} {tables} {projections}"
    along, shift, factors, first = worker_cache(name, lambda: _directions(units.shape[1], tables, projections))
    width = WIDTH * math.sqrt(2 - 2 * least) * UNIT_STEPS * DIRECTION_STEPS
    start = first[0] + first[1] * np.uint64(label)
    out = []
    for at in range(0, len(units), 256):
        slots = np.floor(np.rint(units[at : at + 256] * UNIT_STEPS) @ along / width + shift).astype(np.int64).view(np.uint64)
        out.append((slots.reshape(-1, tables, projections) * factors).sum(axis=2, dtype=np.uint64) + start)
    return np.concatenate(out).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows that follow each other with the same first ``keys`` columns, all of them long."""
    held, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        where = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if (group := tuple(where[low].tolist())) != held:
                if parts:
                    yield parts
                held, parts = group, []
            parts.append(batch.slice(low, high - low))
    if parts:
        yield parts


def _column(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(p.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for p in parts])


def _vectors(parts: list[pa.RecordBatch], size: int) -> np.ndarray:
    found = [p.column(p.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False) for p in parts]
    return np.concatenate(found).reshape(-1, size).astype(float)


def _keyed(classes: DataFrame, least: float) -> DataFrame:
    """(cid, keys): one key for each table of the vector's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _runs(batches, 3):
            label, size, rows = (parts[0].column(c)[0].as_py() for c in range(3))
            keys = _keys(_unit(_vectors(parts, size)), label, rows, least)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(_column(parts, "cid")), lists], ["cid", "keys"])

    ordered = classes.select("lid", "size", "of_label", "cid", "embedding").sortWithinPartitions("lid", "size")
    return ordered.mapInArrow(run, "cid long, keys array<long>")


def _compared(blocks: DataFrame, least: float) -> DataFrame:
    """From (key, i, j, lid, size, of_label, t, left, right, cid, n, embedding): (cid, links, root) of vectors with links found there.

    A pair counts in the first table in which its keys agree.  ``root`` stands
    for the vectors that links of this comparison join.
    """

    def compare(parts: list[pa.RecordBatch]) -> list[np.ndarray] | None:
        label, size, rows, table = (parts[0].column(c)[0].as_py() for c in range(3, 7))
        cid, n = _column(parts, "cid"), _column(parts, "n")
        units = _unit(_vectors(parts, size))
        left, right = (np.flatnonzero(_column(parts, c)) for c in ("left", "right"))
        a, b = [], []
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            i, j = np.nonzero(units[part] @ units[right].T >= least)
            i, j = part[i], right[j]
            # Within one block every pair is met from both ends.
            fresh = (i < j) if len(left) == len(right) == len(cid) else (i != j)
            if fresh.any():
                a.append(i[fresh])
                b.append(j[fresh])
        if not a:
            return None
        keys = _keys(units, label, rows, least)[:, :table]
        links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for i, j in zip(a, b):
            first = ~(keys[i] == keys[j]).any(axis=1)
            np.add.at(links, i[first], n[j[first]])
            np.add.at(links, j[first], n[i[first]])
        i, j = np.concatenate(a), np.concatenate(b)
        while True:  # smallest label of the neighbours, then of the label's label
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
            root = root[root]
            if (root == before).all():
                break
        near = np.unique(np.concatenate([i, j]))
        return [cid[near], links[near], cid[root[near]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _runs(batches, 5):
            if sum(p.num_rows for p in parts) > 1 and (found := compare(parts)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["cid", "links", "root"])

    return blocks.mapInArrow(run, "cid long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal labels are linked if their cosine is at least ``least``.
    Null labels and vectors that are null, empty, zero or hold null or
    non-finite components are linked with nothing, and vectors of different
    lengths with each other neither.  Equal vectors are one class until the
    end.  Repeated rows count as vectors of their own; rows of one vec_id share
    a component.  The work for a group of ``m`` different vectors that are all
    near each other grows with ``m`` squared, as each has ``m`` links to count;
    it is cut into blocks, and what leaves a task is linear.  A row without
    vec_id is compared like any other; it counts in the links of others and has
    its own, but no component is named after it unless no other row is in it,
    and it is kept.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kinds = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fit = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall(kinds, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(kinds, lambda x: x != 0)
    )
    # Single precision stays as it is, half as much to shuffle; all arithmetic is double.
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    held = F.col("embedding").cast(f"array<{'float' if single else 'double'}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", held.alias("embedding"))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    grouped = rows.where("fit").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stage(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = classes.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    labels = stage(labels.withColumn("lid", F.monotonically_increasing_id()), "labels")
    sized = classes.join(labels, "label").withColumn("size", F.size("embedding").cast("long"))

    keyed = stage(_keyed(sized, least), "keys")
    entries = keyed.select("cid", F.posexplode("keys").alias("t", "key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    shared = entries.join(sizes, "key").withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("cid"), blocks)})
    placed = shared.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    ready = (
        placed.join(sized, "cid")
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "lid", "size", "of_label", "t", (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"), "cid", "n", "embedding")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "lid", "size")
    )
    found = stage(_compared(ready, least), "near")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))

    rooted = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    known = rooted.join(smallest, "root").join(links, "cid", "left").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    same = (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & F.col("fit")
    out = rows.join(known, same, "left").select(
        "id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("least", "id").alias("component_id")
    )
    several = out.groupBy("id").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x <> y")
    bridges = stage(out.join(several, "id").select(F.col("component_id").alias("a"), F.col("x").alias("b")).distinct(), "bridges")
    if not bridges.isEmpty():
        merged = components(bridges)
        out = out.join(merged.withColumnRenamed("node", "component_id"), "component_id", "left").withColumn("component_id", F.coalesce("root", "component_id"))
    return out.select(
        F.col("id").alias("vec_id"), F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
