"""Near-duplicate documents by MinHash with odd sketches.

Candidates share a band of MinHash values.  An odd sketch folds a document's
MinHash samples into a bitmap, each sample toggling one bit; the number of bits
in which two sketches differ estimates how many samples differ, precisely so
for similar documents.  Candidates whose sketches are far apart go; the rest
are confirmed on their full sets of shingles.

Only links between components matter, so a bucket's documents are first linked
to its smallest one, and only what remains apart is compared further: by
sketches, block by block, and then the documents with close sketches exactly.
What leaves a task is linear in the documents it got.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.components import components
from paddock.llm.texts import CACHE_ENTRIES, fresh, small_batches, stage, words, worker_cache

#: 40 bands of 5: a pair of similarity 0.8 shares none with probability 1.3e-7.
BANDS, ROWS = 40, 5
SKETCH_BITS = 512
#: Sketches further apart than a similarity of this suggests are no candidates: 6 standard deviations below 0.8.
SKETCH_LEAST = 0.60
#: Documents of one bucket that one task compares with as many others.
BLOCK = 1024
#: Shingles of the documents of a block, about: a task holds the full sets of two blocks, or of two longer documents.
BLOCK_SHINGLES = 1 << 21
_SEED = 20240229


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; of all words if there are fewer."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    cache = worker_cache("word hashes", _WordHashes)
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    w = np.array([cache[x] for x in found], np.uint64)
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - size + 1 + i])
    return np.unique(h)


def _constants() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(_SEED)
    k = BANDS * ROWS
    return (
        rng.integers(0, 1 << 32, (k, 1), np.uint32),
        rng.integers(0, 1 << 31, (k, 1), np.uint32) * np.uint32(2) + np.uint32(1),
        rng.integers(0, 1 << 63, k, np.uint64),
    )


def signature(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Band keys and odd sketch of a non-empty set, both as 64-bit numbers."""
    salt, factor, place = worker_cache("minhash constants", _constants)
    low = (hashes >> np.uint64(16)).astype(np.uint32)
    sample = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(sample, ((low[at : at + 2048] ^ salt) * factor).min(axis=1), out=sample)
    bands = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in sample.reshape(BANDS, ROWS).T:
        bands = _mix(bands * np.uint64(0x9E3779B97F4A7C15) + row)
    bits = _mix(sample + place) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return bands.view(np.int64).tolist(), np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def far_apart(least: float = SKETCH_LEAST) -> int:
    """Differing bits that sketches of sets with this similarity are expected to have."""
    samples = BANDS * ROWS
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * samples * (1 - least))))


_SETS = "row long, id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"


def _sets(docs: DataFrame, n: int, row: Column) -> DataFrame:
    """Per row: its number, size and 128-bit hash of its set, band keys and sketch (null if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, doc_id, text_hash, text in zip(*[c.to_pylist() for c in batch.columns]):
                h = shingles(text, n)
                sums = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (h, _mix(h + np.uint64(1)))]
                bands, sketch = signature(h) if len(h) else (None, None)
                out.append((number, doc_id, text_hash, len(h), *sums, bands, sketch))
            types = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
            names = ["row", "id", "text_hash", "n_shingles", "s1", "s2", "bands", "sketch"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return docs.select(row, F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, _SETS)


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, hashes) of the classes wanted (cid, rep, text_hash, s1), from the document that stands for each.

    A class without any doc_id (rep is null) is found by the hash of a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, s1, texts = (batch.column(i).to_pylist() for i in range(3))
            sets = [shingles(t, n) for t in texts]
            same = [i for i, h in enumerate(sets) if int(h.sum(dtype=np.uint64).astype(np.int64)) == s1[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cids[i] for i in same], pa.int64()), pa.array([sets[i].tobytes() for i in same], pa.binary())],
                ["cid", "hashes"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    found = texts.join(wanted.drop("text_hash"), "rep").select("cid", "s1", "text")
    nameless = wanted.where("rep IS NULL").drop("rep")
    if not nameless.isEmpty():
        # Distinct, so that a text of many copies is cut once.
        others = texts.where("rep IS NULL AND text IS NOT NULL").select("text").distinct().withColumn("text_hash", F.xxhash64("text"))
        found = found.union(others.join(nameless, "text_hash").select("cid", "s1", "text"))
    # Repeated rows of a document give its set more than once.
    return found.mapInArrow(run, "cid long, hashes binary").dropDuplicates(["cid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    first = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x"))
    second = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ."""
    each = [F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH_BITS // 64)]
    return sum(each[1:], each[0])


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches are close enough."""
    x = sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("x"))
    y = sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(_differing(F.col("x"), F.col("y")) <= far_apart()).select("a", "b")


def _apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, t, cid, root) of the buckets whose documents are in several components."""
    member = shared.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("key", "t", "cid", F.coalesce("root", "cid").alias("root"))
    split = member.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return member.join(split, "key")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows that follow each other with the same first ``keys`` columns, as lists of their other columns."""
    group, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != group:
                if rows:
                    yield group, rows
                group, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield group, rows


def _suspects(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(k, i, j, left, right, cid, root): documents of a bucket with a document of another component and a close sketch.

    ``members``: (key, t, cid, root) of the buckets that hold several
    components, ``t`` the number of the band.  A bucket is cut into blocks of
    bounded documents and shingles, and each task compares two of them; a pair is met in the first band it shares.
    """
    blocks = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    sizes = members.join(classes.select("cid", "n_shingles"), "cid").groupBy("key").agg(F.ceil(blocks).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "key").join(classes.select("cid", "sketch", "bands"), "cid").withColumn("mine", mine)
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("key").alias("k"),
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        (F.col("mine") <= F.col("other")).alias("left"),
        (F.col("mine") >= F.col("other")).alias("right"),
        "cid",
        "root",
        "t",
        "sketch",
        "bands",
    )
    limit = far_apart()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _grouped(batches, 3):
            root = np.array([r[3] for r in rows], np.int64)
            bits = np.array([r[5] for r in rows], np.int64).view(np.uint64)
            earlier = np.array([r[6] for r in rows], np.int64)[:, : rows[0][4]]
            left, right = (np.flatnonzero([r[c] for r in rows]) for c in (0, 1))
            close = np.zeros(len(rows), bool)
            for x in left:
                near = right[root[right] != root[x]]
                near = near[np.bitwise_count(bits[near] ^ bits[x]).sum(axis=1) <= limit]
                near = near[~(earlier[near] == earlier[x]).any(axis=1)]
                close[near] = True
                close[x] |= len(near) > 0
            if close.any():
                out = [(*group, *rows[x][:4]) for x in np.flatnonzero(close)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["k", "i", "j", "left", "right", "cid", "root"])

    ordered = paired.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return ordered.mapInArrow(run, "k long, i long, j long, left boolean, right boolean, cid long, root long")


def _confirmed_suspects(suspects: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among suspects compared in one task, as many as join their components.

    All pairs of different components are compared on their full sets, but no
    pair leaves the task unless it joins two that nothing joined before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 3):
            cid, root = [r[2] for r in rows], np.array([r[3] for r in rows], np.int64)
            hashes = [np.frombuffer(r[4], np.uint64) for r in rows]
            sizes = np.array([len(h) for h in hashes])
            begins = np.cumsum(sizes) - sizes
            codes = np.unique(np.concatenate(hashes), return_inverse=True)[1].astype(np.int32)
            mark = np.zeros(int(codes.max()) + 1, np.int32)
            right, out = np.array([r[1] for r in rows]), []
            for x in np.flatnonzero([r[0] for r in rows]):
                other = right & (root != root[x])
                if not other.any():
                    continue
                own = codes[begins[x] : begins[x] + sizes[x]]
                mark[own] = 1
                both = np.add.reduceat(mark[codes], begins)
                mark[own] = 0
                for y in np.flatnonzero(other & (100 * both >= percent * (sizes + sizes[x] - both))):
                    if root[x] != root[y]:
                        root[root == root[y]] = root[x]
                        out.append((cid[x], cid[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    ordered = suspects.join(sets, "cid").select("k", "i", "j", "left", "right", "cid", "root", "hashes")
    ordered = ordered.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "cid")
    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A set holds the distinct runs of ``n`` words of a text; with fewer words,
    the whole sequence; without words or text it is empty and linked with
    nothing.  Documents are linked if 100 * intersection >= percent * union.
    ``component_id`` is the smallest doc_id that links reach.  Rows with the
    same doc_id are one document: they share a component, and repeated rows
    give repeated rows.  A row without doc_id is a document of its own: it is
    linked like any other, and kept only if no linked document has a doc_id and
    it is the first of those; ``component_id`` is null then.  Documents of equal
    sets become one class before anything is compared, so thousands of copies
    cost no more than one.
    """
    rows, out = _linked(docs, n, percent, F.monotonically_increasing_id())
    kept = F.col("id") == F.col("component_id")
    if rows.where("id IS NULL AND n_shingles > 0").isEmpty():
        kept = F.coalesce(kept, F.lit(True))
    else:
        nameless = out.where("component_id IS NULL AND root IS NOT NULL")
        first = nameless.groupBy("root").agg(F.min(F.struct("text_hash", "row")).alias("m")).select("root", F.col("m.row").alias("first"))
        out = out.join(first, "root", "left")
        alone = F.col("component_id").isNull() & F.coalesce(F.col("row") == F.col("first"), F.lit(True))
        kept = F.when(F.col("id").isNull(), alone).otherwise(kept)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def _linked(docs: DataFrame, n: int, percent: int, row: Column) -> tuple[DataFrame, DataFrame]:
    """The written sets of all rows, and per row: row, id, text_hash, n_shingles, component_id, root.

    ``row`` numbers the rows.  ``root`` is the class that stands for the linked
    classes before rows of one doc_id are brought together; null for an empty set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = stage(_sets(docs, n, row), "sets")
    # The smallest doc_id there is: false comes before true, but null before any number.
    least = F.min(F.struct(F.col("id").isNull(), "id", "text_hash", "bands", "sketch")).alias("m")
    grouped = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(least, F.min("n_shingles").alias("n_shingles"))
    classes = stage(
        grouped.select(
            F.monotonically_increasing_id().alias("cid"), "s1", "s2", "n_shingles", F.col("m.id").alias("rep"), "m.text_hash", "m.bands", "m.sketch"
        ),
        "classes",
    )
    sketches = classes.select("cid", "sketch")
    keyed = classes.select("cid", F.posexplode("bands").alias("t", "key"))
    hubs = keyed.groupBy("key").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(keyed.join(hubs.select("key", "hub"), "key"), "buckets")
    star = shared.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
    tried = stage(_close(star, sketches), "tried")
    ends = shared.select("cid").distinct()
    wanted = classes.join(ends, "cid", "left_semi").select("cid", "rep", "text_hash", "s1")
    full = stage(_full_sets(docs, wanted, n), "full")
    links = stage(_confirmed(tried, full, percent), "links")
    roots = components(links)
    apart = stage(_apart(shared, roots), "apart")
    suspects = stage(_suspects(apart, classes), "suspects")
    if not suspects.isEmpty():
        roots = components(links.union(stage(_confirmed_suspects(suspects, full, percent), "links")))
    return rows, _labelled(rows, classes, roots)


def _labelled(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    named = classes.select("cid", "s1", "s2", "rep")
    rooted = named.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    labelled = rooted.join(smallest, "root").select("s1", "s2", "least", "root")
    out = (
        rows.select("row", "id", "text_hash", "n_shingles", "s1", "s2")
        .join(labelled, ["s1", "s2"], "left")
        .withColumn("component_id", F.coalesce("least", "id"))
        .select("row", "id", "text_hash", "n_shingles", "component_id", "root")
    )
    # Rows of one document with different texts join the components of all its texts.
    several = out.where("id IS NOT NULL").groupBy("id").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x <> y")
    bridges = stage(out.join(several.select("id"), "id").groupBy("id", "component_id").agg(F.min("component_id").alias("_")).join(several, "id").select(F.col("component_id").alias("a"), F.col("x").alias("b")), "bridges")
    if not bridges.isEmpty():
        merged = components(bridges).select(F.col("node").alias("component_id"), F.col("root").alias("_least"))
        out = out.join(merged, "component_id", "left").withColumn("component_id", F.coalesce("_least", "component_id")).drop("_least")
    return out


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Exactly one row of ``docs`` of each group of near-duplicates: that of the smallest doc_id.

    Equal rows and rows of one doc_id with different texts are one group.  Rows without doc_id take part as documents
    of their own, which come after those that have one; each with an empty set is a group by itself.  Of rows with
    equal doc_id and text any one stays.
    """
    named, held, own, many = fresh(docs, "_id", "_held", "_own", "_many")
    _, out = _linked(docs, n, percent, F.monotonically_increasing_id())
    alone = F.col("id").isNull() & F.col("root").isNull()
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("root")).alias("g")]
    each = out.where(~alone).groupBy(*group, "id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy("component_id", "g").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash", "n")).alias("m"))
    kept = first.select(F.col("m.id").alias(named), F.col("m.text_hash").alias(held), (F.col("m.n") > 1).alias(many))
    kept = stage(kept.union(out.where(alone).select("id", "text_hash", F.lit(False)).distinct()), "kept")
    chosen = docs.withColumn(own, F.xxhash64("text")).join(
        kept, F.col("doc_id").cast("long").eqNullSafe(F.col(named)) & (F.col(own) == F.col(held))
    )
    # Only rows that are repeated meet others.
    return chosen.where(~F.col(many)).union(chosen.where(many).dropDuplicates([named, held])).select(*docs.columns)
