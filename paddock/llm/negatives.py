"""Hard negatives by exact search in a multiway hyperplane tree.

Scores are integer inner products.  Every row gets one more coordinate that
brings it to the norm of the longest row, and an anchor gets 0 there; the
square of their distance is then ``|anchor|^2 + longest^2 - 2 * score``, so a
window of scores is an annulus around the anchor in a metric space.

A node of the tree has up to ``FANOUT`` split points, and a row goes to the
nearest.  Each split point stores, for each sibling subtree, the least and the
greatest distance to the rows below it, taken over all rows.  By the triangle
inequality a subtree holds nothing of an annulus if for any split point of its
node the stored range and the range that the annulus allows don't meet.

Split points come from a bounded sample; all rows are indexed.  Leaves are
packed into blocks of at most some ``BLOCK`` rows, in order of the tree, and a
large leaf (copies of one vector) is dealt over several blocks.  A task scans
the leaves of one block that remain for its anchors, by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.texts import small_batches, stage
from paddock.operators.ordering import first_places

#: Rows that split points are taken from, and bytes they may have together: the tree is shipped to all tasks.
SAMPLE, SAMPLE_BYTES = 4096, 32 << 20
#: Split points of a node, rows each is chosen from, and sampled rows that are not split further.
FANOUT, CANDIDATES, LEAF_SAMPLE = 8, 3, 24
#: Rows in a block, anchors that meet one block in a task, and anchors multiplied at once.
BLOCK, ANCHORS, AT_ONCE = 16_384, 65_536, 128
#: Share of the greatest possible distance that rounding may cost.
SLACK = 4e-6

_QUERY = "uid long, id long, label string, vec array<long>, own int, windows array<struct<k: int, lo: long, hi: long>>"


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow list column, filled up with zeros to ``width``, and their lengths."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out, sizes


def _product(a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
    """Exact inner products of integer rows: sums below 2^53 are exact in floating point too, which is faster."""
    if longest < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


@dataclass
class Tree:
    """Split points and ranges of all nodes; children below zero are leaves (``-1 - leaf``), in order of the tree."""

    points: np.ndarray
    splits: list[np.ndarray]
    children: list[list[int]]
    leaves: int
    longest: int
    low: list[np.ndarray] | None = None
    high: list[np.ndarray] | None = None

    def __post_init__(self):
        self.norms = (self.points.astype(float) ** 2).sum(axis=1)

    def _lift(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - norms, 0.0))

    def distances(self, rows: np.ndarray, node: int, lifted: bool = True) -> np.ndarray:
        """From each row (``lifted``) or anchor to the split points of a node."""
        at = self.splits[node]
        rows = rows.astype(float)
        norms = (rows**2).sum(axis=1)
        square = norms[:, None] + self.norms[at] - 2 * rows @ self.points[at].astype(float).T
        lift = self._lift(norms) if lifted else np.zeros(len(rows))
        return np.sqrt(np.maximum(square + (lift[:, None] - self._lift(self.norms[at])) ** 2, 0.0))

    def place(self, rows: np.ndarray, seen: dict) -> np.ndarray:
        """The leaf of every row; ``seen`` collects (node, child) -> least and greatest distances to the split points."""
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))] if self.splits else []
        while todo:
            node, at = todo.pop()
            d = self.distances(rows[at], node)
            nearest = d.argmin(axis=1)
            for j in np.unique(nearest):
                mine = nearest == j
                lo, hi = d[mine].min(axis=0), d[mine].max(axis=0)
                before = seen.get((node, int(j)))
                seen[node, int(j)] = (lo, hi) if before is None else (np.minimum(lo, before[0]), np.maximum(hi, before[1]))
                child = self.children[node][j]
                if child < 0:
                    out[at[mine]] = -1 - child
                else:
                    todo.append((child, at[mine]))
        return out

    def remaining(self, anchors: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Per window (of an anchor, from score ``lo`` to ``hi``): which leaves may hold rows of it."""
        norms = (anchors.astype(float) ** 2).sum(axis=1)[of]
        slack = SLACK * (np.sqrt(float(self.longest)) + np.sqrt(norms) + 1)
        far = np.sqrt(np.maximum(norms + self.longest - 2.0 * lo, 0.0)) + slack
        near = np.sqrt(np.maximum(norms + self.longest - 2.0 * hi, 0.0)) - slack
        out = np.full((len(of), self.leaves), not self.splits)
        todo = [(0, np.arange(len(of)))] if self.splits else []
        while todo:
            node, at = todo.pop()
            d = self.distances(anchors, node, lifted=False)[of[at]]
            least = np.maximum(d - far[at, None], near[at, None] - d)
            most = d + far[at, None]
            for j, child in enumerate(self.children[node]):
                keep = ((self.high[node][:, j] >= least) & (self.low[node][:, j] <= most)).all(axis=1)
                if child < 0:
                    out[at[keep], -1 - child] = True
                elif keep.any():
                    todo.append((child, at[keep]))
        return out


def grow(points: np.ndarray, longest: int) -> Tree:
    """A tree over sampled rows; each split takes points that are far apart, each the farthest from those before it."""
    tree = Tree(points, [], [], 0, longest)
    parts = [(np.arange(len(points)), None)]
    while parts:  # depth first, so that leaves are numbered in order of the tree
        at, parent = parts.pop()
        chosen: list[int] = []
        if len(at) > LEAF_SAMPLE:
            probe = Tree(points, [at[: CANDIDATES * FANOUT]], [], 0, longest)
            apart = np.full(len(probe.splits[0]), np.inf)
            nxt = 0
            while len(chosen) < FANOUT and apart[nxt] > SLACK * (np.sqrt(float(longest)) + 1):
                chosen.append(nxt)
                apart = np.minimum(apart, probe.distances(points[at[nxt : nxt + 1]], 0)[0])
                nxt = int(apart.argmax())
        if len(chosen) < 2:
            if parent:
                tree.children[parent[0]][parent[1]] = -1 - tree.leaves
            tree.leaves += 1
            continue
        node = len(tree.splits)
        if parent:
            tree.children[parent[0]][parent[1]] = node
        tree.splits.append(at[chosen])
        tree.children.append([0] * len(chosen))
        nearest = tree.distances(points[at], node).argmin(axis=1)
        parts += [(at[nearest == j], (node, j)) for j in reversed(range(len(chosen)))]
    return tree


@dataclass
class Index:
    """All rows (block, leaf, uid, id, label, vec), written; their tree; blocks of each leaf."""

    rows: DataFrame
    tree: Tree
    first: np.ndarray
    parts: np.ndarray
    width: int


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    kinds = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    fit &= F.forall(kinds, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(fit).select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("string").alias("label"),
        F.transform(kinds, lambda x: F.floor(x * scale).cast("long")).alias("vec"),
        F.aggregate(kinds, F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double")).alias("norm"),
    )


def build_index(vectors: DataFrame, scale: int = 256) -> Index | None:
    """Index every usable row of ``vectors`` (vec_id, embedding, label); None if there is none."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stage(_usable(vectors, scale), "vectors")
    size = rows.agg(F.max("norm").alias("norm"), F.max(F.size("vec")).alias("width")).first()
    if size["norm"] is None:
        return None
    if size["norm"] >= 2.0**62:
        raise ValueError("scores don't fit 64 bits")
    width, longest = int(size["width"]), int(size["norm"] * (1 + 1e-12)) + 1
    many = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * max(width, 1))))
    taken = rows.select("vec", F.xxhash64("id", "uid").alias("h")).orderBy("h").limit(many).collect()
    points = np.zeros((len(taken), width), np.int64)
    for i, r in enumerate(taken):
        points[i, : len(r["vec"])] = r["vec"]
    tree = grow(points, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            vectors, _ = _matrix(batch.column(batch.schema.get_field_index("vec")), width)
            leaves = pa.array(tree.place(vectors, seen), pa.int32())
            n = batch.num_rows
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(4)] + [leaves, *none], names)
        if seen:  # what this task saw between split points and subtrees
            n = len(seen)
            node, child = zip(*seen)
            low, high = zip(*[(a.tolist(), b.tolist()) for a, b in seen.values()])
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int32())]
            ranges = [pa.array(node, pa.int32()), pa.array(child, pa.int32()), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(none + ranges, names)

    names = ["uid", "id", "label", "vec", "leaf", "node", "child", "low", "high"]
    kinds = "uid long, id long, label string, vec array<long>, leaf int, node int, child int, low array<double>, high array<double>"
    placed = stage(rows.select("uid", "id", "label", "vec").mapInArrow(run, kinds), "placed")

    tree.low, tree.high = ([np.full((len(s), len(s)), x) for s in tree.splits] for x in (np.inf, -np.inf))
    spans = placed.where("leaf IS NULL").select("node", "child", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
    # As many rows as the tree has pairs of split points of one node.
    for r in spans.groupBy("node", "child", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect():
        tree.low[r["node"]][r["i"], r["child"]], tree.high[r["node"]][r["i"], r["child"]] = r["low"], r["high"]
    indexed = placed.where("leaf IS NOT NULL").select("uid", "id", "label", "vec", "leaf")
    counts = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row a leaf
        counts[r["leaf"]] = r["count"]
    parts = np.maximum(1, -(-counts // BLOCK))
    first, block, held = np.zeros(tree.leaves, np.int64), 0, 0
    for leaf in range(tree.leaves):
        if held and (parts[leaf] > 1 or held + counts[leaf] > BLOCK):
            block, held = block + 1, 0
        first[leaf] = block
        held += counts[leaf]
        if parts[leaf] > 1:
            block, held = block + parts[leaf], 0
    where = [(leaf, int(first[leaf]), int(parts[leaf])) for leaf in range(tree.leaves)]
    places = spark.createDataFrame(where, "leaf int, first int, parts int")
    block = (F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts"))).cast("int")
    rows = indexed.join(places, "leaf").select(block.alias("block"), "leaf", "uid", "id", "label", "vec")
    return Index(stage(rows, "indexed"), tree, first, parts, width)


def _routed(index: Index, queries: DataFrame) -> DataFrame:
    """The queries with the blocks, but their own, that may hold rows of their windows."""
    tree, first, parts, width = index.tree, index.first, index.parts, index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, _ = _matrix(batch.column(3), width)
            windows = batch.column(5).to_pylist()
            of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            lo, hi = (np.array([w[c] for ws in windows for w in ws], float) for c in ("lo", "hi"))
            alive = tree.remaining(anchors, of, lo, hi)
            found = []
            for i, own in enumerate(batch.column(4).to_pylist()):
                leaves = np.flatnonzero(alive[of == i].any(axis=0))
                blocks = {b for leaf in leaves for b in range(first[leaf], first[leaf] + parts[leaf])}
                found.append(sorted(blocks - {own}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "blocks"])

    routed = queries.mapInArrow(run, _QUERY + ", blocks array<int>")
    return routed.withColumn("block", F.explode("blocks")).drop("blocks")


def _scanned(index: Index, queries: DataFrame, slices: int, same: bool, need: int) -> DataFrame:
    """(uid, found) for each query in each of its blocks: the first ``need`` rows of every window there.

    A task takes one block and one slice of the anchors: both are bounded.
    """
    tree, width = index.tree, index.width
    queries = queries.withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(slices)))
    wanted = index.rows.join(queries.select("block", "slice").distinct(), "block")
    nothing = F.lit(None).cast("array<struct<k: int, lo: long, hi: long>>")
    both = wanted.select("block", "slice", F.lit(0).alias("kind"), "leaf", "uid", "id", "label", "vec", nothing.alias("windows")).union(
        queries.select("block", "slice", F.lit(1), F.lit(None).cast("int"), "uid", "id", "label", "vec", "windows")
    )

    def prepared(rows: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(rows).combine_chunks()
        table = table.take(pa.array(np.argsort(table["leaf"].to_numpy(), kind="stable"))).combine_chunks()
        leaf, uid, ident = (table[c].to_numpy() for c in ("leaf", "uid", "id"))
        vectors, dims = _matrix(table["vec"].chunk(0), width)
        labels = table["label"].chunk(0).dictionary_encode()
        codes = {x: i for i, x in enumerate(labels.dictionary.to_pylist())}
        edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
        return leaf, uid, ident, vectors, dims, labels.indices.to_numpy(), codes, edges

    def search(block: tuple, queries: pa.RecordBatch) -> tuple[list[int], list[list[dict]]]:
        leaf, uid, ident, vectors, dims, label, codes, edges = block
        uids, found = [], []
        for low in range(0, queries.num_rows, AT_ONCE):
            part = queries.slice(low, AT_ONCE)
            anchors, sizes = _matrix(part.column(7), width)
            windows = part.column(8).to_pylist()
            of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            lo, hi = (np.array([w[c] for ws in windows for w in ws], np.int64) for c in ("lo", "hi"))
            alive = tree.remaining(anchors, of, lo.astype(float), hi.astype(float))
            wanted = np.zeros((len(windows), tree.leaves), bool)
            np.logical_or.at(wanted, of, alive)
            scores = np.zeros((len(windows), len(uid)), np.int64)
            met = np.zeros((len(windows), len(uid)), bool)
            for a, b in zip(edges, edges[1:]):
                who = np.flatnonzero(wanted[:, leaf[a]])
                if len(who):
                    scores[who, a:b] = _product(anchors[who], vectors[a:b], tree.longest)
                    met[who, a:b] = True
            at = 0
            for i, (q, name, ws) in enumerate(zip(part.column(4).to_pylist(), part.column(6).to_pylist(), windows)):
                fit = (label == codes.get(name, -1)) == same
                fit &= met[i] & (dims == sizes[i]) & (uid != q)
                own, ids, out = scores[i][fit], ident[fit], []
                for w in ws:
                    hits = np.flatnonzero((own >= lo[at]) & (own <= hi[at]))
                    at += 1
                    if len(hits) > need:
                        edge = np.partition(own[hits], len(hits) - need)[len(hits) - need]
                        hits = hits[own[hits] >= edge]
                    first = hits[np.lexsort((ids[hits], -own[hits]))][:need]
                    out += [{"k": w["k"], "score": int(own[x]), "id": int(ids[x])} for x in first]
                uids.append(q)
                found.append(out)
        return uids, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (here := tuple(keys[a, :2])) != group:
                    group, rows, block = here, [], None
                if keys[a, 2] == 0:
                    rows.append(batch.slice(a, b - a))
                    continue
                block = block or prepared(rows)
                uids, found = search(block, batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(found, kind)], ["uid", "found"])

    kind = pa.list_(pa.struct([("k", pa.int32()), ("score", pa.int64()), ("id", pa.int64())]))
    ordered = both.repartition("block", "slice").sortWithinPartitions("block", "slice", "kind")
    return ordered.mapInArrow(run, "uid long, found array<struct<k: int, score: long, id: long>>")


def search(index: Index, queries: DataFrame, same: bool, need: int) -> DataFrame:
    """(uid, k, rank, score, id): per window the first ``need`` rows of the same or of other labels, best first.

    ``queries`` has (uid, id, label, vec, own, windows).  Each query looks
    through its own block first; a window that is full there needs only better
    rows from elsewhere, so its annulus gets thinner before the tree is asked.
    """
    slices = max(1, -(-queries.count() // ANCHORS))
    probed = stage(_scanned(index, queries.withColumn("block", F.col("own")), slices, same, need), "probed")

    def tightened(w: Column) -> Column:
        mine = F.filter("found", lambda f: f["k"] == w["k"])
        worst = F.array_min(F.transform(mine, lambda f: f["score"]))
        lo = F.when(F.size(mine) >= need, F.greatest(w["lo"], worst)).otherwise(w["lo"])
        return F.struct(w["k"].alias("k"), lo.alias("lo"), w["hi"].alias("hi"))

    narrow = queries.join(probed, "uid").withColumn("windows", F.transform("windows", tightened)).select(*queries.columns)
    elsewhere = _scanned(index, _routed(index, narrow), slices, same, need)
    every = probed.unionByName(elsewhere).select("uid", F.inline("found"))
    return first_places(every, ["uid", "k"], [F.col("score").desc(), F.col("id")], need, "rank")


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _share(score: Column, percent: int, up: bool) -> Column:
    """``percent`` of a score in whole numbers, rounded up or down; hundreds apart, so that no product overflows."""
    hundred = F.lit(100).cast("long")
    rest = F.pmod(score, hundred)
    whole = F.call_function("div", score - rest, hundred)
    part = rest * (-percent if up else percent)
    part = F.call_function("div", part - F.pmod(part, hundred), hundred)
    return whole * percent - part if up else whole * percent + part


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256
) -> DataFrame:
    """Negatives that score nearly as well as an anchor's positives.

    ``vectors`` has (vec_id, embedding, label); a component x counts as
    floor(scale * x), a score is the inner product of two rows, and higher
    scores come first, ties by smaller vec_id.  ``anchors`` selects rows by
    columns ``id`` and ``label``.  An anchor's positives are its first
    ``positives`` other rows of the same label; for each of them come the first
    ``negatives`` rows of other labels whose score is from ``least`` to
    ``most`` percent of the positive's (none if that is below zero).

    Rows without vec_id, label or vector, or with a null or non-finite
    component, take no part; vectors of different lengths don't meet; empty
    vectors score 0 with each other.  Repeated rows are rows of their own: each
    repeated anchor returns its results, and its copies are among its
    positives.  An empty table gives no rows.  Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, scale)
    if index is None:
        return spark.createDataFrame([], _OUT)
    limit = 1 << 62
    everything = F.array(F.struct(F.lit(0).alias("k"), F.lit(-limit).alias("lo"), F.lit(limit).alias("hi")))
    queries = index.rows.where(anchors).select("uid", "id", "label", "vec", F.col("block").alias("own"), everything.alias("windows"))
    queries = stage(queries, "anchors")
    best = stage(search(index, queries, True, positives).select("uid", F.col("rank").alias("k"), "score", "id"), "positives")
    lo, hi = _share(F.col("score"), least, True), _share(F.col("score"), most, False)
    windows = (
        best.select("uid", F.struct("k", lo.alias("lo"), hi.alias("hi")).alias("w"))
        .where("w.lo <= w.hi")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list("w")).alias("windows"))  # as many as there are positives
    )
    asked = stage(queries.drop("windows").join(windows, "uid"), "windows")
    found = search(index, asked, False, negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    named = best.join(queries.select("uid", F.col("id").alias("anchor_id")), "uid")
    return (
        found.join(named, ["uid", "k"])
        .select(
            "anchor_id",
            F.col("id").alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            "negative_id",
            F.col("score").alias("positive_score"),
            "negative_score",
        )
    )
