"""Benchmark decontamination by a broadcast hash set of word windows.

The windows of a benchmark are hashed into a table that every task holds.
Documents are scanned once: their words become numbers of the benchmark's
words, windows of known words are hashed, looked up, and each hit is verified
word by word.  Words inside hits form spans, which can be cut out, or the
documents that hold any can be dropped.

The table has a bound: a benchmark is dealt into parts of about ``PART_BYTES``
of text, and the documents are scanned once for each part, the spans of one
scan being handed to the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.texts import fresh, small_batches, stage

#: Words in a window; an item of fewer is one window.
WINDOW = 10
#: Text of benchmark items that one table holds, in bytes; an item is never parted.
PART_BYTES = 4 << 20

_SPACE = 0x20
_KEPT = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
_TABLE = bytes([b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else _SPACE for b in _KEPT])

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def normalised(text: str | None) -> bytes:
    """Lower-cased (A-Z only) UTF-8, every byte outside words a space."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE)


def _hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` values, modulo 2^64."""
    out = np.zeros(len(values) - size + 1, np.uint64)
    for j in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += values[j : len(values) - size + 1 + j]
    return out


class WindowTable:
    """Windows of benchmark items by size: sorted hashes, a filter in front of them, their words and their items."""

    def __init__(self, items: Sequence[tuple[str, str | None]], window: int = WINDOW):
        texts = [(name, normalised(t).split()) for name, t in items]
        self.codes = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        # A number for each word; 0 is the one for words that no item has.
        self.values = np.random.default_rng(12).integers(0, 1 << 64, len(self.codes) + 1, np.uint64)
        self.stream = np.array([self.codes[w] for _, ws in texts for w in ws], np.int32)
        starts, owners = {}, {}
        at = 0
        for name, ws in texts:
            if ws:
                size = min(window, len(ws))
                many = len(ws) - size + 1
                starts.setdefault(size, []).append(np.arange(at, at + many))
                owners.setdefault(size, []).append(np.full(many, place[name]))
            at += len(ws)
        self.sizes = {size: self._indexed(size, np.concatenate(starts[size]), np.concatenate(owners[size])) for size in starts}

    def _indexed(self, size: int, starts: np.ndarray, owners: np.ndarray) -> tuple:
        """Distinct windows as (hashes, first words, filter, bounds of their items, items)."""
        hashes = _hashes(self.values[self.stream], size)[starts]
        words = self.stream[starts[:, None] + np.arange(size)]
        order = np.lexsort((owners, *words.T[::-1], hashes))
        hashes, starts, owners, words = hashes[order], starts[order], owners[order], words[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (words[1:] != words[:-1]).any(axis=1)
        own = new.copy()
        own[1:] |= owners[1:] != owners[:-1]
        group = np.cumsum(new) - 1
        bounds = np.searchsorted(group[own], np.arange(new.sum() + 1))
        bits = max(10, int(np.ceil(np.log2(new.sum() + 1))) + 4)
        sieve = np.zeros(1 << bits, bool)
        sieve[hashes >> np.uint64(64 - bits)] = True
        return hashes[new], starts[new], sieve, np.uint64(64 - bits), bounds, owners[own]

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, windows) of verified hits in a stream of word numbers; 0 belongs to no window."""
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        values = self.values[codes]
        for size, (hashes, starts, sieve, shift, _, _) in self.sizes.items():
            if len(codes) < size:
                continue
            found = _hashes(values, size)
            at = np.flatnonzero((unknown[size:] == unknown[:-size]) & sieve[found >> shift])
            low, high = (np.searchsorted(hashes, found[at], side) for side in ("left", "right"))
            while len(at):  # windows of equal hash one after the other; nearly always one
                at, low, high = (x[low < high] for x in (at, low, high))
                same = (codes[at[:, None] + np.arange(size)] == self.stream[starts[low][:, None] + np.arange(size)]).all(axis=1)
                if same.any():
                    yield size, at[same], low[same]
                at, low, high = at[~same], low[~same] + 1, high[~same]

    def owners(self, size: int, window: int) -> np.ndarray:
        bounds, owners = self.sizes[size][4:]
        return owners[bounds[window] : bounds[window + 1]]

    def scan(self, texts: Sequence[str | None], spans: Sequence[list], items: Sequence[list]) -> tuple[list[int], list[list], list[list]]:
        """Numbers of words, spans of hit words and items of each text, added to those found before."""
        split = [normalised(t).split() for t in texts]
        counts = np.array([len(ws) for ws in split], np.int64)
        first = np.concatenate([[0], np.cumsum(counts + 1)])  # one empty place after each text
        codes = np.fromiter(map(self.codes.get, chain.from_iterable(chain(ws, (b"",)) for ws in split), repeat(0)), np.int32, int(first[-1]))
        edge = np.zeros(len(codes) + 1, np.int64)
        for i, before in enumerate(spans):
            for span in before:
                edge[first[i] + span["start"]] += 1
                edge[first[i] + span["end"]] -= 1
        named = [set(x) for x in items]
        for size, at, window in self.matches(codes):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            text = np.searchsorted(first, at, "right") - 1
            for i, w in np.unique(np.stack([text, window], axis=1), axis=0):
                named[i].update(self.names[o] for o in self.owners(size, w))
        hit = np.cumsum(edge) > 0
        turns = np.flatnonzero(np.diff(hit, prepend=False))
        out: list[list] = [[] for _ in split]
        for low, high in zip(turns[::2], turns[1::2]):
            i = int(np.searchsorted(first, low, "right")) - 1
            out[i].append({"start": int(low - first[i]), "end": int(high - first[i])})
        return counts.tolist(), out, [sorted(x) for x in named]


def without_spans(text: str | None, spans: list[dict[str, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(data.translate(_TABLE), np.uint8) != _SPACE
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2)
    cuts = [(int(edges[s["start"], 0]), int(edges[s["end"] - 1, 1])) for s in spans]
    kept = [data[a:b] for a, b in zip([0, *[e for _, e in cuts]], [*[s for s, _ in cuts], len(data)])]
    return b"".join(kept).decode("utf-8", "surrogatepass")


def _parts(benchmark: DataFrame) -> DataFrame:
    """(part, name, text): items dealt into parts of about ``PART_BYTES``; each part but a single item is within twice that."""
    items = stage(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text"), "items")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    parts = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // PART_BYTES))
    while True:
        dealt = items.withColumn("part", F.pmod(F.xxhash64("name", "text"), F.lit(parts)))
        over = dealt.groupBy("part").agg(F.sum(size).alias("bytes"), F.count_distinct("text").alias("n"))
        if over.where((F.col("bytes") > 2 * PART_BYTES) & (F.col("n") > 1)).isEmpty():
            return dealt.dropDuplicates(["name", "text"])
        parts *= 2


def find(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] | None = None, window: int = WINDOW, cut: bool = False) -> DataFrame:
    """The documents with ``n_words``, ``spans`` and ``items``, named otherwise if ``docs`` has such columns.

    ``docs`` has text, ``benchmark`` (item_id, text).  Words are runs of ASCII
    letters, digits and any other characters beyond ASCII, A-Z lower-cased.  A
    window is ``window`` consecutive words of an item; an item of fewer words
    is one window.  ``spans`` are the maximal runs [start, end) of document
    words inside occurring windows, ``items`` the sorted ids of items with such
    windows.  Null and empty texts have no words and no spans; items without
    words find nothing; items without id share the empty id; repeated rows are
    scanned alike.  ``keep`` names the columns to return, all by default.
    ``cut`` replaces the text by what is outside the spans.
    """
    small_batches(docs.sparkSession)
    keep = list(docs.columns if keep is None else keep)
    n_words, spans, items = names = fresh(docs.select(*keep), "n_words", "spans", "items")
    text, own_spans, own_items = fresh(docs, "_text", "_spans", "_items")
    dealt = _parts(benchmark)
    parts = [r["part"] for r in dealt.select("part").distinct().orderBy("part").collect()] or [None]
    empty = F.array().cast("array<struct<start: long, end: long>>")
    rows = docs.select(*keep, F.col("text").alias(text), empty.alias(own_spans), F.array().cast("array<string>").alias(own_items))
    context = docs.sparkSession.sparkContext

    def scanned(rows: DataFrame, part: Any, last: bool) -> DataFrame:
        held = [] if part is None else [(r["name"], r["text"]) for r in dealt.where(F.col("part") == part).collect()]
        table = context.broadcast(WindowTable(held, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, before, named = (batch.column(len(keep) + i).to_pylist() for i in range(3))
                counts, found, hit = table.value.scan(texts, before, named)
                columns = dict(zip(keep, batch.columns))
                if last and cut and "text" in columns:
                    columns["text"] = pa.array([without_spans(t, s) for t, s in zip(texts, found)], pa.string())
                new = [pa.array(counts, pa.int64()), pa.array(found, _SPANS), pa.array(hit, pa.list_(pa.string()))]
                if last:
                    yield pa.RecordBatch.from_arrays([*columns.values(), *new], [*keep, *names])
                else:
                    yield pa.RecordBatch.from_arrays([*columns.values(), batch.column(len(keep)), *new[1:]], batch.schema.names)

        if not last:
            return stage(rows.mapInArrow(run, rows.schema), "scanned")
        kinds = docs.select(*keep).schema.fields
        added = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), rows.schema[own_spans].dataType, rows.schema[own_items].dataType))]
        return rows.mapInArrow(run, T.StructType([*kinds, *added]))

    for part in parts[:-1]:
        rows = scanned(rows, part, False)
    return scanned(rows, parts[-1], True)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs."""
    found = find(docs, benchmark, window=window)
    return found.where(F.size(found.columns[-2]) == 0).select(*docs.columns)


def without_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, their texts without the spans in which windows of items occur."""
    return find(docs, benchmark, window=window, cut=True).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (their sorted ids, comma-joined), contaminated."""
    found = find(docs, benchmark, keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
