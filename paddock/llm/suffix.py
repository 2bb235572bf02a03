"""Repeated passages by suffix order of many texts, built column by column.

A 200-byte string that occurs twice has the same minimizer in both places: the
least hash among its 64-byte substrings, the leftmost of equal ones.  Each
occurrence of a minimizer, with the run of 200-byte strings that share it, is a
*piece* of at most 336 bytes.  Only pieces with equal minimizers can hold equal
strings, so pieces meet by minimizer, equal pieces are counted before they
move, and a minimizer that occurs once needs no more work.

Different pieces of one minimizer are sorted by their suffixes.  Each task
takes a bounded collection of pieces and inserts one symbol of each string in
every round, from the last to the first; a symbol is a word of some bytes.  A round reads the collection's
Burrows-Wheeler transform and its array of common prefixes from begin to end
and writes both with the new suffixes inserted: a suffix goes to the place that
the transform's symbol counts give, and its common prefix with a neighbour is
one more than the least one between the last two places of the symbol.  In the
end a 200-byte string is repeated if its suffix shares as much with a
neighbour.  The pieces of a minimizer with too many different ones for one
collection are cut again by longer minimizers, until they fit.  The arrays of a
collection stand for the sequential files of the method: its bound, some
``MOST_PIECES`` pieces of at most 336 bytes, keeps them below a few megabytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.texts import fresh, small_batches, stage, worker_cache

LENGTH = 200
#: Bytes of a substring that can be a minimizer.
SEED_BYTES = 64
#: Pieces that one collection aims at; groups of one minimizer stay whole.
COLLECTION = 192
#: Different pieces of one minimizer that a collection takes; more are cut again by longer minimizers.
MOST_PIECES = 2048
#: Bytes of a text whose minimizers are found at once.
SPAN = 1 << 17
_RANDOM = 20240315


def _constants(n: int) -> tuple[np.ndarray, ...]:
    """Random number of each byte; powers of an odd base and of its inverse."""
    rng = np.random.default_rng(_RANDOM)
    byte = rng.integers(0, 1 << 63, 256, np.uint64)
    base = int(rng.integers(0, 1 << 62)) * 2 + 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return byte, np.cumprod(up), np.cumprod(down)


def minimizers(data: np.ndarray, length: int = LENGTH, seed: int = SEED_BYTES) -> tuple[np.ndarray, ...]:
    """Runs of strings of ``length`` bytes with the same minimizer: first start, number, place and hash of it.

    Hash and choice depend on the bytes only; ties, that is equal upper 44 bits, go to the leftmost.
    """
    starts = len(data) - length + 1
    if starts <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    out = []
    byte, up, down = worker_cache(f"suffix constants {length}", lambda: _constants(SPAN + length))
    for low in range(0, starts, SPAN):
        part = data[low : low + SPAN + length - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[part] * up[: len(part)])])
        h = (sums[seed:] - sums[:-seed]) * down[: len(part) - seed + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        key = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
        width, held = length - seed + 1, 1
        least = key
        while 2 * held <= width:
            least = np.minimum(least[:-held], least[held:])
            held *= 2
        if held < width:
            least = np.minimum(least[: held - width], least[width - held :])
        place = (least & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        number = np.diff(np.concatenate([first, [len(place)]]))
        at = place[first]
        out.append((first + low, number, at + low, h[at]))
    return tuple(np.concatenate(x) for x in zip(*out))


def ranges_to_spans(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of ``length`` bytes at the ascending starts."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > length)
    begins, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(starts) - 1]])
    return [(int(starts[b]), int(starts[e]) + length) for b, e in zip(begins, ends)]


class Collection:
    """Burrows-Wheeler transform and common prefixes of all suffixes of many strings of symbols (from 1).

    ``bwt[k]`` is the symbol before the suffix at place ``k``, 0 at the start of
    a string; ``lcp[k]`` is the common prefix of the suffixes at ``k - 1`` and
    ``k``.  The ends of strings differ, in order of the strings.
    """

    def __init__(self, columns: np.ndarray, sizes: np.ndarray):
        """``columns[j]`` holds each string's symbol ``j + 1`` places from its end, 0 once it has ended, and a row of 0 at last."""
        m = len(sizes)
        self.sizes = sizes
        self.bwt, self.lcp = columns[0].copy(), np.zeros(m, np.int32)
        place = np.arange(m)
        for j in range(1, len(columns)):
            live = np.flatnonzero(sizes >= j)
            place[live] = self._insert(place[live], columns[j][live], m)

    def _order(self, m: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places by (symbol, place); for each place, that of the suffix one symbol longer; how many have no symbol."""
        order = np.argsort(self.bwt, kind="stable")
        ended = int(np.count_nonzero(self.bwt == 0))
        longer = np.empty(len(order), np.int32)
        longer[order] = np.arange(m - ended, m - ended + len(order), dtype=np.int32)
        return order, longer, ended

    def _insert(self, place: np.ndarray, symbols: np.ndarray, m: int) -> np.ndarray:
        """Insert, for the suffix at each place, the suffix one symbol longer, before which ``symbols`` stand."""
        order, longer, ended = self._order(m)
        at = longer[place]
        index = at - m + ended
        mine = self.bwt[place]
        zeros = np.cumsum(self.lcp == 0)
        prefix = []
        for step in (-1, 1):  # the neighbour before and after, if it begins with the same symbol
            near = index + step
            inside = (near >= ended) & (near < len(order))
            other = order[np.clip(near, 0, len(order) - 1)]
            same = inside & (self.bwt[other] == mine)
            low, high = (other, place) if step < 0 else (place, other)
            # The least of lcp[low + 1 .. high] of each pair: 0 if there is one, else from one gathered array.
            size = np.where(same & (zeros[high] == zeros[low]), high - low, 0)
            keep = np.flatnonzero(size)
            least = same.astype(np.int32)
            if len(keep):
                n = size[keep]
                begin = np.cumsum(n) - n
                gathered = np.arange(int(n.sum())) - np.repeat(begin - low[keep] - 1, n)
                least[keep] = np.minimum.reduceat(self.lcp[gathered], begin) + 1
            prefix.append(least)
        total = len(self.bwt) + len(place)
        old = np.ones(total, bool)
        old[at] = False
        bwt, lcp = np.empty(total, self.bwt.dtype), np.empty(total, np.int32)
        bwt[old], lcp[old] = self.bwt, self.lcp
        bwt[at], lcp[at] = symbols, prefix[0]
        after = at + 1
        inside = after < total
        lcp[after[inside]] = prefix[1][inside]
        self.bwt, self.lcp = bwt, lcp
        return at

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """String and start, in symbols, of every substring of ``length`` symbols that stands elsewhere too."""
        m = len(self.sizes)
        _, longer, _ = self._order(m)
        shared = np.maximum(self.lcp, np.append(self.lcp[1:], 0)) >= length
        strings, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        place, live = np.arange(m), np.arange(m)
        for j in range(1, int(self.sizes.max(initial=0)) + 1):
            keep = self.sizes[live] >= j
            live, place = live[keep], longer[place[keep]]
            if j >= length:
                hits = live[shared[place]]
                strings.append(hits)
                starts.append(self.sizes[hits] - j)
        return np.concatenate(strings), np.concatenate(starts)


def repeated_starts(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the piece and start of every string of ``length`` bytes that stands at another place too, in order.

    A symbol is a word of ``k`` bytes, where ``k`` divides the length, and a
    piece makes ``k`` strings, one for each place its words can begin at: as
    many suffixes as it has bytes, in a ``k``-th of the rounds.
    """
    k = next(x for x in (8, 4, 2, 1) if length % x == 0)
    data = np.frombuffer(b"".join(pieces) + bytes(k), np.uint8)
    words = np.zeros(len(data) - k + 1, np.uint64)
    for i in range(k):
        words |= data[i : len(words) + i].astype(np.uint64) << np.uint64(8 * i)
    codes = np.unique(words, return_inverse=True)[1] + 1  # which word comes first doesn't matter
    lengths = np.array([len(p) for p in pieces], np.int64)
    begins = np.repeat(np.cumsum(lengths) - lengths, k) + np.tile(np.arange(k), len(pieces))
    sizes = np.maximum(0, (np.repeat(lengths, k) - np.tile(np.arange(k), len(pieces))) // k)
    back = np.arange(int(sizes.max(initial=0)) + 1)[:, None]
    inside = back < sizes
    columns = np.where(inside, codes[np.where(inside, begins + k * (sizes - 1 - back), 0)], 0)
    columns = columns.astype(np.uint16 if codes.max(initial=0) < 65_536 else np.uint32)
    string, start = Collection(columns, sizes).repeated(length // k)
    piece, start = string // k, string % k + k * start
    order = np.lexsort((start, piece))
    return piece[order], start[order]

_PIECES = "t1 long, t2 long, h long, g long, a long, n int"


def _text_key(data: bytes) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(data)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _pieces(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Per piece: key of its text, hashes of minimizer and piece, first start and number of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def batch_of(parts):
            cols = [np.concatenate(x) for x in zip(*parts)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, types)], ["t1", "t2", "h", "g", "a", "n"])

        for batch in batches:
            parts, held = [], 0
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                if len(data) < length:
                    continue
                first, number, place, h = minimizers(np.frombuffer(data, np.uint8), length, seed)
                t1, t2 = _text_key(data)
                hashes = [
                    xxhash.xxh3_64_intdigest(data[a : a + n + length - 1], p - a)
                    for a, n, p in zip(first.tolist(), number.tolist(), place.tolist())
                ]
                k = len(first)
                parts.append((np.full(k, t1), np.full(k, t2), h.view(np.int64), np.array(hashes, np.uint64).view(np.int64), first, number))
                held += k
                if held > 100_000:
                    yield batch_of(parts)
                    parts, held = [], 0
            if parts:
                yield batch_of(parts)

    return docs.select("text").mapInArrow(run, _PIECES)


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, g, data) of the pieces wanted (t1, t2, h, g, a, n), cut from their texts."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            both = [_text_key((t or "").encode()) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*both)], texts], ["t1", "t2", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g, data = [], [], []
            for text, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text.encode()
                for p in pieces:
                    h.append(p["h"])
                    g.append(p["g"])
                    data.append(text[p["a"] : p["a"] + p["n"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(data, pa.binary())], ["h", "g", "data"])

    # The pieces of one text are no more than its bytes.
    of_text = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "g", "a", "n")).alias("pieces"))
    keyed = docs.select("text").where(F.octet_length("text") >= length).mapInArrow(keys, "t1 long, t2 long, text string")
    return keyed.join(of_text, ["t1", "t2"]).select("text", "pieces").mapInArrow(cut, "h long, g long, data binary").dropDuplicates(["h", "g"])


def _sorted_collections(pieces: DataFrame, length: int) -> DataFrame:
    """(h, g, starts): strings of each piece that another piece holds too; (h, data) come whole by h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def out():
            piece, start = repeated_starts([x[2] for x in held], length)
            found, first = np.unique(piece, return_index=True)
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([held[i][c] for i in found], pa.int64()) for c in (0, 1)],
                        pa.ListArray.from_arrays(np.append(first, len(piece)).astype(np.int32), start.astype(np.int32)),
                    ],
                    ["h", "g", "starts"],
                )
            held.clear()

        for batch in batches:
            for h, g, data in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if len(held) >= COLLECTION and held[-1][0] != h:
                    yield from out()
                held.append((h, g, data))
        if held:
            yield from out()

    return pieces.select("h", "g", "data").repartition("h").sortWithinPartitions("h", "g").mapInArrow(run, "h long, g long, starts array<int>")


def _verdicts(kinds: DataFrame, partly: DataFrame) -> DataFrame:
    """(h, g, starts) of the kinds of pieces that hold repeats: null starts for all strings of a kind that occurs twice."""
    return (
        kinds.select("h", "g", (F.col("c") > 1).alias("whole"))
        .join(partly, ["h", "g"], "left")
        .where("whole OR starts IS NOT NULL")
        .select("h", "g", F.when(~F.col("whole"), F.col("starts")).alias("starts"))
    )


def _shared_strings(pieces: DataFrame, length: int, seed: int) -> DataFrame:
    """(h, g, starts): strings of each of the pieces (h, g, d, data) that another one of the same minimizer holds too.

    Pieces are sorted in collections; those of a minimizer that has too many
    for one are cut again by longer minimizers first.
    """
    sorted_ones = _sorted_collections(pieces.where(F.col("d") <= MOST_PIECES), length)
    hot = pieces.where(F.col("d") > MOST_PIECES)
    return sorted_ones if hot.isEmpty() else sorted_ones.union(_recut(hot, length, min(2 * seed, length)))


def _recut(pieces: DataFrame, length: int, seed: int) -> DataFrame:
    """The same for pieces of hot minimizers, by pieces of these pieces with minimizers of ``seed`` bytes.

    Equal strings have equal minimizers of any size, so they meet again, in
    smaller groups; with ``seed`` as long as the strings only equal ones meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for h, g, data in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                found = minimizers(np.frombuffer(data, np.uint8), length, seed)
                for a, n, p, x in zip(*[c.tolist() for c in found]):
                    part = data[a : a + n + length - 1]
                    key = xxhash.xxh3_64_intdigest(h.to_bytes(8, "little", signed=True) + x.to_bytes(8, "little"))
                    rows.append((h, g, a, n, key - (1 << 63), xxhash.xxh3_64_intdigest(part, p - a) - (1 << 63), part))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                names = ["h0", "g0", "a", "n", "h", "g", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    cut = pieces.select("h", "g", "data").mapInArrow(run, "h0 long, g0 long, a int, n int, h long, g long, data binary")
    cut = stage(cut, "recut")
    kinds = cut.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), F.min("data").alias("data"))
    groups = kinds.groupBy("h").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("d")).where("all > 1").select("h", "d")
    kinds = stage(kinds.join(groups, "h"), "kinds")
    partly = stage(_shared_strings(kinds.where("d > 1"), length, seed), "partly")
    whole = F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)
    starts = F.when(F.col("starts").isNull(), whole).otherwise(F.transform("starts", lambda x: x + F.col("a")))
    found = cut.select("h0", "g0", "a", "n", "h", "g").join(_verdicts(kinds, partly), ["h", "g"]).select("h0", "g0", starts.alias("starts"))
    # At most as many starts as a piece has.
    joined = F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts"))))
    return found.groupBy(F.col("h0").alias("h"), F.col("g0").alias("g")).agg(joined.alias("starts"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES) -> DataFrame:
    """(t1, t2, starts) for each different text with repeats: the key of ``_text_key`` and
    runs [first start, number] of strings of ``length`` bytes that stand anywhere else too."""
    small_batches(docs.sparkSession)
    pieces = stage(_pieces(docs, length, seed), "pieces")
    # Of a minimizer that occurs once only the hash moves.
    often = pieces.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    shared = stage(pieces.join(often, "h", "left_semi"), "shared")
    kinds = shared.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("t1", "t2", "a", "n")).alias("one"))
    kinds = stage(kinds, "kinds")
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    differing = stage(kinds.join(groups, "h").select("h", "g", "d", "one.*"), "differing")
    cut = stage(_with_bytes(docs, differing.drop("d"), length).join(differing.select("h", "g", "d"), ["h", "g"]), "cut")
    partly = stage(_shared_strings(cut, length, seed), "partly")
    verdict = _verdicts(kinds, partly)
    found = shared.join(verdict, ["h", "g"]).select("t1", "t2", F.struct("a", "n", "starts").alias("p"))
    # The runs of one text are no more than its bytes; equal texts give the same runs.
    return found.groupBy("t1", "t2").agg(F.collect_set("p").alias("pieces"))


def _repeated(pieces: pa.ListArray, length: int) -> list[list[tuple[int, int]]]:
    """For each row of a batch the runs of repeated bytes; ``pieces``: lists of (a, n, starts)."""
    flat = pieces.flatten()
    row = np.repeat(np.arange(len(pieces)), np.diff(pieces.offsets.to_numpy()) * pieces.is_valid().to_numpy(zero_copy_only=False))
    a, n, lists = (flat.field(i) for i in range(3))
    a, n = a.to_numpy(), n.to_numpy().astype(np.int64)
    whole = lists.is_null().to_numpy(zero_copy_only=False)
    some = lists.filter(pa.array(~whole))
    size = np.diff(some.offsets.to_numpy())
    first = np.cumsum(n[whole]) - n[whole]
    starts = np.concatenate([
        np.arange(int(n[whole].sum())) - np.repeat(first - a[whole], n[whole]),
        some.flatten().to_numpy().astype(np.int64) + np.repeat(a[~whole], size),
    ])
    rows = np.concatenate([np.repeat(row[whole], n[whole]), np.repeat(row[~whole], size)])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    cuts = np.searchsorted(rows, np.arange(len(pieces) + 1))
    return [ranges_to_spans(starts[x:y], length) for x, y in zip(cuts, cuts[1:])]


def _with_spans(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """``docs`` with the pieces of their texts in a last column, null if a text has no repeats."""
    k1, k2, last = fresh(docs, "_t1", "_t2", "_pieces")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_text_key((t or "").encode()) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            t1, t2 = ([k[i] for k in both] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t1, pa.int64()), pa.array(t2, pa.int64())], [*batch.schema.names, k1, k2])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    keyed = docs.mapInArrow(keys, f"{schema}, `{k1}` long, `{k2}` long")
    spans = repeated_spans(docs, length, seed).select(F.col("t1").alias(k1), F.col("t2").alias(k2), F.col("pieces").alias(last))
    return keyed.join(spans, [k1, k2], "left").drop(k1, k2)


def removal_report(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes left by removing repeats.

    A byte goes if a string of ``length`` bytes covers it that starts anywhere
    else too, in the same text or another; all copies go.  Texts are UTF-8; a
    null text is empty, and texts shorter than ``length`` lose nothing.
    Repeated rows repeat their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            found = _repeated(batch.column(2), length)
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found):
                data = (text or "").encode()
                left, at = hashlib.sha256(), 0
                for low, high in spans:
                    left.update(data[at:low])
                    at = high
                left.update(data[at:])
                out.append((doc_id, len(data), sum(h - x for x, h in spans), len(spans), left.hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (
        _with_spans(slim, length, seed)
        .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; a character goes if all its bytes do.

    All rows and columns stay; a null text stays null, and ``n_chars``, if there
    is such a column, is set to the new number of characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.schema.get_field_index("text"), batch.num_columns - 1
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), _repeated(batch.column(n), length)):
                if spans:
                    data, parts, done = text.encode(), [], 0
                    for low, high in spans:
                        while low < high and low and data[low] & 0xC0 == 0x80:  # within a character: it stays
                            low += 1
                        while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
                            high -= 1
                        parts.append(data[done:low])
                        done = high
                    text = b"".join([*parts, data[done:]]).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    spans = _with_spans(docs, length, seed)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = spans.mapInArrow(run, schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
