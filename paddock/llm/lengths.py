"""Token counts from an exact histogram of encoded lengths.

Documents are counted per encoded length.  Sums over the longer lengths then
answer, for every context limit, how many documents go beyond it, how many
tokens they hold and how many tokens remain when each is cut there.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.texts import BETWEEN_WORDS, CACHE_ENTRIES, ChunkCache, small_batches, stage, worker_cache

#: Lengths that one task orders; the number of blocks is the longest length over this.
BLOCK = 4096
#: Fixed value: marks that may stand behind a word, all ASCII but letters, digits and space.
MARKS = string.punctuation
#: New chunks encoded in one call, and in one text of it.
JOINED, IN_TEXT = 1000, 50
#: Chunks in a generation of the cache; their ids take little room.
CHUNKS = 700_000


class ChunkEncoder:
    """A byte-level tokenizer of the ``tokenizers`` library that keeps the ids of chunks it has met, as 4-byte numbers.

    As with the library's own call, the name of an added token in a text, such as ``<|endoftext|>``, gives that
    token's id; texts are cut there first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {name: np.array([i], "<u4").tobytes() for name, i in added.items()}
        self.names = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # A character of a token's name is a byte of its text.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, i in vocabulary.items():
            self.sizes[i] = len(name)
        self.first, self.later, self.marks = ChunkCache(), ChunkCache(CHUNKS), {}

    def _learn_heads(self, new: list[str]) -> None:
        for chunk, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.first.found[chunk] = np.array(found.ids, "<u4").tobytes()

    def _learn_tails(self, new: list[str]) -> None:
        """Learn chunks that don't end in white space; letters and the marks behind them never merge, so words are learnt once."""
        found, before = self.later.found, self.later.before
        alone, marked = [], []
        for chunk in new:
            if not chunk.isalpha() and (word := chunk.rstrip(MARKS)).isalpha() and len(word) < len(chunk):
                marked.append((chunk, word, chunk[len(word) :]))
            else:
                alone.append(chunk)
        words = {word for _, word, _ in marked if word not in found}.difference(alone)
        for word in words & before.keys():
            found[word] = before[word]
        self._encode_tails(alone + [w for w in words if w not in found])
        for chunk, word, marks in marked:
            if marks not in self.marks:
                if len(self.marks) >= CACHE_ENTRIES:
                    self.marks.clear()
                (ids,) = self.tokenizer.encode_batch_fast([marks], add_special_tokens=False)
                self.marks[marks] = np.array(ids.ids, "<u4").tobytes()
            found[chunk] = found[word] + self.marks[marks]

    def _encode_tails(self, new: list[str]) -> None:
        """Encode many chunks as a few texts, each chunk with the space before it, and part the ids by their bytes."""
        for low in range(0, len(new), JOINED):
            part = new[low : low + JOINED]
            texts = [" " + " ".join(part[i : i + IN_TEXT]) for i in range(0, len(part), IN_TEXT)]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.array([i for f in found for i in f.ids], "<u4")
            ends = np.cumsum([len(c.encode()) + 1 for c in part])
            cuts = [0, *(4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()]
            data = ids.tobytes()
            self.later.found.update(zip(part, [data[a:b] for a, b in zip(cuts, cuts[1:])]))

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        named = [i for i, t in enumerate(texts) if any(name in t for name in self.added)]
        if not named:
            return self._packed(texts)
        parts = [self.names.split(texts[i]) for i in named]
        plain = list(texts)
        for i, p in zip(named, parts):
            plain[i] = p[0]
        rest = [x for p in parts for x in p[2::2]]
        found = self._packed(plain + rest)
        out, more = found[: len(texts)], iter(found[len(texts) :])
        for i, p in zip(named, parts):
            out[i] += b"".join([self.added[name] + next(more) for name in p[1::2]])
        return out

    def _packed(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words, known, codes, begins, heads, tails = self._coded(cut)
        order = None
        # Caches hold no rough chunks, so only new ones can come from a text with other white space at a space.
        if rough := {c for new in (heads, tails) for c in new if not c or c.strip() != c}:
            hit = np.array([w in rough for w in words])[codes]
            again = np.add.reduceat(hit, begins[:-1], dtype=np.int64) > 0
            recut = [BETWEEN_WORDS.split(texts[i]) for i in np.flatnonzero(again)]
            cut = pa.concat_arrays([cut.filter(pa.array(~again)), pa.array(recut, cut.type)])
            order = np.argsort(np.argsort(again, kind="stable"), kind="stable")
            words, known, codes, begins, heads, tails = self._coded(cut)
        self._learn_heads(heads)
        # White space at a chunk's end would run into the space of the next.
        rough = {c for c in tails if c.rstrip() != c}
        self._learn_tails([c for c in tails if c not in rough] if rough else tails)
        for chunk in rough:
            self._encode_tails([chunk])
        # Ids of the different chunks, then those of the texts' first ones; the codes say how they follow each other.
        first, later = self.first.found, self.later.found
        found = [later.get(w, b"") if ids is None else ids for w, ids in zip(words, known)] + [first[words[c]] for c in codes[begins[:-1]].tolist()]
        codes[begins[:-1]] = len(words) + np.arange(len(texts))
        joined = pa.array(found, pa.large_binary()).take(pa.array(codes))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64)[begins].tolist()
        view = memoryview(data) if data else b""
        out = [bytes(view[a:b]) for a, b in zip(ends, ends[1:])]
        self.first.forget(heads)
        self.later.forget(tails)
        return out if order is None else [out[i] for i in order.tolist()]

    def _coded(self, cut: pa.ListArray) -> tuple[list[str], list[bytes | None], np.ndarray, np.ndarray, list[str], list[str]]:
        """The different chunks of texts and the ids kept for them; for all chunks their numbers in these, and where each
        text begins; the chunks that begin a text, and the others, that the caches lack."""
        coded = cut.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        begins = cut.offsets.to_numpy()
        later = np.ones(len(codes), bool)
        later[begins[:-1]] = False
        inside = np.zeros(len(words), bool)
        inside[codes[later]] = True
        known = list(map(self.later.found.get, words))
        heads = self.first.lacking({words[c] for c in codes[begins[:-1]].tolist()})
        tails = self.later.lacking([w for w, ids, x in zip(words, known, inside.tolist()) if x and ids is None])
        return words, known, codes, begins, heads, tails


def chunk_encoder(path: str) -> ChunkEncoder:
    # A task has one core; the library's own threads cost more CPU time than they save.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_cache(f"chunks {path}", lambda: ChunkEncoder(path))


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens of every row's ``text`` without special tokens; null and empty texts have none."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        for batch in batches:
            lengths = [len(p) // 4 for p in encoder.packed([t or "" for t in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def length_table(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, with suffix sums.

    ``n_docs`` documents have exactly ``n_tokens`` tokens; ``docs_at_least``
    and ``tokens_at_least`` sum over this and all longer lengths;
    ``tokens_cut`` is what remains of the whole corpus when every document is
    cut to ``n_tokens``; ``share_at_most`` is the share of documents that are
    no longer.  Rows without a length are left out; an empty table gives no
    rows.  Lengths are ordered in blocks, and only block totals meet in one task.
    """
    counted = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    # Written, as two branches read the counts and the texts are to be encoded once.
    counted = stage(counted.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)), "counted")
    held = F.col("n_docs") * F.col("n_tokens")
    after = Window.partitionBy(F.lit(0)).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        counted.groupBy("_block")
        .agg(F.sum("n_docs").alias("_docs"), F.sum(held).alias("_tokens"))
        .select(
            "_block",
            F.coalesce(F.sum("_docs").over(after), F.lit(0)).alias("_docs_after"),
            F.coalesce(F.sum("_tokens").over(after), F.lit(0)).alias("_tokens_after"),
            F.sum("_docs").over(Window.partitionBy(F.lit(0))).alias("_all_docs"),
            F.sum("_tokens").over(Window.partitionBy(F.lit(0))).alias("_all_tokens"),
        )
    )
    down = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc())
    at_least = F.sum("n_docs").over(down) + F.col("_docs_after")
    tokens_at_least = F.sum(held).over(down) + F.col("_tokens_after")
    return (
        counted.join(blocks, "_block")
        .withColumns({"docs_at_least": at_least, "tokens_at_least": tokens_at_least})
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("_all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("tokens_cut"),
            ((F.col("_all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_all_docs")).alias("share_at_most"),
        )
    )


def answers(table: DataFrame, limits: list[int], shares: list[float]) -> DataFrame:
    """Totals at context limits and quantiles of the length, all from a table of ``length_table``.

    Rows (kind, at, value): ``docs_over``, ``tokens_kept`` for each limit, and
    ``quantile``: the least length that at least the share of documents doesn't exceed.
    """
    longer, n, docs = F.col("n_tokens") > F.lit(0), F.col("n_tokens"), F.col("n_docs")
    picks = [
        F.struct(F.lit(kind).alias("kind"), F.lit(float(at)).alias("at"), value.cast("long").alias("value"))
        for at in limits
        for kind, value in (
            ("docs_over", F.coalesce(F.sum(F.when(n > at, docs)), F.lit(0))),
            ("tokens_kept", F.coalesce(F.sum(F.when(longer, F.least(n, F.lit(at)) * docs)), F.lit(0))),
        )
    ] + [
        F.struct(F.lit("quantile").alias("kind"), F.lit(float(s)).alias("at"), F.min(F.when(F.col("share_at_most") >= s, n)).alias("value"))
        for s in shares
    ]
    return table.agg(F.array(*picks).alias("_all")).select(F.inline("_all"))
