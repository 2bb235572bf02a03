"""Language identification by unigram models that sum over all segmentations.

Each language gives every piece of a fixed public vocabulary a probability.  A
word's probability is the sum, over all ways to cut it into pieces, of the
product of their probabilities, which the forward algorithm adds up from left
to right.  Words are marked at their start and pieces never cross words, so a
text's log-likelihood is the sum over its words.  The probabilities are learned
by expectation-maximisation: forward and backward sums give the expected number
of times each piece is used in labelled texts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.texts import CACHE_ENTRIES, rows_of, small_batches, stage, worker_cache

#: Fixed mark of the vocabulary: the start of a word.
WORD_START = "▁"
#: Pieces longer than this aren't used.
LONGEST_PIECE = 16
#: Words are cut into parts of this many letters: junk takes linear time, and no product of probabilities vanishes.
LONGEST_WORD = 32
#: Rounds of expectation-maximisation.
ROUNDS = 2
#: Labelled documents learned from at most: those with the smallest hashes of doc_id.
TRAINING_DOCS = 10_000
#: Expected uses that each piece gets beforehand.
PRIOR = 0.1
#: Probability of a letter that no piece covers, alike in all languages.
UNKNOWN = 1e-6
UNDETERMINED = "und"
#: Words whose sums are computed together.
BLOCK_WORDS = 4000

_LETTERS = re.compile(r"[^\W\d_]+")


class Model:
    """Languages, pieces and the probability of each piece (row) in each language (column); the last row is UNKNOWN."""

    def __init__(self, langs: list[str], pieces: list[str], table: np.ndarray):
        self.langs, self.index = langs, {p: i for i, p in enumerate(pieces)}
        self.table = np.vstack([table, np.full((1, max(1, len(langs))), UNKNOWN)])
        self.sizes = np.array([*map(len, pieces), 1])
        self._finder = None

    def finder(self):
        """An automaton that finds all pieces in a string; built where it is used, as it doesn't travel."""
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for piece, i in self.index.items():
                self._finder.add_word(piece, i)
            self._finder.make_automaton()
        return self._finder

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_finder": None}


def vocabulary(path: str) -> list[str]:
    """Pieces of a SentencePiece model without control and byte pieces: a bounded list."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return [p for p in map(model.id_to_piece, plain) if len(p) <= LONGEST_PIECE]


def text_words(text: str) -> list[str]:
    """Lower-cased runs of letters, long ones in parts."""
    found = _LETTERS.findall(text.lower())
    if max(map(len, found), default=0) > LONGEST_WORD:
        found = [w[i : i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


def arcs(words: Sequence[str], model: Model) -> list[tuple[np.ndarray, ...]]:
    """For each start, the pieces that occur there in the marked words: numbers of word, end and piece.

    A letter that no piece covers is an arc of its own, with the last row of the model's table.
    """
    marked = [WORD_START + w for w in words]
    sizes = np.array([len(w) for w in marked])
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    # One pass over all words; no piece holds the mark between them.
    found = np.fromiter((x for at, piece in model.finder().iter("\n".join(marked)) for x in (at, piece)), np.int64).reshape(-1, 2)
    last, piece = found[:, 0], found[:, 1]
    covered = np.zeros(int(sizes.sum()) + len(words), bool)
    covered[last[model.sizes[piece] == 1]] = True
    covered[begins[1:] - 1] = True
    bare = np.flatnonzero(~covered[: len(covered) - 1])
    last, piece = np.concatenate([last, bare]), np.concatenate([piece, np.full(len(bare), len(model.index))])
    w = np.searchsorted(begins, last, "right") - 1
    end = last - begins[w] + 1
    start = end - model.sizes[piece]
    order = np.argsort(start, kind="stable")
    w, end, piece, start = w[order], end[order], piece[order], start[order]
    cuts = np.searchsorted(start, np.arange(LONGEST_WORD + 2))
    return [(w[a:b], end[a:b], piece[a:b]) for a, b in zip(cuts, cuts[1:])]


def forward(words: Sequence[str], model: Model) -> np.ndarray:
    """Log-probability of every word (row) in every language (column), over all segmentations."""
    out = np.zeros((len(words), model.table.shape[1]))
    for low in range(0, len(words), BLOCK_WORDS):
        block = words[low : low + BLOCK_WORDS]
        ends = np.array([len(w) + 1 for w in block])
        sums = np.zeros((len(block), LONGEST_WORD + 2, model.table.shape[1]))
        sums[:, 0] = 1.0
        for start, (w, end, piece) in enumerate(arcs(block, model)):
            # A word has one arc at most from here to each end, so no place is met twice.
            sums[w, end] += sums[w, start] * model.table[piece]
        out[low : low + BLOCK_WORDS] = np.log(sums[np.arange(len(block)), ends])
    return out


def expected_uses(words: Sequence[str], langs: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    """Table of expected uses of each piece by language, for words of given languages and counts."""
    used = np.zeros_like(model.table)
    for low in range(0, len(words), BLOCK_WORDS):
        block = words[low : low + BLOCK_WORDS]
        lang, count = langs[low : low + BLOCK_WORDS], counts[low : low + BLOCK_WORDS]
        rows, ends = np.arange(len(block)), np.array([len(w) + 1 for w in block])
        ahead, behind = np.zeros((2, len(block), LONGEST_WORD + 2))
        ahead[:, 0] = behind[rows, ends] = 1.0
        found = arcs(block, model)
        for start, (w, end, piece) in enumerate(found):
            ahead[w, end] += ahead[w, start] * model.table[piece, lang[w]]
        for start in reversed(range(len(found))):
            w, end, piece = found[start]
            np.add.at(behind, (w, start), behind[w, end] * model.table[piece, lang[w]])
        for start, (w, end, piece) in enumerate(found):
            share = ahead[w, start] * model.table[piece, lang[w]] * behind[w, end] / ahead[w, ends[w]]
            np.add.at(used, (piece, lang[w]), share * count[w])
    return used


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (lang, text), added up in each task before the exchange."""
    small_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out():
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            for i in range(0, len(rows), 20_000):
                part = list(zip(*rows[i : i + 20_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(part, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"]
                )
            held.clear()

        for rows in rows_of(batches, "lang", "text"):
            for lang, text in rows:
                held.setdefault(lang, Counter()).update(text_words(text))
            if sum(map(len, held.values())) > CACHE_ENTRIES:
                yield from out()
        yield from out()

    pairs = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return pairs.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sampled(labelled: DataFrame, most: int = TRAINING_DOCS) -> DataFrame:
    """At most ``most`` of the labelled rows (doc_id, lang, text), the same for any partitioning.

    The ids are picked first, so no texts are ordered; rows with equal ids stay together.
    """
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    ids = known.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(most).distinct()
    return known.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")


def learn(labelled: DataFrame, vocabulary_path: str, rounds: int = ROUNDS, most: int = TRAINING_DOCS) -> Model:
    """A model from ``doc_id``, ``lang`` and ``text`` of labelled documents.

    Rows without one of them are left out; without rows nothing is learned.
    The model has languages times pieces of the fixed vocabulary, whatever the
    input; languages are expected to be few.
    """
    spark = labelled.sparkSession
    counts = stage(word_counts(sampled(labelled, most)), "words")
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    pieces = vocabulary(vocabulary_path)
    model = Model(langs, pieces, np.full((len(pieces), max(1, len(langs))), 1.0 / len(pieces)))
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            number, used = {x: i for i, x in enumerate(known.langs)}, np.zeros_like(known.table)
            for rows in rows_of(batches, "lang", "word", "n"):
                lang, word, n = zip(*rows)
                used += expected_uses(word, np.array([number[x] for x in lang]), np.array(n, float), known)
            piece, lang = np.nonzero(used[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang), pa.array(piece), pa.array(used[piece, lang])], ["lang", "piece", "used"]
            )

        sums = counts.mapInArrow(run, "lang long, piece long, used double").groupBy("lang", "piece").agg(F.sum("used"))
        table = np.full((len(pieces), len(langs)), PRIOR)
        for lang, piece, used in sums.collect():  # at most languages x vocabulary
            table[piece, lang] += used
        model = Model(langs, pieces, table / table.sum(axis=0))
        shared.unpersist()
    return model


class WordScores:
    """Log-probabilities of words met before, one row of a table for each; of the oldest, those met no more go."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table = model, {}, np.zeros((0, model.table.shape[1]))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Sum over the words of each text (row) for every language (column); no text is without words."""
        wanted = set().union(*texts)
        if len(self.rows) > CACHE_ENTRIES:
            kept = [w for w in wanted if w in self.rows]
            self.table = self.table[[self.rows[w] for w in kept]]
            self.rows = {w: i for i, w in enumerate(kept)}
        new = list(wanted - self.rows.keys())
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.table = np.vstack([self.table, forward(new, self.model)])
        if not texts:
            return np.zeros((0, self.table.shape[1]))
        rows, sizes = self.rows, np.array([len(t) for t in texts])
        numbers = np.array([rows[w] for t in texts for w in t])
        return np.add.reduceat(self.table[numbers], np.cumsum(sizes) - sizes)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` for every row, from ``text`` alone.

    The score is the language's share of the likelihoods of the whole text, all
    languages being equally likely before.  A text that is null or holds no
    letter is ``und`` with score 0, and so is every text if nothing was learned.
    Equal likelihoods go to the language first in alphabetical order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared, key = spark.sparkContext.broadcast(model), f"langid {uuid.uuid4().hex}"
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        cache = worker_cache(key, lambda: WordScores(known))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [text_words(t) if known.langs and t is not None and any(map(str.isalpha, t)) else [] for t in texts]
            preds, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            rows = [i for i, words in enumerate(found) if words]
            totals = cache.totals([found[i] for i in rows])
            best = totals.argmax(axis=1) if rows else ()
            for i, total, lang in zip(rows, totals, best):
                preds[i] = known.langs[lang]
                scores[i] = float(1.0 / np.exp(np.maximum(total - total[lang], -700.0)).sum())
            arrays = [*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")
