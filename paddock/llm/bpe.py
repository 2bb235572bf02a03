"""Byte-level BPE by prefix dynamic programming.

The BPE encoding of a byte string is unique, and so is that of each of its
prefixes.  One number per prefix therefore stores everything: the last token of
the prefix's encoding.  Token ``t`` of ``n`` bytes is the last token of prefix
``i`` exactly if ``t`` may stand after the last token of prefix ``i - n``; the
tokens are found by walking back.  Appending bytes adds entries and changes
none, and after an edit only the entries from the edit on are computed anew.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.texts import CACHE_ENTRIES, CACHED_CHUNK, ChunkCache, chunks, rows_of, small_batches, worker_cache

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Chunks and matches in a generation of the caches; a chunk of one match shares that match's entry.
CHUNKS, MATCHES = 300_000, 300_000
#: Chunks cut into matches in one call.
JOINED = 1000
_NEVER = 1 << 60
#: Stands before the first token.
_START = 1 << 30


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: data for data, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self._follows: dict[int, bool] = {}
        import ahocorasick

        # All tokens that end at a byte, the longest first; a byte is a character of the automaton.
        self.ending = ahocorasick.Automaton()
        for data, rank in ranks.items():
            self.ending.add_word(data.decode("latin-1"), (rank, len(data)))
        self.ending.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A file with a base64 byte string and its rank on each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte or a token no merge makes."""
        if token not in self._halves:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                ranked = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
                best = min(ranked)
                if best >= token:
                    break
                at = ranked.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            pair = [self.ranks.get(p) for p in parts]
            self._halves[token] = (pair[0], pair[1]) if len(pair) == 2 and None not in pair else None
        return self._halves[token]

    def made(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at the left (0) or right (1) end of this one while it is built.

        With each comes the rank of the merge that consumes it.
        """
        key = (token, side)
        if key not in self._spines:
            found, until, now = [], _NEVER, token
            while True:
                found.append((self.tokens[now], until))
                pair = self.halves(now)
                if pair is None:
                    break
                until, now = now, pair[side]
            self._spines[key] = found
        return self._spines[key]

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged together; ``left`` may be the start.

        They don't if some token at the right end of ``left`` and some token at
        the left end of ``right`` merge while both exist.  Of equal merges the
        leftmost comes first.
        """
        key = left << 32 | right
        known = self._follows.get(key)
        if known is None:
            ranks, ends = self.ranks, self.spine(right, 0)
            known = left != _START or self.made(right)
            for a, a_until in self.spine(left, 1) if left != _START else ():
                for b, b_until in ends:
                    rank = ranks.get(a + b)
                    if rank is not None and rank < a_until and rank <= b_until:
                        known = False
            if len(self._follows) > 2 * CACHE_ENTRIES:
                self._follows.clear()
            self._follows[key] = known
        return known


    def extend(self, data: bytes, last: list[int]) -> None:
        """Add to ``last`` the last tokens of the prefixes of ``data`` that it lacks."""
        follows, known, add = self.follows, self._follows.get, last.append
        reached, n = len(last), len(data)
        start = max(0, reached - self.longest)
        for at, (token, size) in self.ending.iter(data[start:].decode("latin-1")):
            end = start + at + 1
            if end <= reached:  # known before, or found by a longer token
                continue
            before = last[end - size - 1] if size < end else _START
            fits = known(before << 32 | token)
            if fits is None:
                fits = follows(before, token)
            if fits:
                if end != reached + 1:
                    break
                add(token)
                reached = end
        if reached != n:
            raise ValueError(f"no token for byte {data[reached]}: the vocabulary lacks it")

    def walk(self, last: list[int]) -> list[int]:
        """The ids that the last tokens of all prefixes lead to."""
        out, end, tokens = [], len(last), self.tokens
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(tokens[token])
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.extend(data, last)
        return self.walk(last)


class PrefixEncoding:
    """The encoding of a byte string that can grow and change."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; entries of earlier prefixes stay as they are."""
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of bytes ``start`` to ``end``; only prefixes that reach beyond ``start`` change."""
        rest = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(rest)

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last)


class TextEncoder:
    """Texts to ids: each match of a pattern apart, chunks and matches seen before from a bounded cache."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.decimal = {i: str(i) for i in vocabulary.tokens}
        self.first, self.later, self.matches = ChunkCache(), ChunkCache(CHUNKS), ChunkCache(MATCHES)

    def ids(self, text: str) -> list[int]:
        return [int(i) for part in self.encoded([text])[0] for i in part[1].split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.vocabulary.tokens[i] for i in ids])

    def _learn_matches(self, found: set[str]) -> None:
        """Encode the matches not met before; in sorted order, so that each appends to what it shares with the last."""
        new, known = sorted(self.matches.lacking(found)), self.matches.found
        v, decimal, last, before = self.vocabulary, self.decimal, [], b""
        ranks, tokens = v.ranks, v.tokens
        for match in new:
            data = match.encode()
            # A match that is a token as a whole gives that token, as in the library to agree with.
            whole = ranks.get(data)
            if whole is not None:
                known[match] = (1, decimal[whole], tokens[whole])
                continue
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del last[same:]
            v.extend(data, last)
            before = data
            ids = v.walk(last)
            known[match] = (len(ids), " ".join([decimal[i] for i in ids]), b"".join([tokens[i] for i in ids]))

    def _cut(self, new: list[str]) -> list[list[str]]:
        """The matches of each chunk with the space before it.

        Chunks without another space are cut as one text: a match that starts with a space starts a chunk.
        """
        out: list[list[str]] = []
        for low in range(0, len(new), JOINED):
            part = new[low : low + JOINED]
            if any([" " in c or c.strip() != c or not c for c in part]):
                out.extend([self.find(" " + c) for c in part])
                continue
            for match in self.find(" " + " ".join(part)):
                if match[0] == " ":
                    out.append([match])
                else:
                    out[-1].append(match)
        return out

    def _learn(self, cache: ChunkCache, new: list[str], cut: list[list[str]]) -> None:
        self._learn_matches(set(chain.from_iterable(cut)))
        known, into = self.matches.found, cache.found
        for chunk, found in zip(new, cut):
            if len(found) == 1:
                into[chunk] = known[found[0]]
            else:
                parts = [known[m] for m in found]
                into[chunk] = (sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), b"".join([p[2] for p in parts]))
        for match in [m for m in chain.from_iterable(cut) if len(m) >= CACHED_CHUNK]:
            known.pop(match, None)

    def encoded(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """Of each chunk of each text: number of ids, ids as decimal text, bytes decoded from them."""
        cut, heads, tails = chunks(texts, self.first, self.later)
        self._learn(self.first, heads, [self.find(chunk) for chunk in heads])
        self._learn(self.later, tails, self._cut(tails))
        first, later = self.first.found, self.later.found
        out = [[first[c[0]], *[later[x] for x in c[1:]]] if c else [] for c in cut]
        self.first.forget(heads)
        self.later.forget(tails)
        return out


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode ``text`` of every row.

    ``path``: file of ranks that every executor can open.  One row per row of
    ``docs``, in any order: number of ids, SHA-256 of the decimal ids joined by
    spaces, SHA-256 of the bytes decoded from the ids.  Null and empty texts
    have no ids; repeated rows give repeated rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"bpe {path} {pattern}", lambda: TextEncoder(Vocabulary.read(path), pattern))
        for rows in rows_of(batches, "doc_id", "text"):
            out = []
            for (doc_id, _), parts in zip(rows, encoder.encoded([text or "" for _, text in rows])):
                ids, decoded = hashlib.sha256(" ".join([p[1] for p in parts]).encode()), hashlib.sha256()
                decoded.update(b"".join([p[2] for p in parts]))
                out.append((doc_id, sum([p[0] for p in parts]), ids.hexdigest(), decoded.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)
