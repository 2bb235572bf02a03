"""Encoding, token files and length tables against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import pytest
import public_tokenizers as P
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paddock.llm import bpe, lengths, tokenfile
from paddock.llm.texts import ChunkCache, chunks

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(bpe.Vocabulary.read(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def shared_chunks():
    return lengths.ChunkEncoder(JSON)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("aeintrs '\n\t  .12", max_size=80))
def test_texts_encode_as_in_the_library(library, encoder, text):
    (parts,) = encoder.encoded([text])
    ids = [int(i) for p in parts for i in p[1].split()]
    assert ids == library.encode_ordinary(text)
    assert b"".join(p[2] for p in parts) == text.encode()
    assert " ".join(chunks([text], ChunkCache(), ChunkCache())[0][0]) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aeint's \n\t\x1c\xa0é.12", max_size=40), min_size=1, max_size=6))
def test_chunks_encode_as_whole_texts_do(library, encoder, shared_chunks, texts):
    """Several texts, with caches that earlier ones have filled."""
    for text, parts, packed in zip(texts, encoder.encoded(texts), shared_chunks.packed(texts)):
        ids = library.encode_ordinary(text)
        assert [int(i) for p in parts for i in p[1].split()] == ids
        assert packed == b"".join(i.to_bytes(4, "little") for i in ids)


def test_appends_and_edits_are_exact(encoder):
    rng, v = random.Random(5), encoder.vocabulary
    for _ in range(60):
        word = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 40))).encode()
        grown = bpe.PrefixEncoding(v, word[:3])
        grown.append(word[3:])
        assert grown.ids() == bpe.PrefixEncoding(v, word).ids()
        low = rng.randint(0, len(word))
        high = rng.randint(low, len(word))
        grown.replace(low, high, b"ing")
        assert grown.ids() == bpe.PrefixEncoding(v, word[:low] + b"ing" + word[high:]).ids()


def test_documents_encode(spark, make, odd, library):
    got = sorted(map(tuple, bpe.encode_documents(make(odd), RANKS, P.PATTERN).collect()))
    want = []
    for doc_id, text in odd:
        ids = library.encode_ordinary(text or "")
        sums = (hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode()))
        want.append((doc_id, len(ids), *sums))
    assert got == sorted(want)
    assert bpe.encode_documents(make([]), RANKS, P.PATTERN).collect() == []


def test_token_files_round_trip(spark, make, odd, tmp_path):
    own = Tokenizer.from_file(JSON)
    folder = str(tmp_path / "tokens")
    shards = tokenfile.write_token_files(make(odd), JSON, folder, 2, shards=3).collect()
    rows = sorted(odd, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    want, at = [], 0
    for doc_id, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    got = tokenfile.read_token_files(spark.createDataFrame(shards)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    # Any decoder reads a shard as a whole; a damaged frame is noticed.
    path = shards[0]["path"]
    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert len(plain) == 4 * shards[0]["n_ids"]
    data = bytearray(open(path, "rb").read())
    reader = tokenfile.ShardReader(path)
    data[int(reader.offsets[1]) - 5] ^= 1
    broken = tmp_path / "broken.zst"
    broken.write_bytes(bytes(data))
    with pytest.raises(Exception):
        tokenfile.ShardReader(str(broken)).frame(0)
    assert tokenfile.write_token_files(make([]), JSON, folder, 2).collect() == []
    with pytest.raises(Exception, match="without doc_id"):
        tokenfile.write_token_files(make([(None, "x")]), JSON, folder, 2).collect()


def test_token_files_of_documents_without_id(spark, make, odd):
    """They come first, in the order of their texts, and count for the start of all others."""
    own = Tokenizer.from_file(JSON)
    for rows in ([(None, "zero"), (None, None), *odd, (None, "a first one"), (0, "nought")], [(None, "only this")]):
        want, at = [], 0
        for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = own.encode(text or "", add_special_tokens=False).ids + [2]
            want.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
            at += len(ids)
        got = tokenfile.round_trip(make(rows), JSON, 2).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_documents_cross_frames(tmp_path):
    path = str(tmp_path / "s" / "x.zst")
    writer = tokenfile.ShardWriter(path)
    rng = random.Random(1)
    docs = [(i, b"".join(rng.randrange(50_000).to_bytes(4, "little") for _ in range(n))) for i, n in enumerate((1, 70_000, 0, 200_000, 5))]
    for d in docs:
        writer.add(*d)
    assert writer.close() == (5, 270_006)
    reader = tokenfile.ShardReader(path)
    assert len(reader.table) == 5
    assert [reader.document(i) for i in (3, 0, 4, 1, 2)] == [docs[i][1] for i in (3, 0, 4, 1, 2)]


def test_length_table(spark, make, odd):
    own = Tokenizer.from_file(JSON)
    sizes = [len(own.encode(t or "", add_special_tokens=False).ids) for _, t in odd]
    found = lengths.encoded_lengths(make(odd), JSON)
    assert sorted(r[0] for r in found.collect()) == sorted(sizes)
    table = lengths.length_table(found)
    for r in table.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == sizes.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in sizes)
        assert r["tokens_at_least"] == sum(x for x in sizes if x >= n)
        assert r["tokens_cut"] == sum(min(x, n) for x in sizes)
        assert r["share_at_most"] == sum(x <= n for x in sizes) / len(sizes)
    limits, shares = [1, 10, 4096, 10**6], [0.0, 0.5, 0.9, 1.0]
    got = {(r["kind"], r["at"]): r["value"] for r in lengths.answers(table, limits, shares).collect()}
    for x in limits:
        assert got["docs_over", x] == sum(s > x for s in sizes)
        assert got["tokens_kept", x] == sum(min(s, x) for s in sizes)
    ordered = sorted(sizes)
    for s in shares:
        assert got["quantile", s] == min(x for x in ordered if sum(y <= x for y in ordered) / len(ordered) >= s)
    none = lengths.length_table(spark.createDataFrame([], "n_tokens long"))
    assert none.collect() == []


def test_words_with_marks_behind_them():
    """Words, marks and names of added tokens in every combination, with caches that turn over."""
    own = Tokenizer.from_file(JSON)
    encoder = lengths.ChunkEncoder(JSON)
    encoder.later.entries = encoder.first.entries = 40
    rng = random.Random(4)
    parts = ["word", "naïve", "don't", "it's", "x2", "日本", "ß", "a_b", "²", "é", "", " ", "\n", "\t", "<|endoftext|>", "<|endo", "'", "'s", ",", "...", "!?", "'re'", "%%%", '"', "-", "Ⅷ", "'S,"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(40))) for _ in range(20)]
        want = [b"".join(i.to_bytes(4, "little") for i in own.encode(t, add_special_tokens=False).ids) for t in texts]
        assert encoder.packed(texts) == want


def test_matches_are_learnt_once(library):
    """A word alone and before marks is one match; a chunk of one match shares its entry, through many small generations too."""
    own = bpe.TextEncoder(bpe.Vocabulary.read(RANKS), P.PATTERN)
    own.encoded(["x tuquorim"])
    assert own.later.found["tuquorim"] is own.matches.found[" tuquorim"]
    learnt = []
    extend = own.vocabulary.extend
    own.vocabulary.extend = lambda data, last: (learnt.append(bytes(data)), extend(data, last))
    own.encoded(["x tuquorim, tuquorim.\nTuquorim"])
    assert b" tuquorim" not in learnt and len(learnt) == len(set(learnt))
    own.later.entries = own.matches.entries = own.first.entries = 3
    rng = random.Random(8)
    for _ in range(40):
        texts = ["".join(rng.choice("ab é.\n\t ,1") for _ in range(rng.randint(0, 40))) for _ in range(3)]
        for text, parts in zip(texts, own.encoded(texts)):
            assert [int(i) for p in parts for i in p[1].split()] == library.encode_ordinary(text)
            assert b"".join(p[2] for p in parts) == text.encode()


def test_a_batch_costs_its_own_chunks_not_the_whole_cache():
    """Chunks kept from earlier batches are looked up one by one, and each different one of a batch once."""

    class Kept(dict):
        asked = 0

        def keys(self):
            raise AssertionError("walked")

        __iter__ = keys

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    own = Tokenizer.from_file(JSON)
    encoder = lengths.ChunkEncoder(JSON)
    encoder.packed(["many words, kept from here."])
    kept = encoder.later.found = Kept(encoder.later.found.items())
    texts = ["many words, tuquorim, tuquorim", "", "kept  \n from", "x " + "here. words, " * 50]
    want = [b"".join(i.to_bytes(4, "little") for i in own.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.packed(texts) == want
    assert kept.asked < 50
