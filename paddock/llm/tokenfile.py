"""Token ids in files of independent zstandard frames with a trailing seek table.

A shard holds the documents of one range of doc_id in ascending order:

- frames, each the zstandard form of at most ``FRAME_IDS`` ids as
  little-endian unsigned 32-bit integers; documents may cross frames;
- a skippable frame (magic 0x184D2A50) with the index of documents: their ids
  and numbers of tokens as two columns of 64-bit integers, and a column of
  bytes that is 0 where a document has no id, compressed together;
- a skippable frame (magic 0x184D2A5E) with the seek table of the public
  seekable format: for each frame its compressed size, its size and the lower
  32 bits of the XXH64 of its content; then the number of frames, a descriptor
  byte (0x80: checksums) and the magic 0x8F92EAB1.

A reader fetches the tail, then only the frames of the documents asked for.
Any zstandard decoder reads the shard as a whole and skips what isn't a frame.
A task writes its shard under a name of its own and then renames it, so a task
that runs again after a lost executor replaces it by the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.lengths import chunk_encoder
from paddock.llm.texts import small_batches, stage
from paddock.session import scratch_path

#: Ids in a frame.
FRAME_IDS = 1 << 16
#: Documents that a shard aims at, at most; its writer and its readers hold their ids and lengths.
SHARD_DOCS = 1 << 16
#: Documents whose ids a reader asks for at once.
READ_DOCS = 256
LEVEL = 3
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

SHARDS = "shard long, path string, n_docs long, n_ids long"


def filesystem(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes one shard; at most one frame of ids is held."""

    def __init__(self, uri: str):
        import xxhash
        import zstandard

        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.own)
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.hash = xxhash.xxh64_intdigest
        self.pending, self.table, self.docs, self.named, self.counts = bytearray(), [], array("q"), bytearray(), array("q")

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.docs.append(doc_id or 0)
        self.named.append(doc_id is not None)
        self.counts.append(len(packed) // 4)
        self.pending += packed
        while len(self.pending) >= 4 * FRAME_IDS:
            self._frame(bytes(self.pending[: 4 * FRAME_IDS]))
            del self.pending[: 4 * FRAME_IDS]

    def _frame(self, content: bytes) -> None:
        data = self.compress(content)
        self.out.write(data)
        self.table.append((len(data), len(content), self.hash(content) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        if self.pending:
            self._frame(bytes(self.pending))
        ids, counts = (np.array(c, "<i8").tobytes() for c in (self.docs, self.counts))
        index = struct.pack("<Q", len(self.docs)) + self.compress(ids + counts + bytes(self.named))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        seek = b"".join([struct.pack("<III", *t) for t in self.table]) + struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
        self.out.close()
        self.fs.move(self.own, self.path)
        return len(self.docs), sum(self.counts)


class ShardReader:
    """Reads single documents of a shard; checks the sum of every frame it decompresses."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"{uri} has no seek table")
        start = end - 9 - 12 * frames
        self.table = np.frombuffer(self._at(start, 12 * frames), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 1], dtype=np.int64)])
        at = int(self.offsets[-1])
        magic, size = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{uri} has no index of documents")
        import zstandard

        self.decompress = zstandard.ZstdDecompressor().decompress
        index = self._at(at + 8, size)
        (n,) = struct.unpack("<Q", index[:8])
        columns = self.decompress(index[8:])
        self.doc_ids, self.counts = np.frombuffer(columns, "<i8", 2 * n).reshape(2, n)
        self.named = np.frombuffer(columns, np.uint8, n, 16 * n).astype(bool)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self._held: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        """The content of frame ``k``; the last one is kept."""
        import xxhash

        if self._held[0] != k:
            content = self.decompress(self._at(int(self.offsets[k]), int(self.table[k, 0])))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._held = (k, content)
        return self._held[1]

    def document(self, i: int) -> bytes:
        """The ids of the ``i``-th document of the shard, 4 bytes each."""
        low, high = 4 * int(self.first[i]), 4 * int(self.first[i + 1])
        out, k = [], int(np.searchsorted(self.starts, low, "right")) - 1
        while low < high:
            here = int(self.starts[k])
            part = self.frame(k)[low - here : high - here]
            out.append(part)
            low, k = low + len(part), k + 1
        return b"".join(out)


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int, shards: int | None = None, nameless: bool = False
) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to shards in ``folder``; return one row per shard.

    Documents are in ascending order of doc_id, across shards too; rows with
    the same doc_id share a shard, ordered by text.  ``end_id`` ends every
    document; a null or empty text is the end id alone.  An empty table gives
    no shard.  Rows without doc_id cannot be asked for and raise an error,
    unless ``nameless`` says that they come first, ordered by text, in the
    first shard; they are read back with a null doc_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD_DOCS))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.zst"
        encoder, writer = chunk_encoder(tokenizer), None
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), encoder.packed([t or "" for t in batch.column(1).to_pylist()])):
                if doc_id is None and not nameless:
                    raise ValueError("a document without doc_id")
                writer = writer or ShardWriter(path)
                writer.add(doc_id, packed + end)
        if writer:
            row = zip((shard, path, *writer.close()), (pa.int64(), pa.string(), pa.int64(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], ["shard", "path", "n_docs", "n_ids"])

    # A range of doc_id is a partition, and a partition a shard: each task writes one.
    ranges = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return ranges.mapInArrow(run, SHARDS)


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``shards``: the rows of ``write_token_files``.  Tasks read ranges of
    ``READ_DOCS`` documents through the seek tables.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_DOCS).cast("long"))))
        .select("path", "base", "low")
    )
    parts = max(2, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, reader = row["path"], ShardReader(row["path"])
                low = row["low"]
                high = min(low + READ_DOCS, len(reader.doc_ids))
                sums = [zlib.crc32(reader.document(i)) for i in range(low, high)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids[low:high], mask=~reader.named[low:high]),
                        pa.array(reader.first[low:high] + row["base"]),
                        pa.array(reader.counts[low:high]),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # Ranges of (path, low): a task opens few shards, and each shard's index is read by few tasks.
    return pieces.repartitionByRange(parts, "path", "low").sortWithinPartitions("path", "low").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write token files to the shared folder and read every document back from them, those without doc_id too."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(stage(write_token_files(docs, tokenizer, folder, end_id, nameless=True), "shards"))
