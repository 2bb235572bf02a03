"""What several operators of this package share: words, space-separated chunks, caches of a worker, batches."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from paddock.session import scratch_path

#: Rows and bytes in one Arrow batch; documents can be long.
BATCH_ROWS = 500
BATCH_BYTES = "8m"
#: Entries that a cache of a Python worker holds at most; it is emptied then.
CACHE_ENTRIES = 200_000

#: Longer chunks are seldom met again, and may be of any size.
CACHED_CHUNK = 64

BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory doesn't depend on the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def worker_cache(name: str, build: Callable[[], Any]) -> Any:
    """An object built once in a Python worker and kept for its later tasks.

    Functions arrive by value, so globals of this package are new in each task;
    a module of the worker's own outlives them.
    """
    home = sys.modules.setdefault("_paddock_worker", types.ModuleType("_paddock_worker"))
    if name not in home.__dict__:
        home.__dict__[name] = build()
    return home.__dict__[name]


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; none for null."""
    # bytes.lower and bytes.split know ASCII only, which is the rule asked for.
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


class ChunkCache:
    """What was found for chunks, in two generations: what isn't met while one fills up goes with the next."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries = entries
        self.found: dict[str, Any] = {}
        self.before: dict[str, Any] = {}

    def lacking(self, wanted: Iterable[str]) -> list[str]:
        """The chunks to be found, of different ones; all others of ``wanted`` are in ``found`` afterwards."""
        if len(self.found) > self.entries:
            self.found, self.before = {}, self.found
        found, before, out = self.found, self.before, []
        # Not a difference of set and keys, which goes through all keys.
        for chunk in [c for c in wanted if c not in found]:
            if chunk in before:
                found[chunk] = before[chunk]
            else:
                out.append(chunk)
        return out

    def forget(self, chunks: list[str]) -> None:
        """Drop chunks that are long, empty, or begin or end with white space."""
        for chunk in [c for c in chunks if len(c) >= CACHED_CHUNK or not c or c.strip() != c]:
            self.found.pop(chunk, None)


def chunks(texts: list[str], first: ChunkCache, later: ChunkCache) -> tuple[list[list[str]], list[str], list[str]]:
    """Cut texts at every single space between two characters that aren't white space.

    The cut space belongs to the chunk after it.  Byte-level BPE patterns never
    match across such a place, so chunks can be encoded one by one.  Also
    returned: the chunks that begin a text, and the others, that the caches lack.
    """
    cut = [t.split(" ") if t else [] for t in texts]

    def lacking() -> tuple[list[str], list[str]]:
        return first.lacking({c[0] for c in cut if c}), later.lacking(set(chain.from_iterable([islice(c, 1, None) for c in cut])))

    heads, tails = lacking()
    # Caches hold no rough chunks, so only new ones can come from a text with other white space at a space.
    if rough := {x for new in (heads, tails) for x in new if not x or x.strip() != x}:
        cut = [c if rough.isdisjoint(c) else BETWEEN_WORDS.split(t) for c, t in zip(cut, texts)]
        heads, tails = lacking()
    return cut, heads, tails


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """Python rows of the named columns, batch by batch."""
    for batch in batches:
        if batch.num_rows:
            yield list(zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
