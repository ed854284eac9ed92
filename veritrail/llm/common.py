"""What the operators share: reading, written intermediate tables, and byte-wise
hashing of whole texts in numpy.

Texts are handled as UTF-8 bytes. A block is a run of documents joined by a
newline, so words never span two documents. Hashes of byte ranges come from a
prefix sum of table[byte] * BASE**position (mod 2**64) that is divided by
BASE**start and mixed; equal bytes give equal hashes wherever they stand.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of documents handled at once (a longer document is a block of its own).
BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        cut_lineage(spark.range(0))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives
    the loss of executors, and tells the optimizer the real size."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scan_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) runs of documents of about `limit` bytes."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def held(name: str, make):
    """A value kept once per process. Task functions travel by value; what is
    kept here does not travel with them."""
    holder = sys.modules.setdefault("veritrail_held", types.ModuleType("veritrail_held"))
    if name not in holder.__dict__:
        holder.__dict__[name] = make()
    return holder.__dict__[name]


def byte_table(lower: bool) -> np.ndarray:
    def make() -> np.ndarray:
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        if lower:
            values[65:91] = values[97:123]
        return values

    return held(f"bytes {lower}", make)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below the next power of two."""
    size = 1 << max(10, (n - 1).bit_length())

    def make() -> tuple[np.ndarray, ...]:
        factors = np.full((2, size), [[_BASE], [_BASE_INVERSE]], np.uint64)
        factors[:, 0] = 1
        return tuple(np.multiply.accumulate(factors, axis=1))

    return held(f"powers {size}", make)


class Block:
    """Some documents as one byte array with prefix hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        self.ends = self.starts + lengths
        n = len(self.data) + 1
        up, self._down = _powers(n)
        self._prefix = np.zeros(n, np.uint64)
        np.cumsum(byte_table(lower)[self.data] * up[: n - 1], out=self._prefix[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of every byte range [start, end)."""
        return mix((self._prefix[end] - self._prefix[start]) * self._down[start] + (end - start).astype(np.uint64))

    def fixed(self, width: int) -> np.ndarray:
        """Hash of the `width` bytes from every position."""
        return mix((self._prefix[width:] - self._prefix[:-width]) * self._down[: len(self._prefix) - width])

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over every document."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.ends] - total[self.starts]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word."""
        space = SPACE[self.data]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        return start, end, np.searchsorted(self.starts, start, "right") - 1


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def windows(word_hash: np.ndarray, document: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of every run of k words inside one document."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + word_hash[j: j + n]
    at = np.flatnonzero(document[:n] == document[k - 1:])
    return at, mix(total[at])


def rows_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns only, renamed: whatever else a table holds, clashing
    names included, stays out of an operator's way."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
