"""Reversible, incremental line deduplication.

The state of an index is three written tables, sharded by the key of a line:

* refs     (k1, k2, doc_id): which document holds which line; exact
* counts   (shard, k1, k2, n_docs, owner): how many documents hold it, and the
           least of them, which keeps its lines; exact
* filters  (shard, salt, n_buckets, filter): a cuckoo filter of the keys that
           more than one document holds

Inserting documents adds references, deleting removes them, and the counts of
the keys concerned are made anew from the references, so a deletion gives
exactly the state that never saw the document. Applying an index sends the keys
of every document to their shard's filter; what passes is looked up in the exact
counts. Shards are split by a salt of doc_id, so a line that a third of all
documents hold is probed in several tasks.

Defined cases: a null or empty text is one empty line; rows without doc_id keep
all lines; rows with equal ids are one document; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import as_bytes, rows_of, scan_partitions, stored

MIN_CHARS = 10
SALTS = 8
_SLOTS = 4
_KICKS = 500


def line_key(line: bytes) -> bytes | None:
    """The line stripped of ASCII white space and with A-Z in lower case, or
    None below MIN_CHARS code points."""
    key = line.strip(b" \t\n\v\f\r").lower()
    if len(key) < MIN_CHARS:
        return None
    if len(key) < 4 * MIN_CHARS and sum((c & 0xC0) != 0x80 for c in key) < MIN_CHARS:
        return None
    return key


def _halves(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(key)
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


class CuckooFilter:
    """Four 16-bit fingerprints per bucket; the other bucket of a fingerprint is
    its bucket xor the fingerprint's hash, so entries move and can be deleted
    without the key. What finds no place goes to an exact overflow set."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None, overflow: set[int] | None = None):
        self.n_buckets = n_buckets
        self.table = np.zeros((n_buckets, _SLOTS), np.uint16) if table is None else table
        self.overflow = overflow or set()

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        return cls(1 << max(1, (int(n_keys / (_SLOTS * 0.85)) + 1).bit_length()))

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys."""
        mask = np.uint64(self.n_buckets - 1)
        mark = (k1.view(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        one = k2.view(np.uint64) & mask
        return mark.astype(np.uint16), one, one ^ (mark * np.uint64(0x5BD1E995) & mask)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        mark, one, two = self.places(k1, k2)
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            self._put(m, a, b)

    def _put(self, m: int, a: int, b: int) -> None:
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = m
                return
        at = a
        for i in range(_KICKS):
            slot = (m + i) % _SLOTS
            m, self.table[at, slot] = int(self.table[at, slot]), m
            at ^= (m * 0x5BD1E995) & (self.n_buckets - 1)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = m
                return
        self.overflow.add(min(at, at ^ ((m * 0x5BD1E995) & (self.n_buckets - 1))) << 16 | m)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(k1, k2)
        hit = (self.table[one] == mark[:, None]).any(axis=1) | (self.table[two] == mark[:, None]).any(axis=1)
        if self.overflow:
            code = np.minimum(one, two) << np.uint64(16) | mark.astype(np.uint64)
            hit |= np.isin(code, np.array(sorted(self.overflow), np.uint64))
        return hit

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Removes one entry for each key that was inserted."""
        mark, one, two = self.places(k1, k2)
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == m)
                if len(found):
                    self.table[at, found[0]] = 0
                    break
            else:
                self.overflow.discard(min(a, b) << 16 | m)

    def dump(self) -> bytes:
        return len(self.overflow).to_bytes(8, "little") + np.array(sorted(self.overflow), np.uint64).tobytes() \
            + self.table.tobytes()

    @classmethod
    def load(cls, n_buckets: int, blob: bytes) -> CuckooFilter:
        n = int.from_bytes(blob[:8], "little")
        over = set(np.frombuffer(blob, np.uint64, n, 8).tolist())
        return cls(n_buckets, np.frombuffer(blob, np.uint16, -1, 8 + 8 * n).reshape(n_buckets, _SLOTS).copy(), over)


@dataclass
class Index:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def references(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc_id) once per row and line key."""
    rows = rows_of(docs, {"doc_id": doc_id, "text": text}).where("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths = [], []
            for text in as_bytes(batch.column(1)):
                own = {_halves(k) for line in text.split(b"\n") if (k := line_key(line)) is not None}
                keys.extend(own)
                lengths.append(len(own))
            pairs = np.array(keys, np.int64).reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), lengths)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), ids],
                names=["k1", "k2", "doc_id"])

    return rows.mapInArrow(run, f"k1 bigint, k2 bigint, doc_id {dict(rows.dtypes)['doc_id']}")


def _shard(shards: int):
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int").alias("shard")


def _counted(refs: DataFrame, shards: int) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("owner")).select(
        _shard(shards), "k1", "k2", "n_docs", "owner")


def _filters(counts: DataFrame) -> DataFrame:
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        cuckoo = CuckooFilter.sized(len(frame))
        cuckoo.insert(frame["k1"].to_numpy(np.int64), frame["k2"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(frame["shard"].iat[0])], "n_buckets": [cuckoo.n_buckets],
                             "filter": [cuckoo.dump()]})

    shared = counts.where("n_docs > 1").select("shard", "k1", "k2")
    return shared.groupBy("shard").applyInPandas(build, "shard int, n_buckets bigint, filter binary")


def _index(refs: DataFrame, shards: int) -> Index:
    refs = stored(refs)
    counts = stored(_counted(refs, shards))
    return Index(refs, counts, stored(_filters(counts)), shards)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> Index:
    """The index of a corpus. The number of shards goes with the session's
    shuffle partitions, so a shard stays as small as a shuffle partition."""
    shards = shards or 2 * scan_partitions(docs.sparkSession)
    return _index(references(docs, doc_id, text).distinct(), shards)


def insert(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index with more documents; inserting one again changes nothing."""
    return _index(index.refs.union(references(docs, doc_id, text)).distinct(), index.shards)


def delete(index: Index, ids: DataFrame, doc_id: str = "doc_id") -> Index:
    """The index without the documents named in `ids`."""
    gone = ids.select(F.col(f"`{doc_id}`").alias("doc_id")).distinct()
    return _index(index.refs.join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id"), index.shards)


def _probe(refs: DataFrame, index: Index) -> DataFrame:
    """References that their shard's filter lets pass."""
    kind = dict(refs.dtypes)["doc_id"]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    left = refs.select("k1", "k2", "doc_id", _shard(index.shards), salt)
    right = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
                                 "n_buckets", "filter")

    def check(keys: pa.Table, filters: pa.Table) -> pa.Table:
        keys = keys.select(["k1", "k2", "doc_id"])
        if not filters.num_rows or not keys.num_rows:
            return keys.slice(0, 0)
        cuckoo = CuckooFilter.load(filters["n_buckets"][0].as_py(), filters["filter"][0].as_py())
        hit = cuckoo.contains(keys["k1"].to_numpy(), keys["k2"].to_numpy())
        return keys.filter(pa.array(hit))

    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(
        check, f"k1 bigint, k2 bigint, doc_id {kind}")


def drops(index: Index, refs: DataFrame | None = None) -> DataFrame:
    """(doc_id, keys): the line keys a document loses. References default to
    those of the index."""
    passed = _probe(index.refs if refs is None else refs.distinct(), index).alias("r")
    exact = index.counts.where("n_docs > 1").select("k1", "k2", "owner").alias("c")
    lost = passed.join(exact, ["k1", "k2"]).where("doc_id > owner")
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))


def apply(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, text, n_lines, n_dropped): every row of docs as a struct, with the
    lines that stay."""
    lost = drops(index).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{doc_id}`").alias("id")).join(lost, F.col("id") == F.col("_id"), "left")
    rows = rows.select("row", "keys")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lines, dropped = [], [], []
            for text, gone in zip(as_bytes(batch.column(0).field(at)), batch.column(1).to_pylist(), strict=True):
                own = kept = text.split(b"\n")
                if gone:
                    gone = {(k["k1"], k["k2"]) for k in gone}
                    kept = [x for x in own if (k := line_key(x)) is None or _halves(k) not in gone]
                out.append(b"\n".join(kept).decode())
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(lines, pa.int64()),
                 pa.array(dropped, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])

    schema = StructType([rows.schema["row"], StructField("text", StringType()), StructField("n_lines", LongType()),
                         StructField("n_dropped", LongType())])
    return rows.mapInArrow(run, schema)


def _few(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines an earlier one holds. A document that
    loses no line keeps its text as it is, null included."""
    done = apply(docs, build(_few(docs, doc_id, text)), doc_id, text)
    new = F.when(F.col("n_dropped") > 0, F.col("text")).otherwise(F.col(f"row.`{text}`"))
    return done.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    few = _few(docs, doc_id, text)
    return apply(few, build(few)).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                                         F.sha2("text", 256).alias("kept_sha256"))
