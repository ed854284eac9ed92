"""Packing of tokenized documents into windows by multiway differencing.

A document's ids (with the end id) are cut into whole windows and, for what is
left, parts of at most PART ids. Whole windows stand alone. The parts are dealt
into shards of about SHARD_WINDOWS windows; in each, every part begins as a
partition of its own, and the two partitions of largest imbalance are merged
again and again, the fullest bins of one with the emptiest of the other. If the
fullest bin exceeds the capacity, the number of windows rises and the shard is
partitioned anew.

Defined cases: a null or empty text is its end id alone; rows with equal ids are
packed each; an empty table gives no pieces; other columns stay out of the way.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, rows_of, stored
from .tokens import encoder

CAPACITY = 2048
PART = 512
SHARD_WINDOWS = 256
END_ID = 1


def cut(n: int, capacity: int = CAPACITY, part: int = PART) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    whole = n // capacity * capacity
    return [(s, capacity) for s in range(0, whole, capacity)] + [
        (s, min(part, n - s)) for s in range(whole, n, part)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json",
           end_id: int = END_ID, capacity: int = CAPACITY, part: int = PART, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) and, if asked for, ids."""
    rows = rows_of(docs, {"doc_id": doc_id, "text": text})
    end = np.array([end_id], "<u4").tobytes()
    schema = (f"doc_id {dict(rows.dtypes)['doc_id']}, start bigint, length bigint, ids_crc32 bigint, "
              "doc_tokens bigint" + ", ids binary" * keep_ids)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                found = []
                for i, ids in enumerate(tokens.encode(as_bytes(some.column(1)))):
                    ids += end
                    n = len(ids) // 4
                    for s, k in cut(n, capacity, part):
                        own = ids[4 * s: 4 * (s + k)]
                        found.append((i, s, k, zlib.crc32(own), n, own))
                at, *columns = zip(*found, strict=True)
                kinds = [pa.int64()] * 4 + [pa.binary()] * keep_ids
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    names=names)

    return rows.mapInArrow(run, schema)


def _merge(a, b, m: int, parent: np.ndarray):
    """Two partial partitions as one: (sums, one item of each bin), bins in
    descending order, empty ones left out. Where both have a bin, the fullest
    meets the emptiest."""
    (sums_a, bin_a), (sums_b, bin_b) = a, b
    both = len(sums_a) + len(sums_b) - m
    if both > 0:
        alone = len(sums_a) - both
        parent[bin_b[::-1][:both]] = bin_a[alone:]
        joined = sums_a[alone:] + sums_b[::-1][:both]
        sums = np.concatenate((sums_a[:alone], joined, sums_b[: len(sums_b) - both]))
        bins = np.concatenate((bin_a, bin_b[: len(sums_b) - both]))
    else:
        sums, bins = np.concatenate((sums_a, sums_b)), np.concatenate((bin_a, bin_b))
    order = np.argsort(-sums, kind="stable")
    return sums[order], bins[order]


def difference(sizes: np.ndarray, m: int) -> np.ndarray:
    """Bin of every item after multiway differencing into m bins."""
    parent = np.arange(len(sizes))
    heap = [(-int(s), i, (np.array([s], np.int64), np.array([i]))) for i, s in enumerate(sizes)]
    if m == 1:
        return np.zeros(len(sizes), np.int64)
    heapq.heapify(heap)
    ticket = len(heap)
    while len(heap) > 1:
        merged = _merge(heapq.heappop(heap)[2], heapq.heappop(heap)[2], m, parent)
        sums = merged[0]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == m else 0)), ticket, merged))
        ticket += 1
    while not (parent[parent] == parent).all():
        parent = parent[parent]
    return np.unique(parent, return_inverse=True)[1]


def partition(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bins of at most `capacity`: the count starts at the least possible and
    rises whenever a bin exceeds it."""
    m = max(1, math.ceil(sizes.sum() / capacity))
    while True:
        bins = difference(sizes, m)
        if np.bincount(bins, sizes).max() <= capacity:
            return bins
        m += 1


def pack(found: DataFrame, capacity: int = CAPACITY, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """The pieces (a written table) with sequence_id and offset."""
    total = found.agg(F.sum("length")).first()[0] or 0
    shards = max(1, math.ceil(total / (capacity * shard_windows)))
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).alias("shard")
    names = found.columns
    schema = ", ".join(f"{c} {t}" for c, t in found.dtypes) + ", sequence_id bigint, offset bigint"

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        length = frame["length"].to_numpy(np.int64)
        rest = np.flatnonzero(length < capacity)
        bins = np.zeros(len(frame), np.int64)
        used = 0
        if len(rest):
            bins[rest] = partition(length[rest], capacity)
            used = int(bins[rest].max()) + 1
        whole = np.flatnonzero(length == capacity)
        bins[whole] = used + np.arange(len(whole))
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.concatenate(([True], np.diff(bins[order]) != 0))
        offset = np.empty(len(frame), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        out = frame[names].copy()
        out["sequence_id"] = (int(frame["shard"].iat[0]) << 24) + bins
        out["offset"] = offset
        return out

    return found.select(*names, shard).groupBy("shard").applyInPandas(deal, schema)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their places. Tokens are made once."""
    return pack(stored(pieces(docs, **options)), options.get("capacity", CAPACITY))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the windows themselves, from pieces packed
    with keep_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("sequence_id", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["length"])
                        .alias("n_tokens"), joined.alias("ids"))
