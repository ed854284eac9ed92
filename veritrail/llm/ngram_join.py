"""Jaccard similarity join on word n-grams by grouped prefixes.

A document's set of shingles is ordered by one global order, rare ones first:
by the level of a fixed-size frequency table over the whole corpus, then by
hash. Two sets of similarity t or more share a shingle among the first
|s| - ceil(t * |s|) + 1 of each. Documents with identical prefix and size form
one group; groups are paired through equal prefix shingles and compatible sizes,
then expanded to their distinct sets, which are verified exactly.

Only linked classes are asked for, so a bucket of many alike documents is never
written out as all pairs. The first round pairs every group with the first of
each bucket it is in and verifies; later rounds pair, inside each bucket, only
groups that are not yet known to be connected. No link between classes is lost,
since a pair is left out only when both sides are in one class already.

Defined cases: null, empty and white-space texts have no shingles and link with
nothing; a text shorter than n words is one shingle; rows with equal ids are
members of one document; other columns stay out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Block, as_bytes, blocks, mix, rows_of, stored, windows

N = 4
PERCENT = 85
#: Cells of the frequency table, a fixed size whatever the corpus.
CELLS = 1 << 20
_SLICE = 1 << 14


def shingle_block(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts and their text's number."""
    b = Block(texts, lower=True)
    start, end, doc = b.words()
    hashes = b.hashes(start, end)
    at, grams = windows(hashes, doc, n)
    owner = doc[at]
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = [reduce(lambda a, h: (a * 0xC2B2AE3D27D4EB4F + h) % (1 << 64), hashes[f: f + c].tolist(), c)
                 for f, c in zip(first.tolist(), count[short].tolist(), strict=True)]
        grams = np.concatenate((grams, mix(np.array(whole, np.uint64))))
        owner = np.concatenate((owner, short))
    return grams, owner


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequencies(docs: DataFrame, n: int = N) -> np.ndarray:
    """How often each cell of the table is hit over all documents. Every task
    sends one table, in slices that are summed in parallel; the sum has a fixed
    size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for i, j in blocks(texts, 1 << 22):
                cells = [_cell(shingle_block(texts[i + p: i + q], n)[0]) for p, q in blocks(texts[i:j])]
                total += np.bincount(np.concatenate(cells), minlength=CELLS)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CELLS // _SLICE), pa.int32()),
                 pa.array([total[k: k + _SLICE].astype(np.uint32).tobytes() for k in range(0, CELLS, _SLICE)],
                          pa.binary())], names=["slice", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_SLICE, np.int64)
        for blob in frame["counts"]:
            total += np.frombuffer(blob, np.uint32)
        return pd.DataFrame({"slice": [frame["slice"].iat[0]], "counts": [total.tobytes()]})

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary")
    summed = parts.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    out = np.zeros(CELLS, np.int64)
    for row in summed:
        out[row["slice"] * _SLICE: (row["slice"] + 1) * _SLICE] = np.frombuffer(row["counts"], np.int64)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Order level of each cell: half-octaves of its count above the mean, so
    that the noise of a shared cell does not reorder rare shingles."""
    mean = max(1.0, float(counts.mean()))
    return np.clip(np.ceil(2 * np.log2(np.maximum(counts, 1) / mean)), 0, 255).astype(np.uint8)


def prefixes(docs: DataFrame, order: np.ndarray, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, size, s1, s2, head): size of the set, two hashes of it, and its
    prefix in the global order as 64-bit numbers."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            heads, sizes, marks = [], [], []
            for i, j in blocks(texts):
                grams, owner = shingle_block(texts[i:j], n)
                rank = grams & np.uint64((1 << 56) - 1) | shared.value[_cell(grams)].astype(np.uint64) << np.uint64(56)
                by_doc = np.argsort(owner, kind="stable")
                cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=j - i))))
                for k in range(j - i):
                    own = by_doc[cuts[k]: cuts[k + 1]]
                    whole, first = np.unique(grams[own], return_index=True)
                    size = len(whole)
                    length = size - -(-percent * size // 100) + (size > 0)
                    heads.append(whole[np.argsort(rank[own[first]], kind="stable")][:length])
                    sizes.append(size)
                    digest = xxhash.xxh3_128_intdigest(whole.tobytes())
                    marks.append(((digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)))
            flat = np.concatenate([*heads, np.zeros(0, np.uint64)])
            offsets = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
            both = np.array(marks, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.ascontiguousarray(both[:, 0])),
                 pa.array(np.ascontiguousarray(both[:, 1])),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
                names=["doc_id", "size", "s1", "s2", "head"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, size bigint, s1 bigint, s2 bigint, head array<bigint>")


def _fits(a: str, b: str, percent: int) -> Column:
    """Size and position filters for two bucket entries: the smaller set has
    percent of the larger, and what can still follow the shared shingle in both
    suffices. The first shingle two similar sets share passes both."""
    size, at = (lambda x: F.col(f"{x}.size")), (lambda x: F.col(f"{x}.at"))
    room = F.least(size(a) - at(a), size(b) - at(b))
    return (100 * F.least(size(a), size(b)) >= percent * F.greatest(size(a), size(b))) & (
        (100 + percent) * room >= percent * (size(a) + size(b)))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, from the picked texts."""
    pairs = stored(pairs.distinct())
    full = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                x, y = (np.unique(shingle_block([t], n)[0]) for t in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return stored(full.mapInArrow(run, f"a {kind}, b {kind}").distinct())


def _may_link(entries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Sets that have a bucket neighbour of compatible size, with their groups.
    In the order of sizes, if the next set is too large, all further ones are."""
    by_size = W.partitionBy("token").orderBy("size", "set_id")
    near = (100 * F.lag("size").over(by_size) >= percent * F.col("size")) | (
        100 * F.col("size") >= percent * F.lead("size").over(by_size))
    leads = entries.withColumn("near", near).where("near").select("set_id").distinct()
    return leads.union(members.select("set_id")).union(
        members.join(leads.withColumnRenamed("set_id", "lead"), "lead").select("set_id")).distinct()


def _pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of different classes, met in every bucket they share."""
    mixed = stored(mixed)
    whole = F.struct("set_id", "size", "at", "cls")
    outside = mixed.where("cls <> main").select("token", whole.alias("x"))
    return outside.join(mixed.select("token", whole.alias("y")), "token").where(
        (F.col("x.cls") != F.col("y.cls")) & _fits("x", "y", percent)).select(
        F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"))


def _pairs_once(mixed: DataFrame, percent: int) -> DataFrame:
    """The same pairs, met only in the first bucket they share: each entry knows
    the shingles before it. Wider rows, but fewer of them in large groups."""
    shared = mixed.groupBy("set_id", "size", "cls").agg(
        F.array_sort(F.collect_list(F.struct("at", "token", "main"))).alias("all"))
    entries = stored(shared.select("set_id", "size", "cls", F.posexplode("all").alias("i", "own"), "all").select(
        F.col("own.token").alias("token"), (F.col("cls") != F.col("own.main")).alias("outside"), F.struct(
            "set_id", "size", "cls", F.col("own.at").alias("at"),
            F.slice(F.transform("all", lambda e: e["token"]), F.lit(1), F.col("i")).alias("before")).alias("entry")))
    outside = entries.where("outside").select("token", F.col("entry").alias("x"))
    return outside.join(entries.select("token", F.col("entry").alias("y")), "token").where(
        (F.col("x.cls") != F.col("y.cls")) & _fits("x", "y", percent)
        & ~F.arrays_overlap("x.before", "y.before")).select(
        F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"))


def classes(docs: DataFrame, n: int = N, percent: int = PERCENT, doc_id: str = "doc_id",
            text: str = "text", first_only: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs. first_only
    chooses how pairs are met (see _pairs_once); the result is the same."""
    rows = rows_of(docs, {"doc_id": doc_id, "text": text})
    marked = stored(prefixes(rows, levels(frequencies(rows, n)), n, percent))
    rows = rows.where("doc_id IS NOT NULL")
    usable = marked.where("doc_id IS NOT NULL AND size > 0")
    # One entry per distinct set; documents with equal sets are linked by it.
    distinct = stored(usable.groupBy("s1", "s2", "size").agg(F.min("doc_id").alias("set_id")))
    sets = usable.join(distinct.select("s1", "s2", F.col("set_id").alias("doc_id")), ["doc_id", "s1", "s2"],
                       "left_semi").select(F.col("doc_id").alias("set_id"), "size", "head",
                                           F.xxhash64("head", "size").alias("group"))
    sets = stored(sets.dropDuplicates(["set_id"]))
    # Groups: identical prefix and size. Only their leads enter the buckets.
    groups = stored(sets.groupBy("group").agg(F.min("set_id").alias("lead"), F.max("set_id").alias("last")))
    members = stored(sets.select("group", "set_id", "size").join(
        groups.where("lead < last").select("group", "lead"), "group"))
    leads = sets.join(groups.select(F.col("lead").alias("set_id")), "set_id", "left_semi")
    tokens = leads.select("set_id", "size", F.posexplode("head").alias("at", "token"))
    bucket = W.partitionBy("token")
    entries = stored(tokens.withColumn("least", F.min("set_id").over(bucket)).withColumn(
        "most", F.max("set_id").over(bucket)).where("least < most").select("token", "set_id", "size", "at"))

    # The texts that verification may need are picked out once. The ids grow with
    # the corpus, so this is a shuffle join at any size.
    ids = _may_link(entries, members, percent).withColumnRenamed("set_id", "doc_id")
    texts = stored(rows.join(ids.hint("merge"), "doc_id", "left_semi"))

    # First round: each lead with one compatible partner of its buckets, the
    # least of its size octave; each member of a group with the lead.
    entry = F.struct("set_id", "size", "at")
    octave = F.floor(F.log2("size") * 4).alias("octave")
    first = entries.groupBy("token", octave).agg(F.min(entry).alias("y"))
    star = entries.select("token", octave, entry.alias("x")).join(first, ["token", "octave"]).where(
        F.col("x.set_id") > F.col("y.set_id")).where(_fits("x", "y", percent))
    star = star.groupBy(F.col("x.set_id").alias("b"), F.col("y.set_id").alias("a")).agg(F.count(F.lit(1)).alias("hits"))
    star = star.groupBy("b").agg(F.max_by("a", F.struct("hits", "a")).alias("a")).select("a", "b")
    inside = members.where("lead < set_id").select(F.col("lead").alias("a"), F.col("set_id").alias("b"))
    links = _verified(star.union(inside), texts, n, percent)

    # Second round: groups are expanded, and in every bucket each set outside
    # the bucket's largest class meets all sets of other classes.
    known = connected_components(links, "a", "b")
    classed = stored(sets.select("set_id", "size").join(known, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "size", F.coalesce("component", "set_id").alias("cls")))
    grown = entries.select("token", "at", F.col("set_id").alias("lead")).join(
        members.where("lead < set_id").select("lead", "set_id"), "lead").select("token", "at", "set_id")
    own = members.select(F.xxhash64("group", F.lit("group")).alias("token"), F.lit(0).alias("at"), "set_id")
    every = entries.select("token", "at", "set_id").union(grown).union(own).join(classed, "set_id")
    main = every.groupBy("token", "cls").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(
        F.max_by("cls", F.struct("n", "cls")).alias("main"), F.count(F.lit(1)).alias("classes"))
    mixed = every.join(main.where("classes > 1"), "token")
    pairs = (_pairs_once if first_only else _pairs)(mixed, percent)
    links = links.union(_verified(pairs, texts, n, percent))
    final = connected_components(links, "a", "b")
    of_set = distinct.join(final, F.col("set_id") == F.col("node"), "left").select(
        F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.coalesce("component", "set_id").alias("component_id"))
    return marked.select("doc_id", "size", "s1", "s2").join(
        of_set, (F.col("size") > 0) & F.col("doc_id").isNotNull() & (F.col("s1") == F.col("k1"))
        & (F.col("s2") == F.col("k2")), "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The first document of every class, columns unchanged."""
    lost = classes(docs, doc_id=doc_id, text=text, **options).where("component_id < doc_id").select(
        F.col("doc_id").alias("_gone")).distinct()
    return docs.join(lost, docs[f"`{doc_id}`"] == lost["_gone"], "left_anti")
