"""Removal of repeated 50-byte strings by sorting suffixes, deep and shallow.

A byte goes if a 50-byte string over it also starts in a document of smaller id.
Sorting every suffix of a corpus would move each byte many times, so what is
certainly unique, or certainly whole, is set apart first:

1. Texts are written once, in chunks, as a bucketed table; the answers of the
   later steps, a few bits per run, are joined to it without moving texts.
2. Windows of 50 bytes fall into runs with a common 24-byte anchor (see Runs).
   Packed anchors go to buckets by hash; a bit for each comes back: whether
   another document may hold it.
3. For runs that may repeat, a hash of all their bytes goes to the anchor's
   bucket, once per chunk. Runs found whole in a document of smaller id are
   repeats; those whose anchor also occurs with other surroundings are open.
4. The bytes of open runs, one copy of each, go to the anchor's bucket. There
   the suffixes at all their windows are sorted: multikey quicksort on words of
   eight bytes to the depth SHALLOW, then a blind trie for every group that
   still agrees. Suffixes that agree for 50 bytes are repeats of the least id.

Hashes decide nothing on their own but the equality of whole runs (over 80 bits,
and the same anchor) and which runs are compared at all.

Defined cases: a null text is empty; matches never cross documents; rows with
equal ids are one document and remove nothing from each other; a row without id
keeps all its bytes and removes none; ids are whole numbers; other columns stay
out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, as_bytes, blocks, mix, rows_of, scan_partitions, shared_folder, stored

SPAN = 50
GRAM = 24
#: Depth in bytes of the quicksort; blind tries order what agrees beyond it.
SHALLOW = 32
#: Groups of the quicksort that are small enough for a direct sort.
_SMALL = 256
CHUNK_BYTES = 4 << 20
#: Anchors per bucket aimed at.
_PER_BUCKET = 1 << 18
_NO_ID = np.iinfo(np.int64).max


class Runs:
    """The 50-byte windows of some texts, in runs of neighbours with one anchor.

    The anchor of a window is its 24-byte substring of least hash. Equal windows
    have equal anchors at equal places. Neighbouring windows mostly share theirs,
    so there are about 14 times fewer runs than windows. For each: the document,
    the first window, the number of windows, the anchor's hash and a hash of all
    bytes the run covers with the anchor's place."""

    def __init__(self, texts: list[bytes]):
        parts = [self._block(texts[i:j], i) for i, j in blocks(texts)]
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.doc, self.first, self.count, self.anchor, self.whole = (
            np.concatenate([np.zeros(0, t), *[p[k] for p in parts]]) for k, t in enumerate(kinds))

    @staticmethod
    def _block(texts: list[bytes], number: int):
        b = Block(texts)
        if len(b.data) < SPAN:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        grams = b.fixed(GRAM)
        low = np.uint64((1 << (len(grams) - 1).bit_length()) - 1)
        least = grams & ~low | np.arange(len(grams), dtype=np.uint64)
        width, want = 1, SPAN - GRAM + 1
        while width < want:
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        edge = np.zeros(len(b.data) + 1, np.int8)
        long = b.ends - b.starts >= SPAN
        edge[b.starts[long]] += 1
        edge[b.ends[long] - SPAN + 1] -= 1
        at = np.flatnonzero(np.cumsum(edge[: len(least)], dtype=np.int8))
        anchor = (least[at] & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        first, place = at[head], anchor[head]
        count = np.diff(np.append(head, len(at)))
        doc = np.searchsorted(b.starts, first, "right") - 1
        whole = mix(b.hashes(first, first + count + SPAN - 1) + (place - first).astype(np.uint64))
        return doc + number, first - b.starts[doc], count, grams[place], whole


# --- sorting -----------------------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as a number that sorts like them."""
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | wide[k: k + len(data)]
    return out


def shallow_sort(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order of the suffixes at starts by their first SHALLOW bytes: ternary
    partition on one word at a time; what equals the pivot goes on with the next."""
    order = np.arange(len(starts))
    todo = [(0, len(starts), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth >= SHALLOW:
            continue
        own = order[low:high]
        if high - low <= _SMALL:
            keys = [words[starts[own] + d] for d in range(SHALLOW - 8, depth - 1, -8)]
            order[low:high] = own[np.lexsort(keys)]
            continue
        key = words[starts[own] + depth]
        sampled = np.sort(key[:: max(1, len(key) // 31)])
        pivot = sampled[len(sampled) // 2]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate((own[less], own[same], own[more]))
        todo += [(low, a, depth), (a, b, depth + 8), (b, high, depth)]
    return order


class BlindTrie:
    """Strings of one length below the depth at which they branch. Inner nodes
    hold [depth, children by byte, some leaf]; a leaf holds its members."""

    def __init__(self):
        self.root = None

    def insert(self, key: bytes, member: int) -> None:
        if self.root is None:
            self.root = (key, [member])
            return
        node, path = self.root, []
        while isinstance(node, list):  # blind descent: only branching bytes are read
            path.append(node)
            node = node[1].get(key[node[0]], node[2])
        while isinstance(node, list):
            node = node[2]
        other = node[0]
        if other == key:
            node[1].append(member)
            return
        common = next(i for i, (x, y) in enumerate(zip(key, other, strict=True)) if x != y)
        leaf = (key, [member])
        above = None
        for step in path:
            if step[0] >= common:
                break
            above = step
        below = self.root if above is None else above[1].get(key[above[0]])
        if isinstance(below, list) and below[0] == common:
            below[1][key[common]] = leaf
            return
        if below is None:
            above[1][key[above[0]]] = leaf
            return
        new = [common, {other[common]: below, key[common]: leaf}, below]
        if above is None:
            self.root = new
        else:
            above[1][key[above[0]]] = new

    def leaves(self) -> Iterator[tuple[bytes, list[int]]]:
        """In the order of the strings."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node


def repeats(data: bytes, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether the 50 bytes from each start also start at one of smaller owner."""
    array = np.frombuffer(data, np.uint8)
    words = _words(array)
    order = shallow_sort(words, starts)
    at = starts[order]
    new = np.zeros(len(at), bool)
    new[:1] = True
    for d in range(0, SHALLOW, 8):
        word = words[at + d]
        new[1:] |= word[1:] != word[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    out = np.zeros(len(starts), bool)
    # Tries of two leaves: all at once.
    two = first[size == 2]
    x, y = at[two], at[two + 1]
    equal = np.all([words[x + d] == words[y + d] for d in (*range(SHALLOW, SPAN - 8, 8), SPAN - 8)], axis=0)
    own = owner[order]
    out[order[two]] = equal & (own[two] > own[two + 1])
    out[order[two + 1]] = equal & (own[two + 1] > own[two])
    for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        trie = BlindTrie()
        for k in range(f, f + n):
            s = int(at[k])
            trie.insert(data[s + SHALLOW: s + SPAN], k)
        for _, members in trie.leaves():
            if len(members) > 1:
                mine = own[members]
                out[order[members]] = mine > mine.min()
    return out


# --- chunks and answers ------------------------------------------------------

class Chunk:
    """Some documents with the answers that have come back for them."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes, bits: int, answers: list | None):
        self.ids = np.frombuffer(ids, np.int64)
        cuts = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64)))).tolist()
        self.data = zstandard.ZstdDecompressor().decompress(texts)
        self.base = np.array(cuts[:-1], np.int64)
        self.texts = [self.data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.bits = np.uint64(bits)
        self.answers = {(a["phase"], a["bucket"]): a["answer"] for a in answers or ()}
        self.runs = r = Runs(self.texts)
        self.run_id = self.ids[r.doc]
        order = np.lexsort((r.doc, r.anchor))
        new = np.ones(len(order), bool)
        new[1:] = np.diff(r.anchor[order]) != 0
        new[1:] |= np.diff(r.doc[order]) != 0
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.anchors = r.anchor[order][new]

    def buckets(self, anchors: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, first, last) of sorted anchors."""
        bucket = (anchors >> (np.uint64(64) - self.bits)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        yield from zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True)

    def tails(self, anchors: np.ndarray) -> np.ndarray:
        return (anchors >> (np.uint64(32) - self.bits)).astype(np.uint32)

    def _answer(self, phase: int, anchors: np.ndarray, dtype, unpack=lambda raw, n: raw[:n]) -> np.ndarray:
        parts = [unpack(np.frombuffer(self.answers[phase, b], dtype), z - a) for b, a, z in self.buckets(anchors)]
        return np.concatenate([np.zeros(0, dtype), *parts])

    def shared(self) -> None:
        """After step 2: classes of the runs whose anchor others may hold, equal
        runs of a chunk being one class with the least id."""
        bits = self._answer(1, self.anchors, np.uint8, lambda raw, n: np.unpackbits(raw, count=n))
        self.open = np.flatnonzero(bits[self.entry])
        r = self.runs
        order = self.open[np.lexsort((self.run_id[self.open], r.whole[self.open], r.anchor[self.open]))]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(r.anchor[order]) != 0) | (np.diff(r.whole[order]) != 0)
        self.sample = order[new]
        self.run_class = np.full(len(r.doc), -1, np.int64)
        self.run_class[order] = np.cumsum(new) - 1
        self.class_id = self.run_id[self.sample]

    def unsettled(self) -> None:
        """After step 3: the classes whose bytes must be sorted."""
        self.codes = self._answer(2, self.runs.anchor[self.sample], np.uint8)
        self.asked = np.flatnonzero(self.codes == 2)

    def removed(self) -> np.ndarray:
        """After step 4: whether each byte goes."""
        r = self.runs
        masks = np.zeros(len(self.sample), np.uint32)
        masks[self.asked] = self._answer(3, r.anchor[self.sample[self.asked]], np.uint32)
        some = self.open
        own = self.run_class[some]
        usable = self.run_id[some] != _NO_ID
        whole = ((self.run_id[some] > self.class_id[own]) | (self.codes[own] == 1)) & usable
        edge = np.zeros(len(self.data) + 1, np.int32)
        at = self.base[r.doc] + r.first
        np.add.at(edge, at[some[whole]], 1)
        np.add.at(edge, at[some[whole]] + r.count[some[whole]] + SPAN - 1, -1)
        part = ~whole & usable & (masks[own] != 0)
        runs, mask = some[part], masks[own[part]]
        for j in range(SPAN - GRAM + 1):
            hit = at[runs[(mask >> np.uint32(j) & 1).astype(bool)]] + j
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + SPAN, -1)
        return np.cumsum(edge[:-1]) > 0


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _un_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, sizes, texts, n_bytes) as a bucketed table in the shared
    folder; joins on the chunk leave it where it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            ids = np.array([_NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            for i, j in blocks(texts, CHUNK_BYTES):
                sizes = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
                number += 1
                yield pa.RecordBatch.from_pydict({
                    "chunk": [number], "ids": [ids[i:j].tobytes()], "sizes": [sizes.tobytes()],
                    "texts": [compressor.compress(b"".join(texts[i:j]))], "n_bytes": [int(sizes.sum())]})

    spark = docs.sparkSession
    name = f"spans_{uuid.uuid4().hex}"
    made = docs.mapInArrow(run, "chunk bigint, ids binary, sizes binary, texts binary, n_bytes bigint")
    (made.write.bucketBy(2 * scan_partitions(spark), "chunk").option("path", shared_folder(spark))
     .option("compression", "uncompressed").saveAsTable(name))
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the plan knows them
    return chunks


def _each(chunks: DataFrame, answers: list[DataFrame], bits: int, schema: str, make) -> DataFrame:
    """make(chunk number, Chunk) -> columns, for every chunk with the answers so
    far. Only answers are shuffled."""
    if answers:
        every = answers[0]
        for more in answers[1:]:
            every = every.union(more)
        grouped = every.groupBy("chunk").agg(F.collect_list(F.struct("phase", "bucket", "answer")).alias("answers"))
        rows = chunks.join(grouped.hint("shuffle_hash"), "chunk", "left")
    else:
        rows = chunks.withColumn("answers", F.lit(None).cast("array<struct<phase:int,bucket:bigint,answer:binary>>"))
    rows = rows.select("chunk", "ids", "sizes", "texts", "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, ids, sizes, texts, got = (c[k].as_py() for c in batch.columns)
                yield from make(number, Chunk(ids, sizes, texts, bits, got))

    return rows.mapInArrow(run, schema)


def _rows(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows)


_ANSWER = "chunk bigint, phase int, bucket bigint, answer binary"


def _answers(group: pa.Table, phase: int, answers: list[bytes]) -> pa.Table:
    return pa.table({"chunk": group["chunk"], "phase": pa.array([phase] * group.num_rows, pa.int32()),
                     "bucket": group["bucket"], "answer": pa.array(answers, pa.binary())})


def _send_anchors(chunks: DataFrame, bits: int) -> DataFrame:
    def make(number: int, c: Chunk):
        tails = c.tails(c.anchors)
        yield from _rows([{"chunk": number, "bucket": b, "tails": tails[a:z].tobytes()}
                          for b, a, z in c.buckets(c.anchors)])

    sent = _each(chunks, [], bits, "chunk bigint, bucket bigint, tails binary", make)

    def answer(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint32) for x in group["tails"]]
        every = np.concatenate(parts)
        every.sort()
        twice = every[1:][every[1:] == every[:-1]]
        twice = twice[np.append(True, twice[1:] != twice[:-1])[: len(twice)]]
        out = []
        for p in parts:
            at = np.minimum(np.searchsorted(twice, p), max(0, len(twice) - 1))
            out.append(np.packbits(twice[at] == p if len(twice) else np.zeros(len(p), bool)).tobytes())
        return _answers(group, 1, out)

    return stored(sent.groupBy("bucket").applyInArrow(answer, _ANSWER))


def _send_runs(chunks: DataFrame, answers: list[DataFrame], bits: int) -> DataFrame:
    def make(number: int, c: Chunk):
        c.shared()
        anchors = c.runs.anchor[c.sample]
        tails, whole = c.tails(anchors), c.runs.whole[c.sample]
        rows = []
        for b, a, z in c.buckets(anchors):
            ids, place = np.unique(c.class_id[a:z], return_inverse=True)
            rows.append({"chunk": number, "bucket": b, "tails": tails[a:z].tobytes(), "whole": _six(whole[a:z]),
                         "ids": ids.tobytes(),
                         "place": place.astype(np.uint16 if len(ids) < 65536 else np.uint32).tobytes()})
        yield from _rows(rows)

    sent = _each(chunks, answers, bits,
                 "chunk bigint, bucket bigint, tails binary, whole binary, ids binary, place binary", make)

    def answer(group: pa.Table) -> pa.Table:
        tails, whole, ids = [], [], []
        for t, w, i, p in zip(*(group[c].to_pylist() for c in ("tails", "whole", "ids", "place")), strict=True):
            tails.append(np.frombuffer(t, np.uint32))
            whole.append(_un_six(w))
            own = np.frombuffer(i, np.int64)
            ids.append(own[np.frombuffer(p, np.uint16 if len(own) < 65536 else np.uint32)])
        cuts = np.cumsum([len(t) for t in tails])[:-1]
        tail, full, doc = np.concatenate(tails), np.concatenate(whole), np.concatenate(ids)
        order = np.lexsort((doc, full, tail))
        t, w, d = tail[order], full[order], doc[order]
        new = np.ones(len(order), bool)
        new_anchor = np.ones(len(order), bool)
        new_anchor[1:] = t[1:] != t[:-1]
        new[1:] = new_anchor[1:] | (w[1:] != w[:-1])
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
        codes = np.empty(len(order), np.uint8)
        codes[order] = np.where(d > least, 1, np.where(kinds > 1, 2, 0))
        return _answers(group, 2, [x.tobytes() for x in np.split(codes, cuts)])

    return stored(sent.groupBy("bucket").applyInArrow(answer, _ANSWER))


def _send_bytes(chunks: DataFrame, answers: list[DataFrame], bits: int) -> DataFrame:
    def make(number: int, c: Chunk):
        c.shared()
        c.unsettled()
        runs = c.sample[c.asked]
        at = c.base[c.runs.doc[runs]] + c.runs.first[runs]
        size = c.runs.count[runs]
        rows = []
        for b, a, z in c.buckets(c.runs.anchor[runs]):
            parts = [c.data[s: s + n + SPAN - 1] for s, n in zip(at[a:z].tolist(), size[a:z].tolist(), strict=True)]
            rows.append({"chunk": number, "bucket": b, "data": b"".join(parts),
                         "counts": size[a:z].astype(np.uint8).tobytes(), "ids": c.class_id[c.asked[a:z]].tobytes()})
        yield from _rows(rows)

    sent = _each(chunks, answers, bits, "chunk bigint, bucket bigint, data binary, counts binary, ids binary", make)

    def answer(group: pa.Table) -> pa.Table:
        data = b"".join(group["data"].to_pylist()) + bytes(SPAN)
        counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in group["counts"].to_pylist()]
        cuts = np.cumsum([len(x) for x in counts])[:-1]
        count = np.concatenate(counts)
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in group["ids"].to_pylist()])
        size = count + SPAN - 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = np.repeat(np.cumsum(size) - size, count) + nth
        again = repeats(data, starts, np.repeat(ids, count))
        masks = np.bitwise_or.reduceat(again.astype(np.uint32) << nth.astype(np.uint32), np.cumsum(count) - count)
        return _answers(group, 3, [x.astype(np.uint32).tobytes() for x in np.split(masks, cuts)])

    return stored(sent.groupBy("bucket").applyInArrow(answer, _ANSWER))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the maximal removed runs as
    array<struct<from, to>> and the bytes that stay, one row per row of docs."""
    chunks = _chunks(rows_of(docs, {"doc_id": doc_id, "text": text}).withColumn("doc_id", F.col("doc_id").cast("bigint")))
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, total * 0.075 / _PER_BUCKET))))
    answers = [_send_anchors(chunks, bits)]
    answers.append(_send_runs(chunks, answers, bits))
    answers.append(_send_bytes(chunks, answers, bits))

    def make(number: int, c: Chunk):
        c.shared()
        c.unsettled()
        gone = c.removed()
        data = np.frombuffer(c.data, np.uint8)
        ids, spans, kept = [], [], []
        for i, (base, text) in enumerate(zip(c.base.tolist(), c.texts, strict=True)):
            own = gone[base: base + len(text)]
            edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).reshape(-1, 2) if own.any() else ()
            spans.append([{"from": int(a), "to": int(b)} for a, b in edges])
            kept.append(data[base: base + len(text)][~own].tobytes() if len(edges) else text)
            ids.append(None if c.ids[i] == _NO_ID else int(c.ids[i]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in c.texts], pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"])

    return _each(chunks, answers, bits, "doc_id bigint, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, "
                                        "kept binary", make)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    done = deduplicate(docs, doc_id, text)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["to"] - s["from"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))
