"""Pairs of titles that may be within the duplicate threshold.

Two titles of n and m characters are within it when one becomes the other by at
most (n + m) / 10 insertions and deletions. Low-entropy texts share nearly all
their short pieces, so no piece of a title is a selective key. What is: first
author, scope and length band decide which titles meet at all, in cells of
bounded size that are worked on independently. Inside a cell every pair is
tested, but cheaply and never as a row:

1. twice 64 bits per title, each saying whether a character class occurs at least so
   often, the classes and numbers being those that divide the cell's titles best.
   Every differing bit is an insertion or deletion, so the bits are a bound;
2. all the counts of 32 character classes;
3. the longest common subsequence over 64 character classes, one machine word per
   64 characters, for many pairs at a time.

Each test only drops pairs that are over the threshold, for titles of any length
and alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unnest
from ..session import broadcast_checked, cut_lineage

# Bands of lengths grow by this factor; titles within the threshold differ by 11/9
# at most, so they are in the same band or in two that follow each other.
BAND = 1.25

_SELF, _LEFT, _RIGHT = 0, 1, 2
_PAIRS = "a BIGINT, b BIGINT"
# Rows of small cells that are worked on together, and pairs of one numpy step.
_BATCH_ROWS = 10_000
_STEP = (256, 2_048)
_LCS_PAIRS = 8_192
_COUNTS, _CLASSES = 32, 64


def _meetings(scope: Sequence[str]) -> Column:
    """{key, side} of a title: its own band, the bands beside it under the same
    name, and, as either side may lack a name, those of unknown with known names."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")
    spot = lambda kind, name, at, side: F.struct(
        F.xxhash64(*[F.col(c) for c in scope], F.lit(kind), name, at).alias("key"), F.lit(side).cast("int").alias("side"))
    last, unnamed = F.col("last"), F.lit("")
    same = [spot("same", last, band, _SELF), spot("next", last, band + 1, _LEFT), spot("next", last, band, _RIGHT)]
    return F.when(F.col("last") == "", F.array(*same, *[spot("any", unnamed, band + d, _LEFT) for d in (-1, 0, 1)])).otherwise(
        F.array(*same, spot("any", unnamed, band, _RIGHT)))


def _cells(rows: DataFrame, cell_rows: int) -> DataFrame:
    """Rows with the cell they meet in (key, bi, bj) and their role in it. A key of
    more rows than a cell takes is cut into blocks by id: the two sides meet in the
    cells of their block pairs, a key's own rows in those with bi <= bj. Every pair
    of a key shares one cell."""
    counted = rows.groupBy("key", "side").count().where(F.col("count") > cell_rows).groupBy("key").agg(
        *[F.max(F.when(F.col("side") == s, F.ceil(F.col("count") / cell_rows))).cast("int").alias(f"k{s}") for s in (_SELF, _LEFT, _RIGHT)])
    cut = rows.join(broadcast_checked(cut_lineage(counted)), "key", "left")
    blocks = lambda s: F.coalesce(F.col(f"k{s}"), F.lit(1))
    own = lambda s: F.pmod(F.xxhash64("id"), blocks(s)).cast("int")
    others = lambda s: F.sequence(F.lit(0), blocks(s) - 1)
    cell = lambda i, j, role: F.struct(i.cast("int").alias("bi"), j.cast("int").alias("bj"), role.cast("int").alias("role"))
    inside = F.transform(others(_SELF), lambda j: cell(
        F.least(own(_SELF), j), F.greatest(own(_SELF), j),
        F.when(own(_SELF) == j, _SELF).when(own(_SELF) < j, _LEFT).otherwise(_RIGHT)))
    spots = F.when(F.col("side") == _SELF, inside).when(
        F.col("side") == _LEFT, F.transform(others(_RIGHT), lambda j: cell(own(_LEFT), j, F.lit(_LEFT)))).otherwise(
        F.transform(others(_LEFT), lambda i: cell(i, own(_RIGHT), F.lit(_RIGHT))))
    return unnest(cut, spots, "key", "id", "n", "open", "title", value="s").select(
        "key", "s.bi", "s.bj", "s.role", "n", "id", "open", "title")


def title_candidates(known: DataFrame, scope: Sequence[str] = (), cell_rows: int = 20_000) -> DataFrame:
    """(a, b) ids of nodes that pass all tests above, each pair once.

    known: scope..., id, title (normalised, not empty), n (its length), last (empty
    if unknown), open; one of the two is open, their last names agree or one is
    unknown."""
    rows = unnest(known, _meetings(scope), "id", "n", "open", "title", value="m").select(
        "m.key", "m.side", "id", "n", "open", "title")
    cells = ["key", "bi", "bj"]
    dealt = _cells(rows, cell_rows).repartition(*cells).sortWithinPartitions(*cells, "role", "n")
    return dealt.mapInArrow(_met, _PAIRS)


# --- inside a task ----------------------------------------------------------------

def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by cell; whole cells are worked on, small ones together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < _BATCH_ROWS:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table)
        held, rows = table.slice(starts[-1]).to_batches(), len(table) - int(starts[-1])
        if starts[-1]:
            yield from _work(table.slice(0, starts[-1]), starts[:-1])
    if held:
        table = pa.Table.from_batches(held)
        yield from _work(table, _starts(table))


def _starts(table: pa.Table) -> np.ndarray:
    """Row numbers at which a cell begins."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for c in ("key", "bi", "bj"):
        values = table[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


class _Titles:
    """Lengths, code points and counts of the titles of a table."""

    def __init__(self, titles: list[str]):
        self.n = np.array([len(t) for t in titles], np.int64)
        self.codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.cumsum(self.n) - self.n
        spot = np.repeat(np.arange(len(titles)) * _COUNTS, self.n) + self.codes % _COUNTS
        counts = np.bincount(spot, minlength=len(titles) * _COUNTS).reshape(-1, _COUNTS)
        self.counts = np.minimum(counts, 255).astype(np.uint8)

    def slack(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.n[a] + self.n[b]) // 10

    def classes(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Character classes of the rows, filled up with one that occurs nowhere."""
        place = np.arange(width)
        inside = place < self.n[rows, None]
        return np.where(inside, self.codes[np.where(inside, self.at[rows, None] + place, 0)] % _CLASSES, _CLASSES)


def _work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    role, ids, free = (table[c].to_numpy() for c in ("role", "id", "open"))
    ends = np.append(starts[1:], len(table))
    lefts = np.add.reduceat(role != _RIGHT, starts, dtype=np.int64)
    rights = np.add.reduceat(role != _LEFT, starts, dtype=np.int64)
    own = role[starts] == _SELF
    meet = np.where(own, ends - starts > 1, (lefts > 0) & (rights > 0))
    if not meet.any():
        return
    texts = _Titles(table["title"].to_pylist())
    waiting, pairs = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        for a, b in _common(texts, *np.concatenate(waiting, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["a", "b"])

    for start, end, left, self_ in zip(starts[meet], ends[meet], lefts[meet], own[meet]):
        sides = (start, end, start, end) if self_ else (start, start + left, start + left, end)
        for a, b in _near_counts(texts, free, *(int(x) for x in sides)):
            waiting.append(np.stack([a, b]))
            pairs += len(a)
            if pairs >= _LCS_PAIRS * 8:
                yield from flush()
                waiting, pairs = [], 0
    if waiting:
        yield from flush()


def _bits(counts: np.ndarray) -> np.ndarray:
    """Two words of 64 bits per row: whether a class occurs at least so often, of the
    classes and numbers that hold for about half of the rows, the best in the first."""
    least = np.stack([np.bincount(c, minlength=256)[::-1].cumsum()[::-1] for c in counts.T]) / len(counts)
    worth = least * (1 - least)
    words = np.zeros((2, len(counts)), np.uint64)
    for bit, spot in enumerate(np.argsort(-worth, axis=None, kind="stable")[:128]):
        words[bit // 64] |= (counts[:, spot // 256] >= spot % 256).astype(np.uint64) << np.uint64(bit % 64)
    return words


def _near_counts(texts: _Titles, free: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs, of a0..a1 and b0..b1 (both sorted by length), whose lengths and
    counts are near enough. Within one range each pair is taken once."""
    same, n = a0 == b0, texts.n
    height, width = _STEP
    large = (a1 - a0) * (b1 - b0) > height * width // 8
    if large:
        low = min(a0, b0)
        bits, more = _bits(texts.counts[low:max(a1, b1)])
        differ, number, few = np.empty(_STEP, np.uint64), np.empty(_STEP, np.uint8), np.empty(_STEP, bool)
    for i in range(a0, a1, height):
        end = min(i + height, a1)
        first = i if same else b0 + int(np.searchsorted(n[b0:b1], -(-n[i] * 9 // 11)))
        last = b0 + int(np.searchsorted(n[b0:b1], n[end - 1] * 11 // 9, "right"))
        for j in range(first, last, width):
            stop = min(j + width, last)
            if large:
                tall, wide = end - i, stop - j
                x, y = differ[:tall, :wide], number[:tall, :wide]
                np.bitwise_xor(bits[i - low:end - low, None], bits[None, j - low:stop - low], out=x)
                np.bitwise_count(x, out=y)
                few[:tall, wide:] = False
                np.less_equal(y, np.uint8(min((n[end - 1] + n[stop - 1]) // 10, 64)), out=few[:tall, :wide])
                # Eight tests are one word; most words are zero.
                flat = few[:tall].reshape(-1)
                some = np.flatnonzero(flat.view(np.uint64))
                at = np.flatnonzero(flat.reshape(-1, 8)[some])
                spots = some[at // 8] * 8 + at % 8
                a, b = spots // width, spots % width
                apart = np.bitwise_count(more[a + (i - low)] ^ more[b + (j - low)]) + number.reshape(-1)[spots]
                a, b = a + i, b + j
                slack = texts.slack(a, b)
                keep = apart <= slack
                a, b, slack = a[keep], b[keep], slack[keep]
            else:
                a, b = (side.reshape(-1) for side in np.mgrid[i:end, j:stop])
                slack = texts.slack(a, b)
            keep = (free[a] | free[b]) & (np.abs(n[a] - n[b]) <= slack)
            if same:
                keep &= a < b
            a, b, slack = a[keep], b[keep], slack[keep]
            apart = np.abs(texts.counts[a].astype(np.int16) - texts.counts[b]).sum(axis=1, dtype=np.int64)
            keep = apart <= slack
            if keep.any():
                yield a[keep], b[keep]


def _common(texts: _Titles, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those pairs whose common subsequence, counting characters of one class as
    equal, is long enough. a is the shorter one; the pairs go by its length, so that a
    step has titles of about one length, and few different ones."""
    turn = texts.n[a] > texts.n[b]
    a, b = np.where(turn, b, a), np.where(turn, a, b)
    order = np.lexsort((a, texts.n[a]))
    a, b = a[order], b[order]
    at = 0
    while at < len(a):
        words = int(-(-texts.n[a[min(at + _LCS_PAIRS, len(a)) - 1]] // 64))
        end = min(at + max(1, _LCS_PAIRS // words), len(a))
        x, y = a[at:end], b[at:end]
        keep = texts.n[x] + texts.n[y] - 2 * _lcs(texts, x, y) <= texts.slack(x, y)
        if keep.any():
            yield x[keep], y[keep]
        at = end


def _lcs(texts: _Titles, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence by classes of each pair: bit rows
    over the characters of a, a step for each character of b (lcs_length in
    functions/text.py, for many pairs and with carries between words)."""
    rows, of = np.unique(a, return_inverse=True)
    longest = int(texts.n[rows].max())
    words = -(-longest // 64)
    shorter = texts.classes(rows, longest)
    places = np.zeros((words, len(rows), _CLASSES + 1), np.uint64)
    every = np.arange(len(rows))
    for k in range(longest):
        places[k // 64, every, shorter[:, k]] |= np.uint64(1 << k % 64)
    places[:, :, _CLASSES] = 0
    longer = np.ascontiguousarray(texts.classes(b, int(texts.n[b].max())).T)
    state = np.full((words, len(a)), ~np.uint64(0))
    base = of * (_CLASSES + 1)
    flat = places.reshape(words, -1)
    for column in longer:
        spot = base + column
        carry = None
        for w in range(words):
            row = state[w]
            hit = row & flat[w][spot]
            total = row + hit
            if words > 1:
                over = total < row
                if carry is not None:
                    more = total + carry
                    over |= more < total
                    total = more
                carry = over.astype(np.uint64)
            state[w] = total | (row ^ hit)
    # A place beyond a title is in no mask and stays set.
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)
