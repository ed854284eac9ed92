"""Alignment of the token sequences of two tokenizers over whole texts.

Both tokenizers cut the same bytes (a space and the text), so a token is its end
offset. Offsets at which tokens of both end cut the sequences into groups. They
are found by diagonal run skipping: at the current index shift between the two
end arrays, slices of doubling length are compared, so that stretches of tokens
that correspond one to one are jumped over; where the slices differ the run is
narrowed down by halving, the irregular group behind it is resolved token by token
up to the next common end, and the shift there is the new one.

A link is a pair of tokens, one of each side, whose byte ranges end together.
Counts of linked id pairs over the corpus come from one aggregate of per-document
counts, which combine in the tasks before they are shuffled; hot pairs are joined
back with a checked broadcast or, beyond its limit, by a shuffle in which skewed
pairs are split by the adaptive join.

Defined cases: a null or empty text, and one that either tokenizer does not give
back byte for byte, has no tokens: all numbers are 0 and the digest is empty.
Strings of special tokens inside a text are plain text. Rows with equal ids are
documents each; other columns stay out of the way; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_checked
from .common import as_bytes, blocks, held, rows_of, stored
from .tokens import byte_values, encoder, public_path

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Bytes of texts aligned at once (a longer text is a block of its own).
BLOCK = 1 << 20
_SPACE = "▁"  # how piece vocabularies write a space


class Side:
    """Ids of texts and, per id, what its token stands for: bytes, their number
    and the decimal forms that end in each of two separators."""

    def __init__(self, tokens: list[bytes], last: bytes):
        self.bytes = np.array([*tokens, b""], object)[:-1]
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.inner = np.array([b"%d," % i for i in range(len(tokens))], object)
        self.last = np.array([b"%d%s" % (i, last) for i in range(len(tokens))], object)


class ByteSide(Side):
    """A byte-level vocabulary of the tokenizers library."""

    def __init__(self, file: str):
        self._encoder = encoder(file, special=False)
        vocabulary = self._encoder.vocabulary()
        values, tokens = byte_values(), [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        super().__init__(tokens, b"|")

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int64) for x in self._encoder.encode([b" " + t for t in texts])]


#: Words whose ids a process remembers, and the longest one that it keeps.
_REMEMBERED, _LONG = 400_000, 64


class PieceSide(Side):
    """A piece vocabulary with byte fallback of the sentencepiece library, which
    sets the space before a text itself. Where no piece reaches over a space and
    texts are taken as they are, the words between single spaces are encoded each
    for itself, once; any other text is encoded whole."""

    def __init__(self, file: str):
        import sentencepiece
        path = file if os.sep in file else public_path(file)
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        odd = "\ufb01\u00bd \uff21 e\u0301\tx"
        self._by_word = (not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
                         and self._model.decode(self._model.encode(odd)) == odd)
        self._known: dict[bytes, bytes] = {}
        super().__init__([self._token(i, p) for i, p in enumerate(pieces)], b";")

    def _token(self, i: int, piece: str) -> bytes:
        return bytes([int(piece[3:-1], 16)]) if self._model.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self._model.encode([t.decode() for t in texts], num_threads=1)
        ends = np.cumsum([0, *map(len, found)]).tolist()
        flat = np.fromiter(chain.from_iterable(found), "<i4", ends[-1]).tobytes()
        return [flat[4 * i: 4 * j] for i, j in pairwise(ends)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self._known) > _REMEMBERED:
            self._known.clear()
        apart = [self._by_word and bool(t) and b"  " not in t and t[:1] != b" " and t[-1:] != b" " for t in texts]
        words = [t.split(b" ") if a else [] for t, a in zip(texts, apart, strict=True)]
        known = self._known
        fresh = list({w for some in words for w in some if w not in known})
        known.update(zip(fresh, self._ids(fresh), strict=True))
        whole = iter(self._ids([t for t, a in zip(texts, apart, strict=True) if not a]))
        out = [b"".join([known[w] for w in some]) if a else next(whole) for some, a in zip(words, apart, strict=True)]
        for w in fresh:
            if len(w) > _LONG:
                del known[w]
        return [np.frombuffer(x, "<i4").astype(np.int64) for x in out]


def sides(file_a: str, file_b: str) -> tuple[Side, Side]:
    return held(f"side {file_a}", lambda: ByteSide(file_a)), held(f"side {file_b}", lambda: PieceSide(file_b))


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b (ascending offsets, the last ones equal) of the offsets
    that both hold, by diagonal run skipping."""
    n, i, j, found = len(a), 0, 0, []
    a, b = [*a, -1], [*b, -2]  # runs end here
    while i < n:
        # An irregular stretch: step on the side that is behind.
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        # A diagonal run from (i, j): probe slices of doubling length, then halve
        # the one that differs.
        k = 1
        if a[i + 1] == b[j + 1]:
            k, step = 2, 2
            while a[i + k: i + k + step] == b[j + k: j + k + step]:
                k += step
                step *= 2
            while step := step // 2:
                if a[i + k: i + k + step] == b[j + k: j + k + step]:
                    k += step
        found += (i, j, k)
        i += k
        j += k
    first_a, first_b, runs = np.array(found, np.int64).reshape(-1, 3).T
    inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(first_a, runs) + inside, np.repeat(first_b, runs) + inside


def _spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def align(texts: list[bytes], a: Side, b: Side) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, str]]:
    """(n_a, n_b, n_groups, linked pairs, their counts, digest) of every text. A
    pair is id A * 2**32 + id B."""
    ids_a, ids_b = a.encode(texts), b.encode(texts)
    none = np.zeros(0, np.int64)
    for t, text in enumerate(texts):
        if not text or b"".join(a.bytes[ids_a[t]].tolist()) != b" " + text or b"".join(b.bytes[ids_b[t]].tolist()) != b" " + text:
            ids_a[t] = ids_b[t] = none
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (ids_a, ids_b))
    flat_a, flat_b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
    # Texts follow each other, and each ends in a common end, so one pass serves all.
    at_a, at_b = common_ends(np.cumsum(a.size[flat_a]).tolist(), np.cumsum(b.size[flat_b]).tolist())
    pairs = flat_a[at_a] << 32 | flat_b[at_b]
    # The written groups: A's tokens of a group, then B's, each with its separator.
    written_a, written_b = a.inner[flat_a], b.inner[flat_b]
    written_a[at_a], written_b[at_b] = a.last[flat_a[at_a]], b.last[flat_b[at_b]]
    size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    out = np.empty(len(flat_a) + len(flat_b), object)
    out[np.arange(len(flat_a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = written_a
    out[np.arange(len(flat_b)) + np.repeat(np.cumsum(size_a), size_b)] = written_b
    (from_a, to_a), (from_b, to_b) = _spans(n_a), _spans(n_b)
    first, last = np.searchsorted(at_a, from_a), np.searchsorted(at_a, to_a)
    for t in range(len(texts)):
        found, counts = np.unique(pairs[first[t]: last[t]], return_counts=True)
        whole = b"".join(out[from_a[t] + from_b[t]: to_a[t] + to_b[t]].tolist())[:-1]
        yield (int(n_a[t]), int(n_b[t]), int(last[t] - first[t]), found, counts,
               hashlib.sha256(whole).hexdigest() if n_a[t] else "")


_SCHEMA = ("doc_id {}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, "
           "counts array<bigint>")


def alignments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", file_a: str = TOKENIZER_A,
               file_b: str = TOKENIZER_B) -> DataFrame:
    """One row per document: the numbers of tokens and groups, the digest of the
    groups, and the distinct linked pairs with how often each is linked."""
    rows = rows_of(docs, {"doc_id": doc_id, "text": text})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(file_a, file_b)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for low, high in blocks(texts, BLOCK):
                n_a, n_b, groups, pairs, counts, digest = zip(*align(texts[low:high], a, b), strict=True)
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                     pa.array(groups, pa.int64()), pa.array(digest, pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs), pa.int64())),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts), pa.int64()))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts"])

    return rows.mapInArrow(run, _SCHEMA.format(dict(rows.dtypes)["doc_id"]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) over the corpus: how many links hold the pair, and
    whether no other id of A is linked more often with its id of B."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    counts = stored(counts.withColumn("id_b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    # One row per id of B: as many as the vocabulary has.
    most = broadcast_checked(counts.groupBy(F.col("id_b").alias("_b")).agg(F.max("count").alias("most")))
    return counts.join(most, F.col("id_b") == F.col("_b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def linked(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups_sha256."""
    aligned = stored(alignments(docs, **options).withColumn("row", F.monotonically_increasing_id()))
    counts = broadcast_checked(stored(pair_counts(aligned)))
    seen = aligned.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(
        "row", F.col("p.pairs").alias("own"), F.col("p.counts").alias("times"))
    sums = seen.join(counts, F.col("own") == F.col("pair")).groupBy(F.col("row").alias("_row")).agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return aligned.drop("pairs", "counts").join(sums, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                              for c in ("n_links", "n_best", "count_sum")], "groups_sha256")
