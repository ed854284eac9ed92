"""Quality rules with adaptive thresholds.

Base counts come from whole texts. The verdict compares five ratios with fences
that the corpus sets itself: per language and source, a mergeable quantile
sketch of each ratio (logarithmic buckets with counts, relative error 0.25 %)
gives the quartiles and the outer tenths, and a document fails outside quartile
-/+ reach * spread. Spread is the interquartile range; a floor far below the
usual one serves groups of ties. Reach follows the group's own tail, by how far
its outer tenth lies from the quartile, within REACH: outliers, if fewer than a
quarter, cannot carry the fence along. SLACK events are forgiven in every share,
since one symbol is much in a text of twenty words. Sketches merge by adding
counts, so groups with few documents use those of their language, or of the
whole corpus.

Defined cases: a null text has no words and fails; null languages or sources
form groups of their own; repeated rows count as often as they occur; an empty
table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import broadcast_checked
from .common import SPACE, Block, as_bytes, blocks, mix, stored, windows

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
#: Least and greatest number of spreads beyond the quartile at which a document fails.
REACH = (4.0, 10.0)
#: Distances from quartile to outer tenth: an exponential tail leaves 1e-5 beyond.
TAIL = 11.0
#: Events forgiven in the numerator of a share.
SLACK = 3
#: Ratio: the spread of ties, and whether it may also be too low.
RATIOS = {"word_length": (0.02, True), "symbol_share": (0.005, False), "upper_share": (0.0005, False),
          "dup_line_share": (0.05, False), "doubled_word_share": (0.001, False)}
#: Documents a (language, source) sketch needs; with fewer, wider groups decide.
MIN_GROUP = 100
GAMMA = 1.005
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper",
           "n_doubled_words")


def count_block(texts: list[bytes]) -> np.ndarray:
    """One row of _COUNTS per text."""
    b = Block(texts)
    data = b.data
    start, end, doc = b.words()
    n = len(texts)
    out = np.zeros((len(_COUNTS), n), np.int64)
    out[0] = np.bincount(doc, minlength=n)
    out[1] = b.per_document(~SPACE[data] & ((data & 0xC0) != 0x80))
    out[2] = b.per_document(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    out[6] = b.per_document((data >= 65) & (data <= 90))

    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    line_doc = np.searchsorted(b.starts, line_start, "right") - 1
    filled = np.concatenate(([0], np.cumsum(~SPACE[data])))
    has_word = filled[line_end] > filled[line_start]
    key = mix(b.hashes(line_start, line_end) + line_doc.astype(np.uint64))[has_word]
    line_doc = line_doc[has_word]
    _, first = np.unique(key, return_index=True)
    out[3] = np.bincount(line_doc, minlength=n)
    out[4] = out[3] - np.bincount(line_doc[first], minlength=n)

    words = b.hashes(start, end)
    doubled = doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]
    out[7] = np.bincount(doubled, minlength=n)

    at, key = windows(words, doc, REPEAT_WINDOW)
    key = mix(key + doc[at].astype(np.uint64))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        hit = at[np.isin(key, twice)]
        edge = np.zeros(len(start) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + REPEAT_WINDOW, -1)
        out[5] = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    return out.T


def with_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                carry: bool = True) -> DataFrame:
    """(row, lang, source, counts): every row of docs as a struct `row` (only
    when carried) with the struct of its counts."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns] if carry else [F.col(f"`{text}`").alias("text")])
    at = docs.columns.index(text) if carry else 0
    rows = docs.select(held.alias("row"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    kept = rows.schema.fields if carry else rows.schema.fields[1:]
    schema = StructType([*kept, *[StructField(c, LongType()) for c in _COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = as_bytes(batch.column(0).field(at))
            counts = np.concatenate([count_block(texts[i:j]) for i, j in blocks(texts)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3 - len(kept):], *[pa.array(np.ascontiguousarray(c)) for c in counts.T]],
                names=[f.name for f in schema.fields])

    done = rows.mapInArrow(run, schema)
    return done.select(*[f.name for f in kept], F.struct(*_COUNTS).alias("counts"))


def _ratios(counts: str = "counts") -> dict[str, tuple[Column, Column]]:
    """Numerator and denominator of every ratio."""
    c = {k: F.col(f"{counts}.{k}") for k in _COUNTS}
    chars, lines, words = (F.greatest(c[k], F.lit(1)) for k in ("word_chars", "n_lines", "n_words"))
    return {"word_length": (c["word_chars"], words), "symbol_share": (c["n_symbols"], chars),
            "upper_share": (c["n_upper"], chars), "dup_line_share": (c["n_dup_lines"], lines),
            "doubled_word_share": (c["n_doubled_words"], words)}


def base_failed(counts: str = "counts") -> Column:
    n, repeat = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): one row per non-empty bucket. Documents
    that fail the base rules do not shape the thresholds."""
    names = list(RATIOS)
    values = _ratios()
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("ratio"), (values[r][0] / values[r][1]).alias("value"))
                                  for i, r in enumerate(names)])).alias("e")
    rows = counted.where(~base_failed()).select("lang", "source", entries)
    bucket = F.when(F.col("e.value") > 0, F.ceil(F.ln("e.value") / F.lit(math.log(GAMMA)))).cast("int")
    return rows.groupBy("lang", "source", F.col("e.ratio").alias("ratio"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


#: Quantiles that set a group's fences.
_POINTS = {"tenth": 0.1, "low": 0.25, "high": 0.75, "ninth": 0.9}


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, docs, tenth, low, high, ninth) of merged sketches."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "ratio")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))).withColumn(
        "docs", F.sum("n").over(group))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(
        F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.ceil(F.col("docs") * q), value))

    return ranked.groupBy(*keys, "ratio").agg(F.first("docs").alias("docs"),
                                              *[quantile(q).alias(c) for c, q in _POINTS.items()])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with low_<ratio> and high_<ratio>."""
    fine, lang, whole = (_quantiles(sketch, k) for k in (["lang", "source"], ["lang"], []))
    lang = lang.select(F.col("lang").alias("l"), F.col("ratio").alias("lr"),
                       *[F.col(c).alias(f"l_{c}") for c in ("docs", *_POINTS)])
    whole = whole.select(F.col("ratio").alias("wr"), *[F.col(c).alias(f"w_{c}") for c in _POINTS])
    joined = fine.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("lr"))).join(
        whole, F.col("ratio") == F.col("wr"))

    def choose(c: str) -> Column:
        return F.when(F.col("docs") >= MIN_GROUP, F.col(c)).when(
            F.col("l_docs") >= MIN_GROUP, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))

    fences = joined.select("lang", "source", "ratio", *[choose(c).alias(c) for c in _POINTS])
    columns = []
    for i, (name, (ties, both)) in enumerate(RATIOS.items()):
        spread = F.greatest(F.col("high") - F.col("low"), F.lit(ties))

        def reach(tail: Column, spread: Column = spread) -> Column:
            return F.least(F.greatest(TAIL * tail / spread, F.lit(REACH[0])), F.lit(REACH[1])) * spread

        low = F.col("low") - reach(F.col("low") - F.col("tenth")) if both else F.lit(-1.0)
        high = F.col("high") + reach(F.col("ninth") - F.col("high"))
        columns += [F.max(F.when(F.col("ratio") == i, low)).alias(f"low_{name}"),
                    F.max(F.when(F.col("ratio") == i, high)).alias(f"high_{name}")]
    return fences.groupBy("lang", "source").agg(*columns)


def judge(counted: DataFrame, fences: DataFrame) -> DataFrame:
    """counted with base_failed and kept, by a join with the fences. A group in
    which every document fails the base rules has no fences and needs none."""
    fences = broadcast_checked(fences.withColumnsRenamed({"lang": "_l", "source": "_s"}))
    joined = counted.join(fences, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")),
                          "left")
    inside = F.lit(True)
    for name, (upper, lower) in _ratios().items():
        slack = 0 if RATIOS[name][1] else SLACK
        inside = inside & (upper / lower >= F.col(f"low_{name}")) & ((upper - slack) / lower <= F.col(f"high_{name}"))
    return joined.select(*counted.columns, base_failed().alias("base_failed"),
                         (~base_failed() & F.coalesce(inside, F.lit(True))).alias("kept"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Thresholds of a corpus, written: one pass over the texts."""
    return stored(thresholds(stored(sketches(with_counts(docs, text, lang, source, carry=False)))))


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, columns unchanged."""
    judged = judge(with_counts(docs, text, lang, source), fit(docs, text, lang, source))
    return judged.where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             source: str = "source") -> DataFrame:
    """(doc_id, counts, base_failed, kept), one row per document: one pass over
    the texts."""
    few = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                      F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    counted = stored(with_counts(few).select(F.col("row.doc_id").alias("doc_id"), "lang", "source", "counts"))
    judged = judge(counted, stored(thresholds(stored(sketches(counted)))))
    return judged.select("doc_id", "counts", "base_failed", "kept")
