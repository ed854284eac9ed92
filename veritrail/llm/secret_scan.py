"""Secret scans with corpus-wide ownership frequency. DataFrame operations only.

Base kinds are patterns over the whole text. Candidates of a further kind,
`live`, are long mixed-class tokens. The hash of every candidate, base ones
included (of an assignment, its value), is aggregated over the corpus by distinct
repositories and distinct owners. A value that several owners hold is a widely
copied example; one of a single owner in many repositories is shared by that
owner; any other is a live-looking credential of its owner. Candidates of the
kind `live` become spans unless they are examples; base spans always stay, and
the verdicts on all are counted per row.

Defined cases: a null text is empty; a null repository or owner counts as one of
its own; repeated rows give repeated results; other columns stay out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import running_sums
from .common import rows_of, stored

# The kinds in their order, with pattern, group and least length.
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "live")
# Tokens of the added kind: 24 or more characters with a digit, an upper-case
# and a lower-case letter.
LIVE = r"[A-Za-z0-9+/_-]{24,}"
#: Owners from which on a value is an example, and repositories of a single owner
#: beyond which it is shared.
EXAMPLE_OWNERS = 2
SHARED_REPOSITORIES = 3
VERDICTS = ("example", "shared", "live")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<from, to, hit>> of all matches, leftmost and without
    overlap, in code points. The pieces between matches give the offsets."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    return F.zip_with(running_sums(steps), hits, lambda upto, h: F.struct(
        (upto - F.length(h)).cast("bigint").alias("from"), upto.cast("bigint").alias("to"), h.alias("hit")))


def _kind(text: Column, kind: str) -> Column:
    """Spans of one kind; texts without any are passed over by a plain search.
    For the run patterns, runs of the least length are the same matches."""
    if kind == "assign":
        found = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6)
        test = text.rlike(ASSIGN)
    elif kind == "access":
        pattern = ACCESS[:-1] + "{16,}"
        found, test = spans(text, pattern), text.rlike(pattern)
    elif kind == "hex":
        pattern = HEX[:-1] + "{24,}"
        found, test = spans(text, pattern), text.rlike(pattern)
    else:
        found = F.filter(spans(text, LIVE), lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Z]")
                         & s["hit"].rlike("[a-z]"))
        test = text.rlike(LIVE)
    return F.when(test, found).otherwise(F.array().cast("array<struct<from:bigint,to:bigint,hit:string>>"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id",
         owner: str = "source") -> DataFrame:
    """(doc_id, row_key, repository, owner, base, live): base spans as
    array<struct<from, kind, to, digest>> and candidates of the added kind, in
    one pass over the texts. Secrets themselves leave it only as digests."""
    rows = rows_of(docs, {"doc_id": doc_id, "text": text, "repository": repository, "owner": owner})
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))

    def coded(kind: str) -> Column:
        value = (lambda h: F.regexp_extract(h, ASSIGN, 2)) if kind == "assign" else (lambda h: h)
        return F.transform(_kind(F.col("text"), kind), lambda s: F.struct(
            s["from"].alias("from"), F.lit(KINDS.index(kind)).alias("kind"), s["to"].alias("to"),
            F.sha2(value(s["hit"]), 256).alias("digest")))

    rows = rows.select("doc_id", "repository", "owner", F.sha2("text", 256).alias("row_key"),
                       F.sort_array(F.concat(*[coded(k) for k in KINDS[:3]])).alias("base"),
                       coded("live").alias("live"))
    apart = F.filter("live", lambda s: ~F.exists("base", lambda b: (b["from"] < s["to"]) & (s["from"] < b["to"])))
    return rows.withColumn("live", apart)


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_repositories, n_owners, verdict) of every candidate value, base
    or not, over the corpus. Copies combine before each shuffle; the rows that
    hold a value never meet in one task."""
    seen = found.select(F.explode(F.concat("base", "live")).alias("s"), "repository", "owner").select(
        F.col("s.digest").alias("digest"), "repository", "owner")
    once = seen.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("digest", "owner").agg(F.sum("one").alias("n"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")).withColumn(
        "verdict", F.when(F.col("n_owners") >= EXAMPLE_OWNERS, VERDICTS[0])
        .when(F.col("n_repositories") > SHARED_REPOSITORIES, VERDICTS[1]).otherwise(VERDICTS[2]))


def scan(docs: DataFrame, **columns) -> DataFrame:
    """One row per row of docs: doc_id, base, spans (base and the candidates of
    the added kind that are no examples) and, over candidates of all kinds,
    n_example, n_shared and n_live."""
    found = stored(find(docs, **columns))
    owners = stored(ownership(found).select(F.col("digest").alias("_digest"), "verdict"))
    hits = found.select("doc_id", "row_key", F.explode(F.concat("base", "live")).alias("s")).distinct().join(
        owners, F.col("s.digest") == F.col("_digest"))
    added = (F.col("s.kind") == KINDS.index("live")) & (F.col("verdict") != VERDICTS[0])
    judged = hits.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(
        F.collect_list(F.when(added, F.col("s"))).alias("added"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS])
    joined = found.join(judged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left")
    none = F.array().cast("array<struct<from:bigint,kind:int,to:bigint,digest:string>>")
    return joined.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", none))).alias("spans"),
                         *[F.coalesce(f"n_{v}", F.lit(0)).cast("bigint").alias(f"n_{v}") for v in VERDICTS])


def n_of_kind(spans_column: str, kind: str) -> Column:
    number = KINDS.index(kind)

    def same(span: Column) -> Column:
        return span["kind"] == number

    return F.size(F.filter(spans_column, same)).cast("bigint")


def written(array: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(array, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["from"].cast("string"), s["to"].cast("string"))), ",")
