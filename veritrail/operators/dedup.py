"""Deduplication: exact DOI groups first, then near-equal titles.

The title step is order dependent: a record without a DOI joins the first
earlier record it agrees with, and the joined record then carries merged
fields. It is done in three exact moves:

1. copies (same normalised title, year, first author and source) collapse by
   aggregation, at the position of their first member;
2. similar title pairs come from an equi-join on short character pieces and
   only pairs over the threshold leave the join. Records outside every pair
   are finished;
3. the others are taken in order, each group of connected titles on its own: a
   record depends on earlier ones of its group only. A group is replayed in one
   go, with the clusters found by title, first author and year, so its time grows
   with its records and pairs;
4. a group that is too large for that is resolved by a fixpoint: from an
   assignment of records to clusters follow the states every cluster passes
   through (windows over its members), and from these the first cluster that
   agrees with each record at its place in the order (an equi-join on title,
   first author and year, and a minimum). Every round settles at least the next
   record of each group, in practice nearly all, and the assignment that repeats
   itself is the sequential one.

Only matching columns take part, never the abstracts; payloads are merged by the
same aggregation as the DOI groups. Where records compete within small scopes
(the candidates of one search), `bounded` replays every scope in one go instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import normalize_doi, paper_id_of
from ..functions.text import indel_ratio, match_last_name, normalize_title, normalized_similarity
from ..session import broadcast_checked, cut_lineage
from ..sources.mappers import OTHER_PRIORITY, SOURCE_PRIORITY, source_priority
from .components import connected_components
from .merge import authors_quality, merge_records, year_quality
from .titles import title_candidates

# Fixed value: similarity from which two titles count as the same paper.
DUPLICATE_SIMILARITY = 0.90

# Titles that may meet are cut into cells of so many rows of a side.
HOT_BUCKET = 20_000

_ANY = "*"


def merge_by_doi(papers: DataFrame, order: str = "ord", scope: Sequence[str] = (),
                 empty_as_null: bool = False) -> DataFrame:
    """Records with a DOI, merged per normalised DOI (and scope). `doi_key` is
    the normalised DOI, `n` the number of merged records, and `order` becomes
    the position at which the DOI was first seen."""
    keyed = (papers.withColumn("doi_key", normalize_doi(F.col("doi"))).where("doi_key IS NOT NULL")
             .withColumn("prio", source_priority(F.col("source"))))
    merged = merge_records(keyed, [*scope, "doi_key"], ["prio", order], empty_as_null=empty_as_null,
                           least={"first_seen": F.col(order)})
    return merged.withColumn(order, F.col("first_seen")).drop("first_seen", "prio")


def _merge_copies(papers: DataFrame, order: str, scope: Sequence[str], empty_as_null: bool) -> DataFrame:
    """Records without a DOI that agree in everything the matching looks at."""
    keyed = (papers
             .withColumn("_year", F.coalesce("year", F.lit(0)))
             .withColumn("_last", match_last_name(F.col("authors")))
             .withColumn("_src", F.coalesce("source", F.lit("")))
             .withColumn("_apis", F.array_join(F.coalesce("source_apis", F.array().cast("array<string>")), "+")))
    copies = [*scope, "ntitle", "_year", "_last", "_src", "_apis"]
    merged = merge_records(keyed.withColumnRenamed("_apis", "_sources"), [*copies[:-1], "_sources"], [order],
                           rename_single=False, empty_as_null=empty_as_null)
    return merged.withColumn("row_key", _key("open", [*copies[:-1], "_sources"])).drop(
        "_year", "_last", "_src", "_sources")


def _key(kind: str, columns: Sequence[str]) -> Column:
    """Content key of a row: the same after any recomputation."""
    return F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.col(c).cast("string") for c in columns]))


def similar_titles(nodes: DataFrame, scope: Sequence[str] = (),
                   hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b) node pairs with similarity >= 0.90 and agreeing last names, where
    at least one side has no DOI.

    nodes: scope..., node, title (normalised, not empty), n (its length), last,
    open (true for records without a DOI). Exact: name, length, counts and classes
    are necessary conditions, and so is the edit distance behind them."""
    known = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()))
    met = cut_lineage(title_candidates(known, scope, hot_bucket))
    title = lambda side: known.select(F.col("id").alias(side), F.col("node").alias(f"n{side}"), F.col("title").alias(f"t{side}"))
    pairs = met.join(title("a"), "a").join(title("b"), "b").where(F.expr(
        "levenshtein(ta, tb, cast(floor((length(ta) + length(tb)) / 10) as int))") >= 0)
    return pairs.where(normalized_similarity(F.col("ta"), F.col("tb")) >= DUPLICATE_SIMILARITY).select(
        F.col("na").alias("a"), F.col("nb").alias("b"))


# --- the sequential order, in parallel --------------------------------------------

_UNKNOWN_YEAR = 0
_ANY_YEAR = -(1 << 30)


def _history(members: DataFrame) -> DataFrame:
    """Members with what absorbing them did to their cluster: `lead`, `pref` (the
    rank of a member in the merged record) and the cluster's title, last name
    and year behind them. A cluster's priority is that of its only source, or
    the lowest once it has several."""
    w = W.partitionBy("founder.row_key").orderBy("pos")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    first = lambda c: F.first(c).over(upto)
    none = F.array().cast("array<string>")
    nameless = (F.size(first("source_apis")) == 0) & (F.size(F.nth_value("source_apis", 2).over(before)) == 0)
    sources = F.filter(F.array(first("source"), F.nth_value("source", 2).over(before)),
                       lambda x: F.coalesce(x, F.lit("")) != "")
    seen = F.flatten(F.collect_set("source_apis").over(before))
    out = (members.withColumn("_no", F.row_number().over(w))
           .withColumn("_union", F.array_distinct(F.concat(seen, F.when(nameless, sources).otherwise(none))))
           .withColumn("_founder_source", first("source")))
    own = F.when((F.col("_no") == 2) | (F.size("_union") == 0), source_priority(F.col("_founder_source"))).when(
        F.size("_union") == 1, source_priority(F.get("_union", 0))).otherwise(F.lit(OTHER_PRIORITY))
    out = out.withColumn("lead", (F.col("_no") > 1) & (source_priority(F.col("source")) < own))

    def carried(value: str, quality: str) -> Column:
        best = F.max(quality).over(before)
        takes = (F.col("_no") == 1) | (F.col(quality) > best) | (F.col("lead") & (F.col(quality) == best))
        return F.when(takes, F.col(value))

    out = out.withColumn("_t", F.when((F.col("_no") == 1) | F.col("lead"), F.col("tkey"))).withColumn(
        "_l", carried("last", "authors_quality")).withColumn("_y", carried("year", "year_quality"))
    held = lambda c: F.last(c, ignorenulls=True).over(upto)
    follows = (~F.col("lead") & (F.col("_no") > 1)).cast("int")
    pref = F.when(F.col("lead"), -F.sum(F.col("lead").cast("int")).over(upto)).otherwise(F.sum(follows).over(upto))
    return out.withColumns({"state_t": held("_t"), "state_l": held("_l"), "state_y": held("_y"), "pref": pref.cast("int")}).drop(
        "_no", "_union", "_founder_source", "_t", "_l", "_y")


def _versions(history: DataFrame) -> DataFrame:
    """(tkey, last, year, founder, since, until): the states of every cluster and
    the places in the order between which they hold, per key by which a record
    may look for them. Of clusters that never changed only the first of a key
    can be a first match, so one of them stays."""
    w = W.partitionBy("founder.row_key").orderBy("pos")
    changes = history.withColumn("_s", F.struct("state_t", "state_l", "state_y")).withColumn(
        "_before", F.lag("_s").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("_s")))
    spans = changes.select(
        "founder", "state_t", "state_l", "state_y", F.col("pos").alias("since"), F.lead("pos").over(w).alias("until"))
    names = F.when(F.col("state_l") == "", F.array(F.lit(""), F.lit(_ANY))).otherwise(F.array("state_l", F.lit(_ANY)))
    keyed = spans.withColumn("last", F.explode(names)).withColumn("year", F.explode(F.array("state_y", F.lit(_ANY_YEAR)))).select(
        F.col("state_t").alias("tkey"), "last", "year", "founder", "since", "until")
    lasting = F.col("until").isNull() & (F.col("since") == F.col("founder.pos"))
    still = keyed.where(lasting).groupBy("tkey", "last", "year").agg(F.min("founder").alias("founder")).select(
        "tkey", "last", "year", "founder", F.col("founder.pos").alias("since"))
    return keyed.where(~lasting).unionByName(still, allowMissingColumns=True)


def _first_agreeing(rows: DataFrame, near: DataFrame, versions: DataFrame) -> DataFrame:
    """(row_key, found): the first cluster whose state agrees with the record when
    its turn comes."""
    names = F.when(F.col("last") == "", F.array(F.lit(_ANY))).otherwise(F.array("last", F.lit("")))
    years = F.when(F.col("year") == _UNKNOWN_YEAR, F.array(F.lit(_ANY_YEAR))).otherwise(
        F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1, F.lit(_UNKNOWN_YEAR)))
    probes = (rows.where("not has_doi").select("row_key", "pos", F.col("tkey").alias("mine"), names.alias("names"), years.alias("years"))
              .join(near, "mine").withColumn("last", F.explode("names")).withColumn("year", F.explode("years"))
              .select("row_key", "pos", F.col("theirs").alias("tkey"), "last", "year"))
    met = probes.join(versions, ["tkey", "last", "year"]).where(
        (F.col("since") < F.col("pos")) & (F.col("until").isNull() | (F.col("pos") <= F.col("until"))))
    return met.groupBy("row_key").agg(F.min("founder").alias("found"))


def resolve_first_match(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Members of clusters with two or more records, as (row_key, cluster, pref).

    rows: row_key, pos, tkey, last, year, qualities, source, source_apis,
    has_doi; near: (mine, theirs) pairs of equal or similar titles. Every round
    is written, so a lost executor repeats one round at most."""
    own = F.struct("pos", "row_key")
    assigned = cut_lineage(rows.withColumn("founder", own))
    moved = True
    while moved:
        found = _first_agreeing(rows, near, _versions(_history(assigned)))
        ahead = assigned.join(found, "row_key", "left").withColumn("_next", F.coalesce("found", own))
        ahead = cut_lineage(ahead.withColumn("_moved", F.col("_next.row_key") != F.col("founder.row_key")).drop("found"))
        moved = ahead.where("_moved").limit(1).count() > 0
        assigned = ahead.withColumn("founder", F.col("_next")).drop("_next", "_moved")
    several = assigned.groupBy(F.col("founder.row_key").alias("_f")).count().where("count > 1").select("_f")
    kept = assigned.join(several, F.col("founder.row_key") == F.col("_f"), "left_semi")
    return _history(kept).select("row_key", F.col("founder.row_key").alias("cluster"), "pref")


# --- small scopes -----------------------------------------------------------------

_REPLAYED = "row_key STRING, cluster STRING, pref INT"
#: A scope with more records than this is not replayed in one go.
SCOPE_ROWS = 2_000


def _priority(source: str | None) -> int:
    return SOURCE_PRIORITY.get(source or "", OTHER_PRIORITY)


class _Cluster:
    """Matching columns of a merged record and the rank of its members."""

    __slots__ = ("key", "title", "last", "quality", "year", "year_quality", "apis", "source", "members", "front", "back")

    def __init__(self, row):
        self.key, self.title, self.last, self.quality = row.row_key, row.title, row.last, row.authors_quality
        self.year, self.year_quality = row.year, row.year_quality
        self.apis, self.source = list(row.source_apis), row.source
        self.members = [(row.row_key, 0)]
        self.front = self.back = 0

    def fits(self, row) -> bool:
        if row.year and self.year and abs(row.year - self.year) > 1:
            return False
        return not (row.last and self.last and row.last != self.last)

    def agrees(self, row) -> bool:
        return self.fits(row) and indel_ratio(row.title, self.title) >= DUPLICATE_SIMILARITY

    def absorb(self, row) -> None:
        leads = _priority(row.source) < _priority(self.source)
        if leads:
            self.front -= 1
            self.title = row.title
        else:
            self.back += 1
        self.members.append((row.row_key, self.front if leads else self.back))
        if row.authors_quality > self.quality or (leads and row.authors_quality == self.quality):
            self.last, self.quality = row.last, row.authors_quality
        if row.year_quality > self.year_quality or (leads and row.year_quality == self.year_quality):
            self.year, self.year_quality = row.year, row.year_quality
        mine, theirs = (list(row.source_apis), self.apis) if leads else (self.apis, list(row.source_apis))
        union = list(dict.fromkeys([*mine, *theirs]))
        if not union:
            pair = (row.source, self.source) if leads else (self.source, row.source)
            union = list(dict.fromkeys(s for s in pair if s))
        self.apis = union
        self.source = "+".join(s or "" for s in union) if union else self.source


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by scope and position; only the clusters of the current
    scope are held."""
    scope, clusters = None, []

    def flush() -> pd.DataFrame:
        rows = [(key, c.key, pref) for c in clusters if len(c.members) > 1 for key, pref in c.members]
        return pd.DataFrame(rows, columns=["row_key", "cluster", "pref"])

    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.scope_key != scope:
                if clusters:
                    yield flush()
                scope, clusters = row.scope_key, []
            home = None if row.has_doi else next((c for c in clusters if c.agrees(row)), None)
            if home is None:
                clusters.append(_Cluster(row))
            else:
                home.absorb(row)
    if clusters:
        yield flush()


# --- groups of connected titles ---------------------------------------------------

#: A group is replayed in one go up to this many look-ups among its titles, a record
#: counting as RECORD_WORK of them; what a task holds is in proportion to them.
GROUP_WORK = 3_000_000
RECORD_WORK = 8
# Clusters of one title up to which they are looked through one by one.
_FEW = 8


class _Group:
    """The clusters of one group, by what a record may look for: the title, and for
    titles of many clusters also the name and year."""

    def __init__(self):
        self.near: dict[str, list[str]] = {}
        self.clusters: list[_Cluster] = []
        self.few: dict[str, list[int]] = {}
        self.many: set[str] = set()
        self.places: dict[tuple, list[int]] = {}
        self.waiting: list[tuple] = []

    def _show(self, c: int) -> None:
        """Cluster c can be found by its present state from now on."""
        title, new = self.clusters[c].title, [c]
        if title not in self.many:
            held = self.few.setdefault(title, [])
            if c not in held:
                held.append(c)
            if len(held) <= _FEW:
                return
            self.many.add(title)
            new = [x for x in self.few.pop(title) if self.clusters[x].title == title]
        for x in new:
            cluster = self.clusters[x]
            for last in {cluster.last, _ANY}:
                for year in {cluster.year, _ANY_YEAR}:
                    heappush(self.places.setdefault((title, last, year), []), x)

    def _first(self, key: tuple) -> int | None:
        """The first cluster that shows the key; entries of passed states go."""
        heap = self.places.get(key)
        while heap:
            c = self.clusters[heap[0]]
            if c.title == key[0] and key[1] in (c.last, _ANY) and key[2] in (c.year, _ANY_YEAR):
                return heap[0]
            heappop(heap)
        return None

    def _agreeing(self, row, title: str) -> Iterator[int | None]:
        if title in self.many:
            names = (_ANY,) if row.last == "" else (row.last, "")
            years = (_ANY_YEAR,) if row.year == _UNKNOWN_YEAR else (row.year - 1, row.year, row.year + 1, _UNKNOWN_YEAR)
            yield from (self._first((title, last, year)) for last in names for year in years)
        else:
            yield from (x for x in self.few.get(title, ()) if self.clusters[x].title == title and self.clusters[x].fits(row))

    def home(self, row) -> int | None:
        found = (c for title in self.near.get(row.title, ()) for c in self._agreeing(row, title))
        return min((c for c in found if c is not None), default=None)

    def take(self, row) -> None:
        """Records of one place in the order do not see each other."""
        if not row.tie:
            self.settle()
        self.waiting.append((row, None if row.has_doi else self.home(row)))

    def settle(self) -> None:
        for row, home in self.waiting:
            if home is None:
                home = len(self.clusters)
                self.clusters.append(_Cluster(row))
                self._show(home)
            else:
                cluster = self.clusters[home]
                state = (cluster.title, cluster.last, cluster.year)
                cluster.absorb(row)
                if state != (cluster.title, cluster.last, cluster.year):
                    self._show(home)
        self.waiting = []

    def members(self) -> list[tuple]:
        self.settle()
        return [(key, c.key, pref) for c in self.clusters if len(c.members) > 1 for key, pref in c.members]


def _replay_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by group, a group's pairs of titles before its records
    and these by position; only the current group is held."""
    current, group, names = None, _Group(), {}
    done = lambda: pd.DataFrame(group.members(), columns=["row_key", "cluster", "pref"])
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.group_key != current:
                yield done()
                current, group, names = row.group_key, _Group(), {}
            if row.row_key is None:
                group.near.setdefault(row.title, []).append(names.setdefault(row.theirs, row.theirs))
            else:
                group.take(row)
    yield done()


def _in_groups(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(row_key, cluster, pref) of records in clusters of two or more; rows and
    near as in resolve_first_match."""
    linked = connected_components(near.where("mine < theirs"), "mine", "theirs")
    titles = near.groupBy("mine").agg(F.count(F.lit(1)).alias("pairs")).join(
        linked, F.col("mine") == F.col("node"), "left").select(
        F.col("mine").alias("tkey"), F.coalesce("component", "mine").alias("group_key"), "pairs")
    grouped = cut_lineage(rows.join(titles, "tkey"))
    work = grouped.groupBy("group_key").agg(F.sum(F.when(F.col("has_doi"), 0).otherwise(F.col("pairs")) + RECORD_WORK).alias("work"))
    large = cut_lineage(work.where(F.col("work") > GROUP_WORK).select("group_key"))
    several = large.limit(1).count() > 0
    looking = grouped.where("not has_doi").select("tkey", "group_key").distinct()
    pairs = near.join(looking, F.col("mine") == F.col("tkey")).select("group_key", "mine", "theirs")
    replayed = _replayed_groups(*[part.join(broadcast_checked(large), "group_key", "left_anti") if several else part for part in (grouped, pairs)])
    if not several:
        return replayed
    rest = grouped.join(broadcast_checked(large), "group_key", "left_semi").drop("group_key", "pairs")
    return replayed.unionByName(resolve_first_match(rest, near.join(
        rest.select(F.col("tkey").alias("mine")).distinct(), "mine", "left_semi")))


def _replayed_groups(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    records = rows.select("group_key", "pos", "row_key", F.col("tkey").alias("title"), "last", "year", "year_quality",
                          "authors_quality", "source", "source_apis", "has_doi")
    none = {c: F.lit(0) for c in ("year", "year_quality", "authors_quality")} | {"has_doi": F.lit(False)}
    both = records.unionByName(pairs.select(
        "group_key", F.col("mine").alias("title"), "theirs", *[v.alias(c) for c, v in none.items()]), allowMissingColumns=True)
    order = [F.col("row_key").isNotNull(), "pos", "row_key"]
    before = W.partitionBy("group_key").orderBy(*order)
    tie = F.lag("row_key").over(before).isNotNull() & F.lag("pos").over(before).eqNullSafe(F.col("pos"))
    ordered = (both.repartition("group_key").withColumn("tie", F.coalesce(tie, F.lit(False)))
               .sortWithinPartitions("group_key", *order).drop("pos"))
    return ordered.mapInPandas(_replay_groups, _REPLAYED)


def deduplicate(papers: DataFrame, order: str = "ord", scope: Sequence[str] = (),
                keep_doi: bool = False, empty_as_null: bool = False,
                hot_bucket: int = HOT_BUCKET, bounded: bool = False) -> DataFrame:
    """Unified paper rows without duplicates, with `paper_id` and `merged_from`.

    `order` is a unique input position; results sorted by (`doi_first`,
    `order`) are in list order. `scope` columns (a claim, a query) keep their
    records apart. With `keep_doi` a merged record keeps any member's DOI;
    without it the DOI is that of the most trusted member, known or not.
    `bounded` says that a scope holds few records by the way it came about (a
    request's limit); should one hold more than SCOPE_ROWS, all are resolved by
    the fixpoint all the same.
    """
    scope = list(scope)
    known = merge_by_doi(papers, order, scope, empty_as_null)
    open_rows = papers.where(normalize_doi(F.col("doi")).isNull()).withColumn(
        "ntitle", normalize_title(F.col("title")))
    untitled = open_rows.where("ntitle = ''").withColumn("n", F.lit(1).cast("bigint"))
    rows = (known.withColumn("row_key", _key("doi", [*scope, "doi_key"]))
            .withColumn("ntitle", normalize_title(F.col("title"))).withColumn("doi_first", F.lit(0))
            .drop("doi_key")
            .unionByName(_merge_copies(open_rows.where("ntitle <> ''"), order, scope, empty_as_null)
                         .withColumn("doi_first", F.lit(1))))

    light = cut_lineage(_matching_columns(rows.where("ntitle <> ''"), order, scope))
    small = bounded and scope and not light.groupBy(*scope).count().where(F.col("count") > SCOPE_ROWS).limit(1).count()
    clusters = broadcast_checked(cut_lineage(_replayed(light, scope) if small else _clusters(light, scope, hot_bucket)))
    tagged = rows.join(clusters, "row_key", "left")
    joined = tagged.where("cluster IS NOT NULL")
    merged = merge_records(
        joined.withColumn("known_doi", F.col("doi")), ["cluster", *scope], ["pref"],
        empty_as_null=empty_as_null, weight="n",
        least={"founder": F.struct("doi_first", order), "known_doi": F.col("known_doi")})
    merged = merged.withColumn(order, F.col(f"founder.{order}")).withColumn(
        "doi_first", F.col("founder.doi_first"))
    if keep_doi:
        merged = merged.withColumn("doi", F.coalesce("doi", "known_doi"))

    wanted = [c for c in papers.columns if c != "paper_id"] + ["n", "doi_first"]
    out = (tagged.where("cluster IS NULL").select(wanted).unionByName(merged.select(wanted))
           .unionByName(untitled.withColumn("doi_first", F.lit(1)).select(wanted)))
    return out.withColumnRenamed("n", "merged_from").withColumn("paper_id", paper_id_of())


def _matching_columns(rows: DataFrame, order: str, scope: Sequence[str]) -> DataFrame:
    return (rows.withColumn("last", match_last_name(F.col("authors"))).select(
        *scope, "row_key", F.col("ntitle").alias("title"), "last",
        F.coalesce("year", F.lit(0)).alias("year"), year_quality(F.col("year")).alias("year_quality"),
        authors_quality(F.col("authors")).alias("authors_quality"), "source",
        F.coalesce("source_apis", F.array().cast("array<string>")).alias("source_apis"),
        (F.col("doi_first") == 0).alias("has_doi"), F.struct(F.col("doi_first").alias("tier"), F.col(order).alias("at")).alias("pos"),
        _key("title", [*scope, "ntitle"]).alias("tkey"), _key("node", [*scope, "ntitle", "last"]).alias("node")))


def _replayed(light: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Every small scope in order, in one task each."""
    ordered = (light.withColumn("scope_key", _key("scope", scope)).repartition("scope_key")
               .sortWithinPartitions("scope_key", "pos").drop(*scope, "node", "tkey", "pos"))
    return ordered.mapInPandas(_replay, _REPLAYED)


def _clusters(light: DataFrame, scope: Sequence[str], hot_bucket: int) -> DataFrame:
    """(row_key, cluster, pref) of every record that merges with another one."""
    nodes = (light.groupBy(*scope, "node", "tkey", "title", "last")
             .agg(F.count(F.lit(1)).alias("rows"), F.max(~F.col("has_doi")).alias("open"))
             .withColumn("n", F.length("title")))
    pairs = similar_titles(nodes.drop("rows", "tkey"), scope, hot_bucket)
    title_of = lambda side, name: nodes.select(F.col("node").alias(side), F.col("tkey").alias(name))
    met = pairs.join(title_of("a", "mine"), "a").join(title_of("b", "theirs"), "b").select("mine", "theirs")
    # Records of one title are near each other even when no pair names it.
    alike = nodes.groupBy("tkey").agg(F.sum("rows").alias("rows"), F.max("open").alias("open")).where(
        "rows > 1 AND open").select(F.col("tkey").alias("mine"), F.col("tkey").alias("theirs"))
    both = met.unionByName(met.select(F.col("theirs").alias("mine"), F.col("mine").alias("theirs"))).unionByName(alike)
    whole = both.unionByName(both.select("mine", F.col("mine").alias("theirs")))
    near = cut_lineage(whole.distinct())
    rows = light.join(near.select(F.col("mine").alias("tkey")).distinct(), "tkey", "left_semi").drop(*scope, "node", "title")
    return _in_groups(rows, near)


def deduplicate_pairs(first: DataFrame, second: DataFrame, order: str = "ord", **options) -> DataFrame:
    """Merge two lists that are already free of duplicates; the second follows
    the first."""
    both = (first.withColumn("_list", F.lit(0)).unionByName(
        second.withColumn("_list", F.lit(1)), allowMissingColumns=True)
        .withColumn(order, F.struct("_list", order)).drop("_list"))
    return deduplicate(both, order, **options)
