"""Raw bibliographic responses to unified paper rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.ids import normalize_doi
from ..functions.text import family_given, last_token_first, strip, text_or_empty

# The order of trust between sources; anything else is 9.
SOURCE_PRIORITY = {
    "crossref": 0,
    "openalex": 1,
    "semantic_scholar": 2,
    "local_file": 4,
    "exa": 5,
    "google_scholar": 6,
}
OTHER_PRIORITY = 9




def source_priority(source: Column) -> Column:
    out = None
    for name, rank in SOURCE_PRIORITY.items():
        out = F.when(source == name, F.lit(rank)) if out is None else out.when(source == name, F.lit(rank))
    return out.otherwise(F.lit(OTHER_PRIORITY))


def unified(df: DataFrame, source: str, layer: str | None = "api", extra: dict | None = None,
            keep: tuple[str, ...] = (), **given: Column) -> DataFrame:
    """Project to the unified paper columns. Columns not given get the source's
    empty value; `journal` follows `venue` and `url` follows `doi` unless given."""
    values: dict[str, Column] = {
        "source": F.lit(source),
        "source_layer": F.lit(layer),
        "source_apis": F.array(F.lit(source)),
        "issn": F.array().cast("array<string>"),
        "keywords": F.array().cast("array<string>"),
        "is_oa": F.lit(False),
        "tier_score": F.lit(0.0),
        "recency_score": F.lit(0.0),
    }
    values.update(given)
    values.setdefault("journal", values.get("venue", F.lit("")))
    if "doi" in values:
        values.setdefault("url", F.concat(F.lit("https://doi.org/"), values["doi"]))
    columns = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schemas.PAPERS).fields]
    columns += [expr.alias(name) for name, expr in (extra or {}).items()]
    return df.select(*keep, *columns)


def flip_names(names: Column, flip: Callable[[Column], Column] = family_given) -> Column:
    """'Last, First' for every non-empty name. Semantic Scholar, Exa and Google
    Scholar serve 'First Last' only, so their mappers do not look for commas."""
    return F.transform(
        F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: text_or_empty(n) != ""), flip)


def inverted_abstract(index: Column) -> Column:
    """Text from a word -> positions map: by position, ties by word."""
    pairs = F.flatten(F.transform(
        F.map_entries(index),
        lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")),
                              lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    joined = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " ")
    return text_or_empty(joined)


def strip_jats(text: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(text), "</?jats:[^>]*>", ""))


def first_year(*date_parts: Column) -> Column:
    """First year that is present and not zero among date-parts arrays."""
    return F.coalesce(*[F.nullif(F.get(F.get(parts, 0), 0), F.lit(0)) for parts in date_parts])


def crossref_year() -> Column:
    return first_year(*[F.col(f"`{name}`.`date-parts`") for name in
                        ("issued", "published-print", "published-online", "published")])


def _case(value: Column, groups: dict[str, tuple[str, ...]], other: str) -> Column:
    whens = [(value.isin(*members), label) for label, members in groups.items()]
    return reduce(lambda acc, w: acc.when(w[0], F.lit(w[1])), whens[1:],
                  F.when(whens[0][0], F.lit(whens[0][1]))).otherwise(F.lit(other))


def map_openalex(works: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    first, last = F.col("biblio.first_page"), F.col("biblio.last_page")
    pages = F.when(text_or_empty(first) != "", F.concat_ws("-", first, F.nullif(last, F.lit(""))))
    names = F.transform(F.col("authorships"), lambda a: a["author"]["display_name"])
    return unified(
        works, "openalex", keep=keep,
        title=F.coalesce(F.nullif("title", F.lit("")), F.col("display_name"), F.lit("")),
        authors=flip_names(F.transform(names, lambda n: F.when(F.contains(n, F.lit(",")), strip(n)).otherwise(n))),
        year=F.col("publication_year"),
        venue=text_or_empty(F.col("primary_location.source.display_name")),
        venue_type=_case(F.col("type"), {
            "journal": ("article",), "conference": ("conference-paper",),
            "preprint": ("preprint", "posted-content")}, "other"),
        doi=normalize_doi(F.col("doi")),
        abstract=inverted_abstract(F.col("abstract_inverted_index")),
        citation_count=F.coalesce("cited_by_count", F.lit(0)),
        volume=F.col("biblio.volume"), issue=F.col("biblio.issue"), pages=pages,
        publisher=F.col("primary_location.source.host_organization_name"),
        issn_l=F.col("primary_location.source.issn_l"),
        issn=F.coalesce("primary_location.source.issn", F.array().cast("array<string>")),
        open_access_pdf=F.col("open_access.oa_url"),
        is_oa=F.coalesce("open_access.is_oa", F.lit(False)),
        oa_status=F.col("open_access.oa_status"), language=F.col("language"))


def map_crossref(works: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    names = F.transform(F.col("author"), lambda a: F.regexp_replace(
        F.concat(text_or_empty(a["family"]), F.lit(", "), text_or_empty(a["given"])), r"^[, ]+|[, ]+\z", ""))
    return unified(
        works, "crossref", keep=keep,
        title=text_or_empty(F.get("title", 0)),
        authors=F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != ""),
        year=crossref_year(),
        venue=text_or_empty(F.get(F.col("`container-title`"), 0)),
        venue_type=_case(F.col("type"), {
            "journal": ("journal-article",), "conference": ("proceedings-article", "proceedings"),
            "book": ("book-chapter",)}, "other"),
        doi=normalize_doi(F.col("DOI")),
        abstract=strip_jats(F.col("abstract")),
        citation_count=F.coalesce(F.col("`is-referenced-by-count`"), F.lit(0)),
        volume=F.col("volume"), issue=F.col("issue"), pages=F.col("page"),
        publisher=F.col("publisher"), issn=F.coalesce("ISSN", F.array().cast("array<string>")),
        language=F.col("language"), keywords=F.coalesce("subject", F.array().cast("array<string>")))


def map_semantic_scholar(papers: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    venue = text_or_empty(F.col("venue"))
    journal = (venue != "") & ~F.lower(venue).startswith("arxiv")
    return unified(
        papers, "semantic_scholar", keep=keep,
        title=text_or_empty(F.col("title")),
        authors=flip_names(F.transform("authors", lambda a: a["name"]), last_token_first),
        year=F.col("year"), venue=venue,
        venue_type=F.when(journal, F.lit("journal")).otherwise(F.lit("preprint")),
        doi=normalize_doi(F.col("externalIds.DOI")),
        abstract=text_or_empty(F.col("abstract")),
        citation_count=F.coalesce("citationCount", F.lit(0)))


def map_publish_or_perish(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exported records; rows without a title are dropped. `cites` becomes the
    citation count, and the venue stands in for the journal."""
    venue = F.coalesce(F.nullif("source", F.lit("")), F.nullif("publisher", F.lit("")), F.lit(""))
    first, last = F.nullif("startpage", F.lit("")), F.nullif("endpage", F.lit(""))
    names = F.transform("authors", lambda a: strip(a["name"]))
    return unified(
        records.where(text_or_empty(F.col("title")) != ""), "publish_or_perish", keep=keep,
        title=F.col("title"), authors=flip_names(names), year=F.col("year"), venue=venue,
        venue_type=F.when(venue != "", F.lit("journal")).otherwise(F.lit("other")),
        doi=F.nullif(F.trim("doi"), F.lit("")), abstract=text_or_empty(F.col("abstract")),
        citation_count=F.coalesce("cites", F.lit(0)), volume=F.col("volume"), issue=F.col("issue"),
        pages=F.concat_ws("-", first, last), extra={"pop_uid": F.col("uid")})


def map_exa(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    meta = lambda name: F.col(f"metadata.{name}")
    some = lambda *cols: F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))
    names = F.transform(F.slice(meta("authors"), 1, 20),
                        lambda a: F.concat_ws(" ", F.nullif(a["first_name"], F.lit("")),
                                              F.nullif(a["last_name"], F.lit(""))))
    venue = some(meta("journal"), meta("venue"))
    year = some(meta("year"), F.substring(meta("publishedDate"), 1, 4))
    return unified(
        results, "exa", "web", keep=keep,
        title=some(meta("title"), F.col("title")), authors=flip_names(names, last_token_first),
        year=year.try_cast("int"), venue=venue,
        venue_type=F.when(text_or_empty(meta("journal")) != "", F.lit("journal")).otherwise(F.lit("other")),
        doi=normalize_doi(meta("doi")), url=F.col("url"),
        abstract=some(meta("description"), F.col("highlight"), meta("summary")),
        citation_count=F.lit(0), volume=meta("volume"), publisher=meta("publisher"))


def map_google_scholar(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    venue = text_or_empty(F.col("bib.venue"))
    names = F.transform("bib.author", strip)
    return unified(
        results, "google_scholar", "web", keep=keep,
        title=text_or_empty(F.col("bib.title")), authors=flip_names(names, last_token_first),
        year=F.nullif(F.col("bib.pub_year").try_cast("int"), F.lit(0)), venue=venue,
        venue_type=F.when(venue != "", F.lit("journal")).otherwise(F.lit("other")),
        doi=normalize_doi(F.col("bib.doi")), url=F.col("pub_url"),
        abstract=text_or_empty(F.col("bib.abstract")), citation_count=F.lit(0))


def scholar_page(results: DataFrame, limit: int, year_start: int | None, rank: str = "rank") -> DataFrame:
    """The limit counts scanned rows; rows before `year_start` go afterwards,
    rows without a year stay."""
    page = results.where(F.col(rank) < limit)
    if year_start is None:
        return page
    year = F.nullif(F.col("bib.pub_year").try_cast("int"), F.lit(0))
    return page.where(F.coalesce(year >= year_start, F.lit(True)))
