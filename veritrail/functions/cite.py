"""Citation strings: reference entries, in-text markers, BibTeX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import normalize_doi, year_or
from .text import (author_initials_first, author_last_initials, bind, first_author,
                   is_chinese, rstrip, strip, text_or_empty)

# Venue words that mark proceedings, style names, list limits.
CONFERENCE_WORDS = ("conf", "proceedings", "workshop", "symposium")
NUMBERED_STYLES = ("ieee", "nature", "vancouver", "gb-t-7714", "gbt7714", "gb-t")
AUTHOR_YEAR_STYLES = ("apa", "apa7")
GBT_STYLES = ("gb-t-7714", "gbt7714", "gb-t")
CITE_COMMANDS = {
    "ieee": "\\cite", "nature": "\\cite", "vancouver": "\\cite",
    "apa": "\\parencite", "apa7": "\\parencite",
    "gb-t-7714": "\\cite", "gbt7714": "\\cite",
}


def _listed(names: Column, last_joint: str) -> Column:
    """'A', 'A, B<joint>C': comma list whose last member has its own joint."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, F.get(names, 0)).otherwise(
        F.concat(head, F.lit(last_joint), F.element_at(names, -1)))


def _rendered(authors: Column, render) -> Column:
    return F.transform(F.coalesce(authors, F.array().cast("array<string>")), render)


def _no_marks(name: Column, marks: str) -> Column:
    return F.translate(author_last_initials(name), marks, "")


def ieee_authors(authors: Column) -> Column:
    return bind(_rendered(authors, author_initials_first), lambda a: F.when(
        F.size(a) >= 7, F.concat(F.get(a, 0), F.lit(", et al."))).otherwise(_listed(a, ", and ")))


def apa_authors(authors: Column) -> Column:
    return bind(_rendered(authors, author_last_initials), lambda a: F.when(
        F.size(a) > 20,
        F.concat(F.array_join(F.slice(a, 1, 19), ", "), F.lit(", ... "), F.element_at(a, -1)),
    ).otherwise(_listed(a, ", & ")))


def nature_authors(authors: Column) -> Column:
    return bind(_rendered(authors, lambda n: _no_marks(n, ",")), lambda a: F.when(
        F.size(a) > 5, F.concat(F.get(a, 0), F.lit(" et al"))).otherwise(_listed(a, " & ")))


def vancouver_authors(authors: Column) -> Column:
    return bind(_rendered(authors, lambda n: _no_marks(n, ",.")), lambda a: F.when(
        F.size(a) > 6, F.concat(F.array_join(F.slice(a, 1, 6), ", "), F.lit(", et al")),
    ).otherwise(F.array_join(a, ", ")))


def gbt_authors(authors: Column) -> Column:
    render = lambda n: F.when(is_chinese(n), strip(n)).otherwise(_no_marks(n, ",."))
    return bind(_rendered(authors, render), lambda a: F.when(
        F.size(a) > 3, F.concat(F.array_join(F.slice(a, 1, 3), ", "), F.lit(", 等")),
    ).otherwise(F.array_join(a, ", ")))


def is_proceedings(venue: Column) -> Column:
    return F.lower(text_or_empty(venue)).rlike("|".join(CONFERENCE_WORDS))


def _some(value: Column, text: Column) -> Column:
    """`text` when `value` is not empty, else null (left out by concat_ws)."""
    return F.when(value != "", text)


class PaperColumns:
    """The columns a citation is made of, with missing values as empty text."""

    def __init__(self, prefix: str = ""):
        at = f"{prefix}." if prefix else ""
        self.authors = F.col(f"{at}authors")
        self.raw_title = text_or_empty(F.col(f"{at}title"))
        self.title = rstrip(self.raw_title, ".")
        self.venue = text_or_empty(F.col(f"{at}venue"))
        self.raw_year = F.col(f"{at}year")
        self.year = year_or(self.raw_year, "")
        self.doi = text_or_empty(normalize_doi(F.col(f"{at}doi")))


def ieee_entry(p: PaperColumns, number: Column | None = None) -> Column:
    venue = F.when(is_proceedings(p.venue), F.concat(F.lit("in *"), p.venue, F.lit("*"))).otherwise(
        F.concat(F.lit("*"), p.venue, F.lit("*")))
    tail = F.concat_ws(", ", _some(p.venue, venue), _some(p.year, p.year))
    authors = ieee_authors(p.authors)
    body = F.concat_ws(
        " ", _some(authors, F.concat(authors, F.lit(","))),
        F.concat(F.lit('"'), p.title, F.lit(',"')), _some(tail, tail))
    with_doi = F.when(p.doi != "", F.concat(rstrip(body, "."), F.lit(", doi: "), p.doi)).otherwise(body)
    entry = F.concat(rstrip(with_doi, "."), F.lit("."))
    return entry if number is None else F.concat(F.lit("["), number.cast("string"), F.lit("] "), entry)


def apa_entry(p: PaperColumns) -> Column:
    authors = apa_authors(p.authors)
    return F.concat_ws(
        " ", _some(authors, authors),
        F.concat(F.lit("("), year_or(p.raw_year, "n.d."), F.lit(").")),
        F.concat(p.title, F.lit(".")),
        _some(p.venue, F.concat(F.lit("*"), p.venue, F.lit("*."))),
        _some(p.doi, F.concat(F.lit("https://doi.org/"), p.doi)))


def nature_entry(p: PaperColumns, number: Column | None = None) -> Column:
    authors = nature_authors(p.authors)
    venue = _some(p.venue, F.concat(F.lit("*"), p.venue, F.lit("*")))
    tail = F.when(p.year != "", F.concat(
        F.concat_ws(" ", venue, F.concat(F.lit("("), p.year, F.lit(")"))), F.lit("."))).otherwise(
        F.concat(venue, F.lit(".")))
    number_part = F.concat(number.cast("string"), F.lit(".")) if number is not None else F.lit(None)
    return F.concat_ws(" ", number_part, _some(authors, F.concat(authors, F.lit("."))),
                       F.concat(p.title, F.lit(".")), tail)


def vancouver_entry(p: PaperColumns, number: Column | None = None) -> Column:
    authors = vancouver_authors(p.authors)
    number_part = F.concat(number.cast("string"), F.lit(".")) if number is not None else F.lit(None)
    return F.concat_ws(
        " ", number_part, _some(authors, F.concat(authors, F.lit("."))),
        F.concat(p.title, F.lit(".")),
        _some(p.venue, F.concat(p.venue, F.lit("."))), _some(p.year, F.concat(p.year, F.lit("."))))


def gbt_entry(p: PaperColumns, number: Column | None = None) -> Column:
    authors = gbt_authors(p.authors)
    entry = F.concat_ws(
        " ", _some(authors, F.concat(authors, F.lit("."))), F.concat(p.title, F.lit("[J].")),
        _some(p.venue, F.concat(p.venue, F.lit(","))), _some(p.year, F.concat(p.year, F.lit("."))),
        _some(p.doi, F.concat(F.lit("DOI: "), p.doi, F.lit("."))))
    return entry if number is None else F.concat(F.lit("["), number.cast("string"), F.lit("] "), entry)


def citation_entry(p: PaperColumns, style: str, number: Column | None = None) -> Column:
    """Entry in one of the eight style names; an unknown name gives IEEE."""
    name = (style or "ieee").lower()
    if name in AUTHOR_YEAR_STYLES:
        return apa_entry(p)
    if name == "nature":
        return nature_entry(p, number)
    if name == "vancouver":
        return vancouver_entry(p, number)
    if name in GBT_STYLES:
        return gbt_entry(p, number)
    return ieee_entry(p, number)


# --- in-text markers ---------------------------------------------------------

def apa_last(name: Column) -> Column:
    return strip(F.substring_index(author_last_initials(name), ",", 1))


def apa_first_author(authors: Column) -> Column:
    return F.when(F.coalesce(F.size(authors), F.lit(0)) < 1, F.lit("Unknown")).otherwise(
        apa_last(first_author(authors)))


def apa_in_text(p: PaperColumns, suffix: Column | None = None, narrative: bool = False) -> Column:
    year = F.concat(year_or(p.raw_year, "n.d."), suffix if suffix is not None else F.lit(""))
    n = F.coalesce(F.greatest(F.size(p.authors), F.lit(0)), F.lit(0))
    pair = " and " if narrative else " & "
    who = (F.when(n == 0, F.lit("Unknown"))
           .when(n == 1, apa_last(F.get(p.authors, 0)))
           .when(n == 2, F.concat(apa_last(F.get(p.authors, 0)), F.lit(pair), apa_last(F.get(p.authors, 1))))
           .otherwise(F.concat(apa_last(F.get(p.authors, 0)), F.lit(" et al."))))
    if narrative:
        return F.concat(who, F.lit(" ("), year, F.lit(")"))
    return F.concat(F.lit("("), who, F.lit(", "), year, F.lit(")"))


def apa_combine(markers: Column) -> Column:
    """'(A, 2020; B, 2021)' from an array of single markers."""
    bare = F.transform(markers, lambda m: F.regexp_replace(strip(m), r"^\(+|\)+\z", ""))
    return F.concat(F.lit("("), F.array_join(bare, "; "), F.lit(")"))


# --- BibTeX ------------------------------------------------------------------

def bibtex_entry(p: PaperColumns, key: Column) -> Column:
    braces = F.replace(F.replace(p.raw_title, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    authors = F.array_join(F.coalesce(p.authors, F.array().cast("array<string>")), " and ")
    conference = is_proceedings(p.venue)

    def field(name: Column | str, value: Column) -> Column:
        label = F.rpad(F.lit(name), 10, " ") if isinstance(name, str) else F.rpad(name, 10, " ")
        return F.concat(F.lit("  "), label, F.lit("= {"), value, F.lit("}"))

    fields = F.concat_ws(
        ",\n",
        field("title", braces),
        _some(authors, field("author", authors)),
        _some(p.venue, F.concat(
            F.lit("  "), F.when(conference, F.lit("booktitle")).otherwise(F.lit("journal  ")),
            F.lit("= {"), p.venue, F.lit("}"))),
        _some(p.year, field("year", p.year)),
        _some(p.doi, field("doi", p.doi)))
    kind = F.when(conference, F.lit("inproceedings")).otherwise(F.lit("article"))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), fields, F.lit("\n}"))
