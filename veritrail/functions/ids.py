"""Stable identifiers: DOI form, paper id, BibTeX key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (STOPWORDS, first_author, first_author_last_name, last_name,
                   normalize_title, rstrip, strip, text_or_empty)

DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:")


def normalize_doi(doi: Column) -> Column:
    """Lower case, no resolver prefix, no trailing punctuation; empty is null."""
    out = F.lower(strip(doi))
    for prefix in DOI_PREFIXES:
        out = F.regexp_replace(out, f"^{prefix}", "")
    return F.nullif(rstrip(out, ".,;"), F.lit(""))


def year_or(year: Column, fallback: str) -> Column:
    """Year as text; missing and zero years give the fallback."""
    return F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit(fallback))


def paper_id(doi: Column, title: Column, year: Column, authors: Column) -> Column:
    """First 16 hex digits of SHA-256 over the DOI, else over title|year|author."""
    known = normalize_doi(doi)
    by_title = F.concat(
        F.lit("title:"), normalize_title(title),
        F.lit("|year:"), year_or(year, ""),
        F.lit("|author:"), F.lower(first_author_last_name(authors)))
    seed = F.coalesce(F.concat(F.lit("doi:"), known), by_title)
    return F.substring(F.sha2(seed, 256), 1, 16)


def paper_id_of(columns: str = "") -> Column:
    """Paper id from the usual columns, optionally below an alias."""
    at = f"{columns}." if columns else ""
    return paper_id(F.col(f"{at}doi"), F.col(f"{at}title"), F.col(f"{at}year"), F.col(f"{at}authors"))


def claim_id(number: Column) -> Column:
    """C001, C002, ...; numbers above 999 keep all their digits."""
    text = number.cast("string")
    return F.concat(F.lit("C"), F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0")))


def bibtex_key(title: Column, year: Column, authors: Column) -> Column:
    """LastName_Year_keyword: letters of the first author's last name, and the
    first title word of four or more letters that is not a stopword."""
    last = F.regexp_replace(last_name(first_author(authors)), "[^A-Za-z]", "")
    tokens = F.regexp_extract_all(text_or_empty(title), F.lit(r"(?U)\b[A-Za-z]+\b"), F.lit(0))
    picks = F.filter(tokens, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*STOPWORDS))
    key = F.concat_ws(
        "_",
        F.when(last == "", F.lit("unknown")).otherwise(last),
        year_or(year, "xxxx"),
        F.lower(F.coalesce(F.get(picks, 0), F.lit("paper"))))
    return F.regexp_replace(key, "[^A-Za-z0-9_:]", "")
