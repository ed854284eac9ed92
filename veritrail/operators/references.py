"""Reference lists, in-text suffixes, citation numbers and BibTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cite
from ..functions.cite import PaperColumns
from ..functions.ids import bibtex_key, normalize_doi, paper_id_of, year_or
from ..functions.text import first_author, strip, text_or_empty, unnest
from .keys import running_number

DOI_IN_ENTRY = r"doi\.org/([^\s\)\]]+)"


def code_point(number: Column) -> Column:
    """The character with this code point."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("bigint")), 8, "0")), "UTF-32")


def _numbered(rows: DataFrame, name: str, order: str, keys: list[str]) -> DataFrame:
    """running_number over the keys and the unique position alone, joined back,
    so that records do not travel through the range partitioning."""
    light = running_number(rows.select(order, *keys), name, [order], keys)
    return rows.join(light.select(order, name), order)


def year_suffixes(papers: DataFrame, order: str = "ord") -> DataFrame:
    """`suffix` a, b, c, ... for papers that share first author and year, in
    list order; empty for the others."""
    keyed = (papers.withColumn("_who", cite.apa_first_author(F.col("authors")))
             .withColumn("_when", year_or(F.col("year"), "n.d.")))
    shared = keyed.groupBy("_who", "_when").agg(F.count(F.lit(1)).alias("_same")).where("_same > 1")
    numbered = _numbered(keyed, "_nth", order, ["_who", "_when"])
    return (numbered.join(shared, ["_who", "_when"], "left")
            .withColumn("suffix", F.when(F.col("_same").isNotNull(), code_point(F.col("_nth") + 96)).otherwise(F.lit("")))
            .drop("_who", "_when", "_nth", "_same"))


def apa_reference_list(papers: DataFrame, order: str = "ord", suffix: str | None = None) -> DataFrame:
    """Entries with the keys that sort them: rendered last name in lower case,
    then year (missing years last), then input order. A suffix goes into the
    first '(year).' of the entry."""
    entry = cite.apa_entry(PaperColumns())
    if suffix:
        dated = F.regexp_replace(
            entry, r"(?s)^(.*?)\((\d{4}|n\.d\.)\)\.",
            F.concat(F.lit("$1("), year_or(F.col("year"), "n.d."), F.col(suffix), F.lit(").")))
        entry = F.when(F.col(suffix) != "", dated).otherwise(entry)
    return papers.select(
        F.lower(cite.apa_first_author(F.col("authors"))).alias("sort_name"),
        F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)).alias("sort_year"), order,
        entry.alias("entry"))


def reference_name(authors: Column) -> Column:
    """Sort name of the reference updater: text before the comma, else the
    whole first name."""
    name = first_author(authors)
    return F.lower(F.when(F.contains(name, F.lit(",")), strip(F.substring_index(name, ",", 1))).otherwise(name))


def style_entries(papers: DataFrame, style: str, order: str = "ord", start: int = 1) -> DataFrame:
    """Entries in the order of the style: author-year styles by name and year
    without numbers, the others as given and numbered from `start`. `position`
    is the place in the list."""
    if style in cite.AUTHOR_YEAR_STYLES:
        keyed = papers.withColumn("_name", reference_name(F.col("authors"))).withColumn(
            "_year", F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)))
        light = running_number(keyed.select("_name", "_year", order), "position", ["_name", "_year", order])
        ranked = papers.join(light.select(order, "position"), order)
        return ranked.withColumn("entry", cite.citation_entry(PaperColumns(), style))
    ranked = papers.join(running_number(papers.select(order), "position", [order]), order)
    number = F.col("position") + F.lit(start - 1) if style in cite.NUMBERED_STYLES else None
    return ranked.withColumn("entry", cite.citation_entry(PaperColumns(), style, number))


def citation_numbers(plan: DataFrame, order: tuple[str, str] = ("position", "paper_idx")) -> DataFrame:
    """`citation_number` by first appearance; a paper keeps its number."""
    position, paper = order
    first = plan.groupBy(paper).agg(F.min(F.coalesce(position, F.lit(0))).alias("_first"))
    numbers = running_number(first, "citation_number", ["_first", paper]).drop("_first")
    return plan.join(numbers, paper)


def bibtex_entries(papers: DataFrame, order: str = "ord", existing: DataFrame | None = None) -> DataFrame:
    """(order, doi, bibtex_key, entry) without known DOIs; a key used before
    gets _2, _3, ... in list order. Keys end in letters, so a numbered key
    cannot meet another plain one."""
    df = papers.withColumn("_doi", normalize_doi(F.col("doi")))
    if existing is not None:
        known = existing.select(normalize_doi(F.col("doi")).alias("_doi")).where("_doi IS NOT NULL").distinct()
        # Only rows with a DOI can be known; the others skip the join.
        df = (df.where("_doi IS NOT NULL").join(known, "_doi", "left_anti")
              .unionByName(df.where("_doi IS NULL")))
    df = df.withColumn("_base", bibtex_key(F.col("title"), F.col("year"), F.col("authors")))
    numbered = _numbered(df, "_nth", order, ["_base"])
    key = F.when(F.col("_nth") == 1, F.col("_base")).otherwise(
        F.concat_ws("_", "_base", F.col("_nth").cast("string")))
    return numbered.withColumn("bibtex_key", key).select(
        order, F.col("_doi").alias("doi"), "bibtex_key",
        cite.bibtex_entry(PaperColumns(), F.col("bibtex_key")).alias("entry"))


def numeric_markers_max(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: the highest first number of the [n] markers in the texts."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?U)\[\s*(\d+)(?:\s*[,-]\s*\d+)*\s*\]"), F.lit(1))
    return unnest(texts, found, value="n").agg(
        F.coalesce(F.max(F.col("n").try_cast("int")), F.lit(0)).alias("last_number"))


def new_reference_entries(entries: DataFrame, existing: DataFrame, entry: str = "entry",
                          text: str = "text") -> DataFrame:
    """Entries not in a reference section yet. An entry is known when its DOI
    link is there, or when its text up to the first bracket (60 characters) is
    part of an existing reference."""
    doi = lambda c: F.lower(F.nullif(F.regexp_extract(c, DOI_IN_ENTRY, 1), F.lit("")))
    have = existing.select(doi(F.col(text)).alias("_doi")).where("_doi IS NOT NULL").distinct()
    head = F.substring(strip(F.substring_index(entry, "(", 1)), 1, 60)
    df = entries.withColumn("_doi", doi(F.col(entry))).withColumn("_head", head)
    fresh = (df.where("_doi IS NOT NULL").join(have, "_doi", "left_anti")
             .unionByName(df.where("_doi IS NULL")))
    from .contain import contained_fragments
    known = contained_fragments(fresh.select(F.col("_head").alias("fragment")),
                                existing.select(F.col(text).alias("body")))
    # An empty start is part of every reference, if there is one.
    none_yet = existing.where(strip(F.col(text)) != "").limit(1).agg(F.count(F.lit(1)).alias("c")).scalar() == 0
    return (fresh.where((F.col("_head") != "") | none_yet)
            .join(known, F.col("_head") == F.col("fragment"), "left_anti").drop("_doi", "_head"))


def bibitems(papers: DataFrame, style: str, existing_keys: DataFrame | None = None,
             order: str = "ord", start: int = 1) -> DataFrame:
    r"""(order, key, item) \bibitem lines for keys that are not there yet; the
    key is the BibTeX key, else the paper id. Numbers continue from `start`."""
    key = F.coalesce(F.nullif(F.col("bibtex_key"), F.lit("")), F.col("paper_id")) \
        if "bibtex_key" in papers.columns else F.col("paper_id")
    df = style_entries(papers.withColumn("paper_id", paper_id_of()), style, order, start).withColumn("key", key)
    if existing_keys is not None:
        df = df.join(existing_keys.select("key").distinct(), "key", "left_anti")
    from .keys import first_per_key
    df = first_per_key(df.select("key", order, "entry"), ["key"], [order])
    return df.select(order, "key", F.concat(F.lit("\\bibitem{"), "key", F.lit("} "), "entry").alias("item"))


def bibitem_keys(texts: DataFrame, text: str = "text") -> DataFrame:
    r"""Distinct keys of \bibitem entries."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\\bibitem[^}{]*\{([^}]*)\}"), F.lit(1))
    return unnest(texts, found, value="key").distinct()


def insert_bibitems(texts: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    r"""`text` with a document's items in front of \end{thebibliography}; a
    document without that environment stays as it is."""
    lines = items.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda e: e["item"]), "\n").alias("_new"))
    end = r"\end{thebibliography}"
    at = F.instr("text", end)
    return (texts.join(lines, key, "left")
            .withColumn("text", F.when(
                (at > 0) & F.contains("text", F.lit(r"\begin{thebibliography}")) & F.col("_new").isNotNull(),
                F.concat(F.substring(F.col("text"), F.lit(1), at - 1), F.lit("\n"), F.col("_new"), F.lit("\n"),
                         F.substring(F.col("text"), at, F.length("text")))).otherwise(F.col("text")))
            .drop("_new"))


def marker_texts(papers: DataFrame, suffix: str | None = None) -> DataFrame:
    """Parenthetical and narrative in-text markers."""
    p = PaperColumns()
    add = F.col(suffix) if suffix else None
    return papers.withColumn("marker", cite.apa_in_text(p, add)).withColumn(
        "narrative", cite.apa_in_text(p, add, narrative=True))


#: Heading that is written when a document has no reference section.
REFERENCE_HEADING = "References"


def word_additions(paragraphs: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, ord, entry) to add at the end of every Word file that `entries` (path,
    ord, entry) names: entries whose text the file's reference section does not
    hold, behind a heading if it has no such section. An entry `{n} ...` gets the
    number after the highest `[n]` of the section."""
    from .documents import docx_structure, existing_references, is_reference_heading
    structure = docx_structure(paragraphs)
    held = existing_references(structure).select("path", strip(F.col("text")).alias("text"))
    last = held.groupBy("path").agg(F.max(F.regexp_extract("text", r"^\[(\d+)\]", 1).try_cast("int")).alias("_last"))
    bare = lambda c: F.regexp_replace(strip(c), r"^(\[\d+\]|\{n\})\s*", "")
    fresh = entries.withColumn("_bare", bare(F.col("entry"))).join(
        held.select(F.col("path").alias("_p"), bare(F.col("text")).alias("_t")),
        (F.col("path") == F.col("_p")) & (F.col("_bare") == F.col("_t")), "left_anti")
    placed = running_number(fresh, "_nth", ["ord"], ["path"]).join(last, "path", "left")
    number = F.concat(F.lit("["), (F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("string"), F.lit("] "), "_bare")
    lines = placed.select("path", F.col("_nth").alias("ord"), F.when(
        F.col("entry").startswith("{n}"), number).otherwise(F.col("entry")).alias("entry"))
    headed = structure.where(F.col("is_heading") & is_reference_heading(F.col("text"))).select("path").distinct()
    heads = lines.select("path").distinct().join(headed, "path", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("ord"), F.lit(REFERENCE_HEADING).alias("entry"))
    return heads.unionByName(lines)
