"""File readers: JSON lines, claim files, text, LaTeX, Word, lookups, .bib."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from functools import partial, reduce
from io import BytesIO
from operator import or_
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.ids import normalize_doi
from ..functions.text import SPACE, strip
from .. import schemas

DATA = Path(__file__).resolve().parent.parent / "data"
LOCAL_EXTENSIONS = ("pdf", "txt", "md", "docx", "tex")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped, a missing path is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return _empty(spark, schema)
        raise


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, pretty-printed or not; arrays give a row per item."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _holds_lines(spark: SparkSession, path: str) -> bool:
    """Whether a file is JSON lines: its first line closes an object, and more
    follows."""
    head = spark.read.text(path).where("trim(value) <> ''").take(2)
    try:
        return len(head) == 2 and isinstance(json.loads(head[0]["value"]), dict)
    except ValueError:
        return False


def read_records(spark: SparkSession, path: str, schema: str, envelope: str, position: str | None = None) -> DataFrame:
    """Records in any accepted form: a .jsonl file, a JSON array, an object that
    holds the records under `envelope` (claims, kept, papers), or JSON lines in
    a .json file. `position` names a column for the place in the input."""
    names = [f.name for f in _empty(spark, schema).schema.fields]
    place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
             F.monotonically_increasing_id().alias("_r")]
    some = reduce(or_, [F.col(f"`{n}`").isNotNull() for n in names])
    try:
        # A folder, as the stages write it, holds JSON lines.
        if not path.endswith(".json") or _holds_lines(spark, path):
            found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select(
                "*", *place, F.lit(0).alias("_i")).where(some)
        else:
            wrapped = f"{schema}, `{envelope}` ARRAY<STRUCT<{_struct_fields(schema)}>>"
            raw = read_document(spark, path, wrapped).select("*", *place)
            own = F.struct(*[F.col(f"`{n}`") for n in names])
            items = F.coalesce(F.col(envelope), F.array(own))
            found = raw.select("_f", "_b", "_r", F.posexplode(items).alias("_i", "_item")).select(
                *[F.col(f"_item.`{n}`").alias(n) for n in names], "_f", "_b", "_r", "_i").where(some)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return _empty(spark, schema + (f", `{position}` BIGINT" if position else ""))
        raise
    if position is None:
        return found.select(*[f"`{n}`" for n in names])
    from ..operators.keys import running_number
    numbered = running_number(found, position, ["_f", "_b", "_r", "_i"])
    return numbered.select(*[f"`{n}`" for n in names], position)


def _struct_fields(schema: str) -> str:
    fields = T.StructType.fromDDL(schema).fields
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, schemas.CLAIMS, "claims")


# --- documents -----------------------------------------------------------------

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

PARAGRAPHS = "path STRING, paragraph_id INT, style STRING, runs ARRAY<STRING>"


def _docx_paragraphs(batches: Iterator[pd.DataFrame], skip_broken: bool = False) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(BytesIO(content)) as archive:
                    body = ET.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
                    names = _style_names(archive)
            except (zipfile.BadZipFile, KeyError, ET.ParseError):
                if skip_broken:
                    continue
                raise
            rows = []
            for i, para in enumerate(body.findall(f"{_WORD}p")):
                style = para.find(f"{_WORD}pPr/{_WORD}pStyle")
                key = style.get(f"{_WORD}val") if style is not None else ""
                runs = ["".join(t.text or "" for t in run.iter(f"{_WORD}t"))
                        for run in para.findall(f"{_WORD}r")]
                rows.append((path, i, names.get(key, key or "Normal"), runs))
            yield pd.DataFrame(rows, columns=["path", "paragraph_id", "style", "runs"])


def _style_names(archive: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ET.fromstring(archive.read("word/styles.xml"))
    return {s.get(f"{_WORD}styleId"): s.find(f"{_WORD}name").get(f"{_WORD}val")
            for s in root.findall(f"{_WORD}style") if s.find(f"{_WORD}name") is not None}


def read_docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraph_id, style, runs) of Word files, one row per paragraph."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(_docx_paragraphs, PARAGRAPHS)


def latex_body(text):
    """Running text of a LaTeX file as one paragraph."""
    inner = F.regexp_extract(text, r"(?s)\\begin\{document\}(.*?)\\end\{document\}", 1)
    body = F.when(text.rlike(r"(?s)\\begin\{document\}.*?\\end\{document\}"), inner).otherwise(text)
    body = F.regexp_replace(body, r"(?d)(?<!\\)%.*", "")
    body = F.regexp_replace(body, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", " ")
    return F.regexp_replace(body, f"(?U){SPACE}+", " ")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, source_format) for .docx, .tex, .md and plain text files."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else "txt"
    if ext == "docx":
        text = F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))), lambda p: p["text"]), "\n")
        paragraphs = (read_docx_paragraphs(spark, path)
                      .withColumn("text", F.array_join("runs", "")).where(strip(F.col("text")) != ""))
        return paragraphs.groupBy("path").agg(text.alias("text")).withColumn("source_format", F.lit("docx"))
    raw = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))
    if ext == "tex":
        return raw.select("path", latex_body(F.col("text")).alias("text"), F.lit("tex").alias("source_format"))
    return raw.withColumn("source_format", F.lit("md" if ext == "md" else "txt"))


# --- local papers --------------------------------------------------------------

#: Paragraphs of a Word file that are searched for a year, and the longest title.
YEAR_PARAGRAPHS = 5
TITLE_CHARS = 200


def _words_capitalised(name):
    """Every run of letters with a capital first and small ones after it."""
    return F.array_join(F.transform(
        F.regexp_extract_all(name, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda part: F.initcap(part)), "")


def _word_heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, year) of the readable Word files below a folder: the first
    paragraph with text, and the first year in the first few."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", "*.docx").load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return _empty(spark, "path STRING, title STRING, year INT")
        raise
    paragraphs = files.select("path", "content").mapInPandas(partial(_docx_paragraphs, skip_broken=True), PARAGRAPHS)
    text = strip(F.array_join("runs", ""))
    filled = paragraphs.select("path", "paragraph_id", text.alias("text")).where("text <> ''").withColumn(
        "nth", F.row_number().over(W.partitionBy("path").orderBy("paragraph_id"))).where(F.col("nth") <= YEAR_PARAGRAPHS)
    heads = filled.groupBy("path").agg(
        F.left(F.min_by("text", "nth"), F.lit(TITLE_CHARS)).alias("title"),
        F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("texts"))
    joined = F.array_join(F.transform("texts", lambda t: t["text"]), " ")
    return heads.select("path", "title", F.regexp_extract(joined, r"(?:19|20)\d{2}", 0).try_cast("int").alias("year"))


def scan_local_papers(spark: SparkSession, path: str) -> DataFrame:
    """Unified paper rows for a folder of user-provided files. A Word file gives
    its first paragraph as title, any other its name."""
    ext, stem = (F.regexp_extract("path", r"([^/]*?)\.([^./]+)\z", k) for k in (2, 1))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", F.lower(ext).alias("ext"), stem.alias("stem")).where(F.col("ext").isin(*LOCAL_EXTENSIONS))
    named = _words_capitalised(F.replace(F.replace("stem", F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))
    found = listed.join(_word_heads(spark, path), "path", "left").withColumn(
        "title", F.coalesce("title", F.when(F.col("ext") == "docx", F.col("stem")).otherwise(named)))
    from .mappers import unified
    local = F.regexp_replace("path", "^file:/*", "/")
    return unified(
        found, source="local_file", layer="local", title=F.col("title"), authors=F.array().cast("array<string>"),
        year=F.col("year"), venue=F.lit(""), venue_type=F.lit("other"), url=local,
        abstract=F.lit(""), citation_count=F.lit(0).cast("bigint"), extra={"local_path": local})


# --- lookups -------------------------------------------------------------------

def _lookup(spark: SparkSession, path: str | Path, schema: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("comment", "#")
            .option("encoding", "UTF-8").csv(str(path)))


def _key(column: str):
    return F.nullif(F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9]", ""), F.lit(""))


def read_conferences(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(name_key): normalised abbreviations and full names of the conferences."""
    raw = _lookup(spark, path or DATA / "top_conferences.csv", "abbreviation STRING, full_name STRING")
    return (raw.select(F.explode(F.array(_key("abbreviation"), _key("full_name"))).alias("name_key"))
            .where("name_key IS NOT NULL").distinct())


def read_blacklist(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(name_key, issn, publisher_key) of excluded venues and publishers."""
    raw = _lookup(spark, path or DATA / "excluded_venues.csv", "name STRING, issn STRING, publisher STRING")
    return raw.select(
        _key("name").alias("name_key"), F.nullif(F.lower(F.trim("issn")), F.lit("")).alias("issn"),
        _key("publisher").alias("publisher_key"))


def bib_dois(bib: DataFrame, text: str = "value") -> DataFrame:
    """Distinct normalised DOIs of .bib text rows."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?iU)doi\s*=\s*\{([^}]+)\}"), F.lit(1))
    return (bib.select(F.explode(found).alias("doi")).select(normalize_doi(F.col("doi")).alias("doi"))
            .where("doi IS NOT NULL").distinct())


def read_bib_dois(spark: SparkSession, path: str) -> DataFrame:
    """DOIs of a .bib file or folder; none when it does not exist yet."""
    try:
        return bib_dois(spark.read.text(path, wholetext=True))
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return _empty(spark, "doi STRING")
        raise
