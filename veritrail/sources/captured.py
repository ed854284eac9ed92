"""Captured search responses as a data source.

A folder of captured pages reads as a table of the records in them. A file holds
one response, or one per line. Files are dealt over a few partitions per slot, so
many small ones cost no task each. Year and type conditions, and those on the query,
are pushed into the read; of a record only the columns of the given schema are
built. As a stream, the offset is the last file taken, by name.

    spark.dataSource.register(CapturedResponses)
    captured(spark, folder, "openalex", schemas.OPENALEX_WORK).where("publication_year >= 2020")
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual)
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

# Where a source's pages hold their records.
RECORDS = {"openalex": ("results",), "crossref": ("message", "items"), "semantic_scholar": ("data",)}
#: Columns of the page itself: the query it answers, its file (with the line, from 0,
#: where a file holds several), the place in it.
PAGE_COLUMNS = "query STRING, page STRING, rank BIGINT"
#: Columns whose conditions a read takes over.
PUSHED = ("publication_year", "year", "type", "query")
#: Partitions per slot, the bytes after which one is full, and what opening a file costs.
PER_SLOT, FULL_BYTES, OPEN_BYTES = 3, 32 << 20, 4 << 10


def value_of(value: object, kind: DataType) -> object:
    """A JSON value as the given type; what does not fit is null."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(value_of(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, dict) else None
    if isinstance(kind, ArrayType):
        return [value_of(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(kind, MapType):
        return {k: value_of(x, kind.valueType) for k, x in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, NumericType):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return None
        return float(value) if kind.typeName() in ("double", "float") else int(value)
    return None


def _passes(record: dict, condition: Filter) -> bool:
    value = record.get(condition.attribute[0])
    if value is None or isinstance(condition, IsNotNull):
        return value is not None
    tests = {EqualTo: lambda: value == condition.value, GreaterThan: lambda: value > condition.value,
             GreaterThanOrEqual: lambda: value >= condition.value, LessThan: lambda: value < condition.value,
             LessThanOrEqual: lambda: value <= condition.value, In: lambda: value in condition.value}
    try:
        return tests[type(condition)]()
    except TypeError:  # a value of another type is no match
        return False


def _pages(path: str, after: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the files, by name."""
    from pyarrow.fs import FileSelector, FileSystem
    files, root = FileSystem.from_uri(path)
    found = [(f.path, f.size) for f in files.get_file_info(FileSelector(root, recursive=True)) if f.is_file]
    return sorted(x for x in found if x[0].endswith(".json") and not x[0].rsplit("/", 1)[-1].startswith((".", "_")) and x[0] > after)


def _responses(content: bytes) -> list[dict]:
    """The responses of a file: one, or one per line."""
    try:
        return [json.loads(content)]
    except json.JSONDecodeError:
        return [json.loads(line) for line in content.splitlines() if line.strip()]


@dataclass
class Pages(InputPartition):
    paths: list[str]


def _dealt(pages: list[tuple[str, int]], slots: int) -> list[Pages]:
    """Neighbouring files together, in partitions of about equal bytes."""
    full = min(FULL_BYTES, sum(size + OPEN_BYTES for _, size in pages) / (PER_SLOT * slots))
    out, held = [], 0.0
    for path, size in pages:
        if not out or held >= full:
            out.append(Pages([]))
            held = 0.0
        out[-1].paths.append(path)
        held += size + OPEN_BYTES
    return out


class _Reading:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder = schema, options["path"]
        self.slots = int(options.get("slots", "8"))
        self.within = RECORDS[options.get("source", "openalex")]
        self.conditions: list[Filter] = []

    def read(self, partition: Pages) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem
        files, _ = FileSystem.from_uri(self.folder)
        for path in partition.paths:
            with files.open_input_stream(path) as stream:
                pages = _responses(stream.read())
            name = path.rsplit("/", 1)[-1]
            for line, page in enumerate(pages):
                yield from self._records(page, f"{name}:{line}" if len(pages) > 1 else name)

    def _records(self, page: dict, name: str) -> Iterator[tuple]:
        records = page
        for field in self.within:
            records = (records or {}).get(field)
        own = {"query": page.get("query"), "page": name}
        for rank, record in enumerate(records or []):
            whole = {**record, **own, "rank": rank}
            if all(_passes(whole, c) for c in self.conditions):
                yield tuple(value_of(whole.get(f.name), f.dataType) for f in self.schema.fields)


class _Reader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            simple = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNotNull))
            if simple and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.conditions.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Pages]:
        return _dealt(_pages(self.folder), self.slots)


class _StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        pages = _pages(self.folder)
        return {"page": pages[-1][0] if pages else ""}

    def partitions(self, start: dict, end: dict) -> Sequence[Pages]:
        return _dealt([p for p in _pages(self.folder, start["page"]) if p[0] <= end["page"]], self.slots)

    def commit(self, end: dict) -> None:
        pass


class CapturedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_responses"

    def schema(self) -> str:
        raise ValueError("captured responses need a schema")

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(schema, self.options)


def captured(spark: SparkSession, path: str, source: str, schema: str) -> DataFrame:
    """The records of captured pages: query, page, rank and the given columns."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedResponses)
    return (spark.read.format("captured_responses").schema(f"{PAGE_COLUMNS}, {schema}").option("source", source)
            .option("slots", spark.sparkContext.defaultParallelism).load(path))


def captured_stream(spark: SparkSession, path: str, source: str, schema: str) -> DataFrame:
    """The same as a stream: pages that come later, in the order of their names."""
    spark.dataSource.register(CapturedResponses)
    return (spark.readStream.format("captured_responses").schema(f"{PAGE_COLUMNS}, {schema}").option("source", source)
            .option("slots", spark.sparkContext.defaultParallelism).load(path))
