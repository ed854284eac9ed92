"""Token-id files of independent zstandard frames with a seek table.

A file is a sequence of frames and ends with a skippable frame, the seek table:
for every frame its compressed size, its size and the low half of the XXH64 of
its content, then the number of frames and the closing magic number (the
published seekable format). The first frame holds the ids of the documents and
the width of a token id, every other frame one document, so a reader
decompresses only the documents it is asked for and checks each of them.

Files are written by Spark's text sink, one row a file, whose line separator is
the closing magic number; they can be in any store that Spark writes to. The task
and file numbers in a file's name, read as numbers, are the order of doc_id.

Token ids take two bytes where the vocabulary and the end id fit, otherwise four;
a width asked for that is too small is an error.

Defined cases: a null or empty text is its end id alone; a null doc_id sorts
first; rows with equal ids are documents each; other columns stay out.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_checked
from .common import as_bytes, rows_of, shared_folder, stored
from .tokens import encoder

END_ID = 2
#: Bytes of ids after which a file is closed (a longer document has its own).
FILE_BYTES = 4 << 20
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
_CHECKSUMS = 0x80


def build_file(ids: list, documents: list[bytes], width: int, level: int = 3) -> bytes:
    """A whole file without its last four bytes, the closing magic number."""
    head = json.dumps({"width": width, "documents": len(ids), "ids": ids}).encode()
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    frames, entries = [], []
    for content in [head, *documents]:
        frame = compressor.compress(content)
        frames.append(frame)
        entries.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
    table = b"".join(entries) + struct.pack("<IBI", len(frames), _CHECKSUMS, SEEK_MAGIC)
    return b"".join([*frames, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table])[:-4]


def read_file(content: bytes, wanted: Collection | None = None) -> Iterator[tuple[object, int, np.ndarray | None, int]]:
    """(doc_id, number in the file, ids, number of ids) of every document; ids
    are None, and the frame stays compressed, for those not wanted."""
    n, flags, magic = struct.unpack_from("<IBI", content, len(content) - 9)
    if magic != SEEK_MAGIC or not flags & _CHECKSUMS:
        raise ValueError("not a token file")
    sizes = np.frombuffer(content, "<u4", 3 * n, len(content) - 9 - 12 * n).reshape(n, 3).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(sizes[:, 0])))
    if int(at[n]) + 8 + 12 * n + 9 != len(content):
        raise ValueError("token file is incomplete")
    decompressor = zstandard.ZstdDecompressor()

    def frame(i: int) -> bytes:
        data = decompressor.decompress(content[at[i]: at[i + 1]])
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != sizes[i, 2]:
            raise ValueError(f"checksum of frame {i} differs")
        return data

    head = json.loads(frame(0))
    for i, doc_id in enumerate(head["ids"]):
        ids = None
        if wanted is None or doc_id in wanted:
            ids = np.frombuffer(frame(i + 1), f"<u{head['width']}")
        yield doc_id, i, ids, int(sizes[i + 1, 1]) // head["width"]


def id_width(largest: int, width: int | None = None) -> int:
    """Bytes of an id, for ids up to `largest`."""
    if width is None:
        return 2 if largest < 1 << 16 else 4
    if width not in (2, 4) or largest >= 1 << 8 * width:
        raise ValueError(f"ids up to {largest} do not fit {width} bytes")
    return width


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text",
          tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, width: int | None = None,
          file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of all documents in ascending doc_id order. Texts are
    range-partitioned, which moves less than ids would; each task encodes its
    range and closes a file whenever file_bytes are reached."""
    rows = rows_of(docs, {"doc_id": doc_id, "text": text})
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        own_width = id_width(max(*tokens.vocabulary().values(), end_id), width)
        ids, documents, size = [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([build_file(ids, documents, own_width)], pa.binary())], ["file"])

        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                found = tokens.encode(as_bytes(some.column(1)))
                for name, own in zip(some.column(0).to_pylist(), found, strict=True):
                    own = np.frombuffer(own + end, "<u4").astype(f"<u{own_width}").tobytes()
                    if ids and size + len(own) > file_bytes:
                        yield closed()
                        ids, documents, size = [], [], 0
                    ids.append(name)
                    documents.append(own)
                    size += len(own)
        if ids:
            yield closed()

    magic = struct.pack("<I", SEEK_MAGIC).decode("latin-1")
    (ranged.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", magic).text(folder))


def read(spark: SparkSession, folder: str, id_type: str = "bigint", wanted: Collection | None = None) -> DataFrame:
    """(file, number, doc_id, ids, n_tokens, ids_crc32) of the documents (of the
    wanted ones only, if given); number is the place in the file."""
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content")

    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, i, d, ids.astype("<u4").tobytes(), n)
                        for d, i, ids, n in read_file(content.as_buffer().to_pybytes(), wanted) if ids is not None]
                if not rows:
                    continue
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind),
                     pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.int64()),
                     pa.array([zlib.crc32(x) for x in columns[3]], pa.int64())],
                    names=["file", "number", "doc_id", "ids", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, f"file string, number bigint, doc_id {id_type}, ids binary, n_tokens bigint, "
                                 "ids_crc32 bigint")


def placed(documents: DataFrame) -> DataFrame:
    """`start` for documents read whole: ids before each in the file, by a window
    per file, after those of the files of the task before it and of the tasks
    before, by windows over one row per file of a task and one row per task."""
    def before(partition: list[str], order: str):
        return F.coalesce(F.sum("n").over(W.partitionBy(*partition).orderBy(order).rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0))

    number = [F.regexp_extract("file", mark, 1).cast("bigint") for mark in (r"^part-(\d+)", r"-c(\d+)(?:\.|$)")]
    files = documents.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumns(
        {"task": number[0], "counter": number[1]})
    tasks = files.groupBy(F.col("task").alias("t")).agg(F.sum("n").alias("n")).select("t", before([], "t").alias("tasks_before"))
    files = files.withColumn("files_before", before(["task"], "counter")).join(
        broadcast_checked(tasks), F.col("task") == F.col("t"))
    sums = broadcast_checked(files.select(F.col("file").alias("f"), (F.col("files_before") + F.col("tasks_before")).alias("b")))
    in_file = W.partitionBy("file").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    return documents.withColumn("s", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0))).join(
        sums, F.col("file") == F.col("f")).select(*documents.columns, (F.col("s") + F.col("b")).alias("start"))


def digests(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    write(docs, folder, doc_id, text, **options)
    back = stored(read(spark, folder, dict(docs.dtypes)[doc_id]).drop("ids"))
    return placed(back).select("doc_id", "start", "n_tokens", "ids_crc32")
