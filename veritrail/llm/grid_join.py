"""Similarity join of vectors by epsilon grid order.

Unit vectors are rotated to their principal axes (covariance of all vectors) and
sorted by the cells of an epsilon grid on the leading axes, per label. The order
is cut into sequence intervals; pairs of intervals whose boxes are further apart
than epsilon are skipped, first for long intervals, then for their blocks, and
inside a pair of blocks by halving both again and again. What remains is
compared exactly, in double precision: cosine >= t is a distance of at most
sqrt(2 - 2 t) between unit vectors.

Equal vectors of a label are one entry with a number of copies. A task returns,
for each vector it found linked, the number of links and the least id of its
class inside that task, so a group of many alike vectors costs a row per vector
and task, never a row per pair.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components, and one without label or id, links with nothing and is its own
component; vectors of different lengths never link; rows with equal ids are one
vector; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import rows_of, stored

THRESHOLD = 0.93
AXES = 8
BLOCK = 512
LEAF = 64
#: Blocks per long interval, and partner blocks per task group.
LONG = 64
PARTNERS = 16
_SLACK = 1e-9


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    scaled = flat / np.abs(flat).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _by_dim(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    lengths = np.asarray(column.value_lengths())
    for dim in np.unique(lengths):
        yield int(dim), pa.array(np.flatnonzero(lengths == dim))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading axes by vector length, from the second moments of all vectors.
    Tasks send a row per axis; only the summed matrix reaches the driver."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, at in _by_dim(batch.column(0)):
                u = _unit(batch.column(0).take(at), dim)
                sums[dim] = sums.get(dim, 0) + u.T @ u
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()),
                 pa.array([r.tobytes() for r in total], pa.binary())], names=["dim", "axis", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in frame["sums"]], axis=0)
        return pd.DataFrame({"dim": [frame["dim"].iat[0]], "axis": [frame["axis"].iat[0]], "sums": [total.tobytes()]})

    schema = "dim int, axis int, sums binary"
    rows = vectors.select("vector").mapInArrow(moments, schema).groupBy("dim", "axis").applyInPandas(add, schema)
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in rows.collect():
        found.setdefault(r["dim"], {})[r["axis"]] = np.frombuffer(r["sums"])
    return {dim: np.linalg.eigh(np.array([m[i] for i in range(dim)]))[1][:, ::-1][:, : min(AXES, dim)]
            for dim, m in found.items()}


def _cells(vectors: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """vectors with dim and the grid cells on the leading axes."""
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            for dim, at in _by_dim(column):
                some = batch.take(at)
                at_axes = _unit(some.column(some.schema.get_field_index("vector")), dim) @ axes[dim]
                cells = np.floor(at_axes / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([dim] * some.num_rows, pa.int32()),
                     pa.array(list(cells), pa.list_(pa.int32()))], names=[*some.schema.names, "dim", "cells"])

    fields = ", ".join(f"{c} {t}" for c, t in kinds.items())
    return vectors.mapInArrow(run, f"{fields}, dim int, cells array<int>")


def _blocks(ordered: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """The sorted vectors cut into blocks, a row each, with the box on the
    leading axes. Block numbers follow the order."""
    kinds = dict(ordered.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rest: pa.Table | None = None

        def emit(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            dim = part["dim"][0].as_py()
            u = _unit(part["vector"].combine_chunks(), dim)
            box = u @ axes[dim]
            number += 1
            names = ["block", "label", "dim", "low", "high", "ids", "copies", "units"]
            values = [number, part["label"][0].as_py(), dim, box.min(axis=0), box.max(axis=0),
                      part["id"].to_pylist(), part["copies"].to_pylist(), u.tobytes()]
            types = [pa.int64(), part.schema.field("label").type, pa.int32(), pa.list_(pa.float64()),
                     pa.list_(pa.float64()), pa.list_(part.schema.field("id").type), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            here = pa.Table.from_batches([batch])
            rest = here if rest is None else pa.concat_tables([rest, here])
            while rest.num_rows:
                label, dim = rest["label"].to_numpy(zero_copy_only=False), rest["dim"].to_numpy()
                other = np.flatnonzero((label != label[0]) | (dim != dim[0]))
                n = min(BLOCK, int(other[0]) if len(other) else rest.num_rows)
                if n == rest.num_rows and n < BLOCK:
                    break
                yield emit(rest.slice(0, n))
                rest = rest.slice(n)
        if rest is not None and rest.num_rows:
            yield emit(rest)

    return ordered.select("label", "dim", "id", "copies", "vector").mapInArrow(
        run, f"block bigint, label {kinds['label']}, dim int, low array<double>, high array<double>, "
             f"ids array<{kinds['id']}>, copies array<bigint>, units binary")


def _near(a: str, b: str, epsilon: float) -> Column:
    """Whether two boxes are within epsilon of each other."""
    gaps = F.zip_with(
        F.zip_with(f"{a}.low", f"{b}.high", lambda x, y: x - y), F.zip_with(f"{b}.low", f"{a}.high", lambda x, y: x - y),
        lambda p, q: F.greatest(F.lit(0.0), p, q))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= epsilon * epsilon + _SLACK


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b), a <= b, of blocks that may hold a link: long intervals first,
    then the blocks of the pairs of intervals that are left."""
    long = F.concat_ws("-", F.shiftright("block", 32), F.floor((F.col("block") % (1 << 32)) / LONG)).alias("long")
    small = blocks.select("block", "label", "dim", "low", "high", long)

    def bound(f, c: str) -> Column:
        return F.array(*[f(F.get(c, F.lit(i))) for i in range(AXES)])

    whole = small.groupBy("label", "dim", "long").agg(
        bound(F.min, "low").alias("low"), bound(F.max, "high").alias("high"), F.min("block").alias("first"))
    whole = whole.withColumn("low", F.filter("low", lambda x: x.isNotNull())).withColumn(
        "high", F.filter("high", lambda x: x.isNotNull()))
    x, y = whole.alias("x"), whole.alias("y")
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim"))
    longs = x.join(y, same & (F.col("x.first") <= F.col("y.first")) & _near("x", "y", epsilon)).select(
        F.col("x.label").alias("label"), F.col("x.dim").alias("dim"), F.col("x.long").alias("lx"), F.col("y.long").alias("ly"))
    keys = ["label", "dim"]
    a = small.select(*keys, F.col("long").alias("lx"), F.struct("block", "low", "high").alias("a"))
    b = small.select(*keys, F.col("long").alias("ly"), F.struct("block", "low", "high").alias("b"))
    both = longs.join(a, [*keys, "lx"]).join(b, [*keys, "ly"])
    return both.where((F.col("a.block") <= F.col("b.block")) & _near("a", "b", epsilon)).select(
        F.col("a.block").alias("a"), F.col("b.block").alias("b"))


def join_units(u: np.ndarray, v: np.ndarray, box_u: np.ndarray, box_v: np.ndarray, threshold: float, epsilon: float,
               same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of u and v with cosine >= threshold, by halving both
    sequences and skipping halves whose boxes are apart. With same, i < j."""
    found_i, found_j = [], []
    todo = [(0, len(u), 0, len(v))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if same and j1 <= i0:
            continue
        p, q = box_u[i0:i1], box_v[j0:j1]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        if gap @ gap > epsilon * epsilon + _SLACK:
            continue
        if max(i1 - i0, j1 - j0) > LEAF:
            im, jm = (i0 + i1 + 1) // 2, (j0 + j1 + 1) // 2
            todo += [(s, e, f, g) for s, e in ((i0, im), (im, i1)) for f, g in ((j0, jm), (jm, j1)) if s < e and f < g]
            continue
        i, j = np.nonzero(u[i0:i1] @ v[j0:j1].T >= threshold)
        if same:
            upper = i + i0 < j + j0
            i, j = i[upper], j[upper]
        found_i.append(i + i0)
        found_j.append(j + j0)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row number in the class of every row."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _linked(pairs: DataFrame, blocks: DataFrame, axes: dict[int, np.ndarray], threshold: float, epsilon: float,
            id_type: str) -> DataFrame:
    """(id, n, root) of vectors linked in a task: links found there, and the
    least id it reaches there. A task group is a block and some partners."""
    ranked = pairs.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("a").orderBy("b")) - 1) / PARTNERS))
    members = ranked.select("a", "chunk", F.col("b").alias("block")).union(
        ranked.select("a", "chunk", F.col("a").alias("block"))).distinct()
    tested = ranked.groupBy("a", "chunk").agg(F.max(F.col("a") == F.col("b")).alias("own"))
    rows = members.join(tested, ["a", "chunk"]).join(blocks.select("block", "dim", "ids", "copies", "units"), "block")

    def run(group: pa.Table) -> pa.Table:
        items = sorted(group.to_pylist(), key=lambda r: r["block"])
        dim = items[0]["dim"]
        units = [np.frombuffer(r["units"]).reshape(-1, dim) for r in items]
        boxes = [u @ axes[dim] for u in units]
        starts = np.concatenate(([0], np.cumsum([len(u) for u in units])))
        lead = next(k for k, r in enumerate(items) if r["block"] == r["a"])
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(items)):
            if k == lead and not items[k]["own"]:
                continue
            i, j = join_units(units[lead], units[k], boxes[lead], boxes[k], threshold, epsilon, k == lead)
            found_i.append(i + starts[lead])
            found_j.append(j + starts[k])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        ids = np.array([x for r in items for x in r["ids"]])
        copies = np.array([x for r in items for x in r["copies"]], np.int64)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        least = _least_reached(len(ids), place[i], place[j])[place]
        hit = np.flatnonzero(n)
        return pa.table({"id": pa.array(ids[hit].tolist(), group.schema.field("ids").type.value_type),
                         "n": pa.array(n[hit]),
                         "root": pa.array(ids[order][least[hit]].tolist(), group.schema.field("ids").type.value_type)})

    return rows.groupBy("a", "chunk").applyInArrow(run, f"id {id_type}, n bigint, root {id_type}")


def near_copies(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of the table."""
    epsilon = math.sqrt(2 - 2 * threshold)
    rows = rows_of(table, {"id": vec_id, "vector": embedding, "label": label})
    id_type = dict(rows.dtypes)["id"]
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite
                        & F.exists("vector", lambda x: x != 0), F.lit(False))
    valid = rows.where(usable)
    once = valid.groupBy("id", "label", "vector").agg(F.lit(1).alias("one"))
    entries = stored(once.groupBy("label", "vector").agg(F.min("id").alias("id"), F.sum("one").alias("copies")))
    axes = principal_axes(entries)
    ordered = _cells(entries, axes, epsilon)
    keys = ["label", "dim", "cells", "id"]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    blocks = stored(_blocks(ordered, axes))
    pairs = stored(block_pairs(blocks, epsilon))
    links = stored(_linked(pairs, blocks, axes, threshold, epsilon, id_type))
    counts = links.groupBy(F.col("id").alias("e")).agg(F.sum("n").alias("n"))
    classes = connected_components(links, "id", "root")
    of_entry = entries.join(counts, F.col("id") == F.col("e"), "left").join(
        classes, F.col("id") == F.col("node"), "left").select(
        F.col("label").alias("l"), F.col("vector").alias("v"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    joined = rows.withColumn("usable", usable).join(
        of_entry, F.col("usable") & (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         component.alias("component_id"), (F.coalesce(component == F.col("id"), F.lit(True))).alias("kept"))
