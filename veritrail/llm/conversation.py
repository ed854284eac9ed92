"""Repair of damaged conversations at least cost, by divide and conquer.

A conversation's rows are a string of symbols: whom the role's first letter names
(s, u, a or other) and whether the row is whole, truncated, or to be deleted. Its
edits are a path through four states (nothing yet, after s, after u, after a) from
the first to the first or the last. Edits cost: Keep 0, Insert 3, Rerole 3, Delete
4, and 3 more for a truncated row that stays. Of all cheapest paths the one whose
initials (D, I, K, R) come first in ASCII order is wanted.

Hirschberg's way: a cost vector over the four states runs forward to the middle
and another backward to it; where their sums are least is a crossing. Of several,
the audit-least is found by one more backward sweep of the left half that carries
crossings along. Both halves are then solved alike, so no table of all rows and
states is ever held. An edit string that consumes the same rows is never the
beginning of another, so of two crossings the one whose left half comes first wins
whatever follows.

For the same reason a run of rows is summed up by 16 costs and 16 ranks (of the
end states of each start state, by their edit strings), and such summaries can be
combined in any grouping. Rows are numbered by a range sort and cut into blocks
of ROWS rows; most conversations are one block. The blocks of longer ones are
grouped by FAN, the groups by FAN again and so on, as deep as the longest
conversation needs: summaries go up, the states at the borders go down, always by
the same divide and conquer, and no group ever holds more than that many items. Only two things are as long as a conversation by definition:
its audit, one value, and its digest, for which one task streams the rows.

Defined cases: null ids, turns, roles and texts read as one space (a null turn
sorts first and is no turn number); equal turns go by role, then by the text's
hash; a role that begins with none of the three letters, an empty one included,
is never kept; repeated rows are duplicates; other columns stay out of the way; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_checked
from .common import rows_of, stored
from .interleave import numbered

#: Rows of a block, and items of a group above it.
ROWS = 1024
FAN = 64

# Costs, the roles that edits can give, faults of the damage.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
DROP, EMPTY, STRIP, REPEAT, TO_USER = range(5)
FAULT_MODULUS = 20
FAULTS = ("blank", "duplicate", "truncated")

START, S, U, A = range(4)
STATES = range(4)
FAR = 1 << 60
#: State to which Insert or Rerole lead: user, except behind user.
_NEXT = (U, U, A, U)
#: Cost and edits that close a conversation from each state.
_CLOSE = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
# A symbol is 3 * (other, s, u, a) + (whole, truncated, to be deleted), written from "a" on.
WHOLE, CUT, GONE = range(3)
_FIRST_SYMBOL = ord("a")

# A summary: cost and rank of (start state, end state), in this order.
Summary = tuple[tuple[int, ...], tuple[int, ...]]


def _ranked(cost: list[int], text: list) -> Summary:
    """Costs with the ranks of the edit strings of each start state."""
    ranks = []
    for p in STATES:
        order = sorted((q for q in STATES if cost[4 * p + q] < FAR), key=lambda q: text[4 * p + q])
        ranks += [order.index(q) if q in order else 4 for q in STATES]
    return tuple(cost), tuple(ranks)


@lru_cache(None)
def row_edits(symbol: int) -> tuple[Summary, tuple[str, ...]]:
    """The cheapest edits of one row with the inserts before it: summary, and the
    edit string of every pair of states. More than two inserts in a row are never
    cheapest, since they lead back to a state."""
    who, fault = divmod(symbol - _FIRST_SYMBOL, 3)
    best = [(FAR, "")] * 16
    for p in STATES:
        at, paid, text = p, 0, ""
        for _ in range(3):
            ends = [(at, DELETE, "D")]
            stays = TRUNCATED if fault == CUT else 0
            if fault != GONE:
                if who == S and at == START or who == U and at != U or who == A and at == U:
                    ends.append((who, stays, "K"))
                ends.append((_NEXT[at], REROLE + stays, "R"))
            for q, more, letter in ends:
                best[4 * p + q] = min(best[4 * p + q], (paid + more, text + letter))
            at, paid, text = _NEXT[at], paid + INSERT, text + "I"
    return _ranked([c for c, _ in best], [t for _, t in best]), tuple(t for _, t in best)


def joined(left: Summary, right: Summary) -> Summary:
    """The summary of one run followed by another."""
    (lc, lr), (rc, rr) = left, right
    cost, place = [FAR] * 16, [()] * 16
    for p in STATES:
        for q in STATES:
            least = min((min(lc[4 * p + r] + rc[4 * r + q], FAR), lr[4 * p + r], rr[4 * r + q]) for r in STATES)
            cost[4 * p + q], place[4 * p + q] = least[0], least[1:]
    return _ranked(cost, place)


def _forward(items: list[Summary], vector: tuple) -> tuple:
    for cost, _ in items:
        vector = tuple(min(vector[p] + cost[4 * p + q] for p in STATES) for q in STATES)
    return vector


def _backward(items: list[Summary], vector: tuple) -> tuple:
    for cost, _ in reversed(items):
        vector = tuple(min(cost[4 * p + q] + vector[q] for q in STATES) for p in STATES)
    return vector


def _least_crossing(items: list[Summary], start: int, vector: tuple) -> int:
    """The end state of the audit-least of the cheapest paths from `start`: the
    backward sweep carries, for each state, the end to which its least path leads."""
    carried = tuple(STATES)
    for cost, rank in reversed(items):
        ways = [min((cost[4 * p + q] + vector[q], rank[4 * p + q], q) for q in STATES) for p in STATES]
        vector, carried = tuple(w[0] for w in ways), tuple(carried[w[2]] for w in ways)
    return carried[start]


def crossings(items: list[Summary], start: int, end: int) -> list[int]:
    """The state behind every item on the wanted path from start to end."""
    out = [end] * len(items)
    todo = [(0, len(items), start, end)]
    while todo:
        low, high, p, q = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        to_here = _forward(items[low:middle], tuple(0 if s == p else FAR for s in STATES))
        from_here = _backward(items[middle:high], tuple(0 if s == q else FAR for s in STATES))
        total = [x + y for x, y in zip(to_here, from_here, strict=True)]
        least = [s for s in STATES if total[s] == min(total)]
        at = least[0] if len(least) == 1 else _least_crossing(
            items[low:middle], p, tuple(from_here[s] if s in least else FAR for s in STATES))
        out[middle - 1] = at
        todo += [(low, middle, p, at), (middle, high, at, q)]
    return out


def closing(whole: Summary) -> tuple[int, int, str]:
    """(last state, cost, closing edits) of a conversation's cheapest edits."""
    cost, rank = whole
    least, _, q = min((cost[q] + _CLOSE[q][0], rank[q], q) for q in STATES)
    return q, least, _CLOSE[q][1]


@lru_cache(1 << 15)
def block_summary(symbols: str) -> Summary:
    if len(symbols) == 1:
        return row_edits(ord(symbols))[0]
    middle = len(symbols) // 2
    return joined(block_summary(symbols[:middle]), block_summary(symbols[middle:]))


@lru_cache(1 << 15)
def block_edits(symbols: str, start: int, end: int) -> str:
    rows = [row_edits(ord(s)) for s in symbols]
    states = [start, *crossings([summary for summary, _ in rows], start, end)]
    return "".join(texts[4 * p + q] for (_, texts), p, q in zip(rows, states[:-1], states[1:], strict=True))


# --- rows -----------------------------------------------------------------

def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the row's hash names."""
    rows = rows_of(conversations, {"conv_id": conv_id, "turn": turn, "role": role, "text": text})
    fault = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % FAULT_MODULUS
    rows = rows.withColumn("fault", fault).where(F.col("fault") != DROP)
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("fault") == TO_USER, F.lit("user")).otherwise(_or_space("role")).alias("role"),
        F.when(F.col("fault") == EMPTY, F.lit("")).when(F.col("fault") == STRIP, F.translate(_or_space("text"), ".!?", ""))
        .otherwise(_or_space("text")).alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))))).drop("fault", "copy")


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary")))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, symbol, fault) of every row: place ascends in a
    conversation's order, fault is blank, duplicate, truncated or null. Texts stay
    behind. Equal rows are dealt out by a running id, so that a row repeated very
    often is no single range."""
    words = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    light = _with_digest(rows).select(
        "conv_id", "turn", "role", "digest", (words == "").alias("blank"),
        (~F.substring(words, -1, 1).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("copy"))
    ordered = [*_order(), F.col("copy")]
    placed = stored(light.repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop("copy").withColumn(
        "place", F.monotonically_increasing_id()))
    same = ["conv_id", "role", "digest"]
    # Only rows that occur more than once are joined back, each key once.
    again = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    test = F.lit(True)
    for c in same:
        test = test & F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = placed.join(again, test, "left")
    who = F.substring("role", 1, 1)
    fault = (F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate")
             .when(F.col("open"), "truncated"))
    number = (3 * F.when(who == "s", S).when(who == "u", U).when(who == "a", A).otherwise(0)
              + F.when(F.col("fault").isNull(), WHOLE).when(F.col("fault") == "truncated", CUT).otherwise(GONE))
    return known.withColumn("fault", fault).select(
        "conv_id", "turn", "place", F.char(number + _FIRST_SYMBOL).alias("symbol"), "fault")


def _in_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(columns as lists) -> columns as lists, batch by batch."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
             "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(out, fields, strict=True)],
                                             names=[n for n, _ in fields])

    return df.mapInArrow(run, schema)


def _flat(summary: Summary) -> list[int]:
    return [*summary[0], *summary[1]]


def _unflat(values: list[int]) -> Summary:
    return tuple(values[:16]), tuple(values[16:])


def _combined(items: list[list[int]]) -> list[int]:
    found = [_unflat(x) for x in items]
    while len(found) > 1:
        found = [joined(*found[i: i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return _flat(found[0])


def blocks(rows: DataFrame) -> DataFrame:
    """(key, block, several, symbols) of every run of at most ROWS rows of a
    conversation; several tells conversations of more than one block, which are
    numbered from 0. `key` stands for conv_id without nulls."""
    runs = stored(rows.groupBy("key", F.floor(F.col("place") / ROWS).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]),
                     "").alias("symbols")))
    long = broadcast_checked(stored(runs.groupBy(F.col("key").alias("k")).count().where("count > 1").select("k")))
    same = F.col("key") == F.col("k")
    short = runs.join(long, same, "left_anti").select("key", F.lit(0).cast("bigint").alias("block"),
                                                      F.lit(False).alias("several"), "symbols")
    parts = numbered(runs.join(long, same, "left_semi"), "number", [F.col("block")], key="key").select(
        "key", (F.col("number") - 1).alias("block"), F.lit(True).alias("several"), "symbols")
    return stored(short.union(parts))


def _above() -> Column:
    return F.floor(F.col("block") / FAN).alias("above")


def solved(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, block, edits) of every block, and (key, cost, closing) of every
    conversation. Levels are written, so a lost executor costs a level at most."""
    leaves = stored(_in_arrow(
        runs, lambda k, b, m, s: (k, b, m, s, [_flat(block_summary(x)) for x in s]),
        "key string, block bigint, several boolean, symbols string, summary array<bigint>"))
    levels = [leaves.where("several").select("key", "block", "summary")]
    while levels[-1].where("block > 0").limit(1).count():
        grouped = levels[-1].groupBy("key", _above()).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("block", "summary"))), lambda x: x["summary"]).alias("items"))
        levels.append(stored(_in_arrow(grouped, lambda k, b, x: (k, b, [_combined(i) for i in x]),
                                       "key string, block bigint, summary array<bigint>")))

    def close(keys, own, summaries):
        ends = [closing(_unflat(x)) for x in summaries]
        return keys, own, [START] * len(keys), *([e[i] for e in ends] for i in range(3))

    short = leaves.where("not several").select("key", "block", "summary")
    tops = stored(_in_arrow(short.union(levels[-1]), close,
                            "key string, block bigint, start int, end int, cost bigint, closing string"))
    states = tops.select("key", "block", "start", "end")
    for below in reversed(levels[:-1]):
        children = below.groupBy(F.col("key").alias("k"), _above()).agg(
            F.sort_array(F.collect_list(F.struct("block", "summary"))).alias("items"))
        pairs = children.join(states, (F.col("key") == F.col("k")) & (F.col("block") == F.col("above"))).select(
            "key", "start", "end", F.transform("items", lambda x: x["block"]).alias("blocks"),
            F.transform("items", lambda x: x["summary"]).alias("summaries"))
        states = stored(_in_arrow(pairs, _descend, "key string, block bigint, start int, end int"))
    if len(levels) > 1:
        states = states.union(tops.join(short.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_semi")
                              .select("key", "block", "start", "end"))
    ready = leaves.select(F.col("key").alias("k"), F.col("block").alias("b"), "symbols").join(
        states, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b"))).select("key", "block", "symbols", "start", "end")
    edits = _in_arrow(ready, lambda k, b, s, p, q: (k, b, list(map(block_edits, s, p, q))),
                      "key string, block bigint, edits string")
    return edits, tops.select("key", "cost", "closing")


def _descend(keys, starts, ends, blocks_, summaries):
    out = ([], [], [], [])
    for key, start, end, own, items in zip(keys, starts, ends, blocks_, summaries, strict=True):
        states = [start, *crossings([_unflat(x) for x in items], start, end)]
        for column, values in zip(out, ([key] * len(own), own, states[:-1], states[1:]), strict=True):
            column += values
    return out


def _key(conv_id: str = "conv_id") -> Column:
    """The id as a string that tells null from the rest."""
    return F.concat(F.when(F.col(conv_id).isNull(), F.lit("n")).otherwise(F.lit("v")),
                    F.coalesce(F.col(conv_id).cast("string"), F.lit("")))


_LEGAL = ("su", "ua", "au")


def _pair_faults(symbols_: str) -> tuple[int, str, str]:
    """Adjacent roles that do not follow each other, first and last role."""
    who = "".join("-sua"[(ord(c) - _FIRST_SYMBOL) // 3] for c in symbols_)
    return sum(who[i: i + 2] not in _LEGAL for i in range(len(who) - 1)), who[0], who[-1]


def illegal(runs: DataFrame) -> DataFrame:
    """(k, illegal): pairs inside blocks, and at the borders of neighbours."""
    def run(keys, own, several, texts):
        found = [_pair_faults(x) for x in texts]
        return keys, own, several, *([f[i] for f in found] for i in range(3))

    inside = stored(_in_arrow(runs, run, "key string, block bigint, several boolean, n bigint, first string, last string"))
    sides = inside.where("several")
    after = sides.select(F.col("key").alias("_key"), (F.col("block") - 1).alias("_block"), F.col("first").alias("_first"))
    borders = sides.join(after, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block"))).select(
        "key", (~F.concat("last", "_first").isin(*_LEGAL)).cast("bigint").alias("n"))
    return inside.select("key", "n").union(borders).groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("illegal"))


def audits(edits: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, cost, audit): the edit strings of the blocks in order."""
    whole = edits.groupBy(F.col("key").alias("k")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "").alias("edits"))
    return ends.join(whole, F.col("key") == F.col("k")).select("key", "cost", F.concat("edits", "closing").alias("audit"))


class _Replay:
    """The audit of one conversation, applied to its rows as they stream by."""

    def __init__(self, audit: str):
        self._audit, self._at, self._state = audit, 0, START

    def _given(self) -> str:
        self._state = _NEXT[self._state]
        return "user" if self._state == U else "assistant"

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self._audit[self._at: self._at + 1] == "I":
            self._at += 1
            yield "I", self._given(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()
        edit = self._audit[self._at]
        self._at += 1
        if edit == "R":
            yield edit, self._given(), text
        elif edit == "K":
            self._state = {"s": S, "u": U, "a": A}[role[0]]
            yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()


def _streams(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows of a conversation behind its audit, in order: a merge join in which
    the audit is not repeated for every row."""
    parts = _with_digest(rows).select(_key().alias("key"), F.lit(1).alias("part"), "turn", "role", "digest", "text").unionByName(
        audited.select("key", F.lit(0).alias("part"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"),
                       F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text")))
    return parts.repartition("key").sortWithinPartitions("key", "part", F.col("turn").asc_nulls_first(), "role", "digest").select(
        "key", "part", "role", "text")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator]]:
    """(key, repaired rows) of one conversation after the other; only the
    batch at hand and one audit are in memory."""
    key = replay = None
    for batch in batches:
        for k, part, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if part == 0:
                if replay is not None:
                    yield key, replay.end()
                key, replay = k, _Replay(text)
                yield key, iter(())
            else:
                yield key, replay.row(role, text)
    if replay is not None:
        yield key, replay.end()


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(key, number, edit, role, text): the rows of the repaired conversations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, key, number = [], 0, None, 0
        for k, some in _replayed(batches):
            if k != key:
                key, number = k, 0
            for edit, role, text in some:
                out.append((k, number, edit, role, text))
                number, size = number + 1, size + len(text)
            if size > 1 << 22 or len(out) > 4096:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    return _streams(rows, audited).mapInArrow(run, "key string, number bigint, edit string, role string, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      names=["key", "number", "edit", "role", "text"])


def text_digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(key, repaired_sha256): of role:text, joined by newlines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, digest, empty = [], [], None, True
        for key, some in _replayed(batches):
            if not keys or keys[-1] != key:
                if digest is not None:
                    found.append(digest.hexdigest())
                keys.append(key)
                digest, empty = hashlib.sha256(), True
            for _, role, text in some:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if digest is not None:
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())],
                                         names=["key", "repaired_sha256"])

    return _streams(rows, audited).mapInArrow(run, "key string, repaired_sha256 string")


def repair(conversations: DataFrame, **columns) -> DataFrame:
    """One row per conv_id of the input: gaps, the counts of faults, cost, audit
    and repaired_sha256."""
    rows = damaged(conversations, **columns)
    marked = stored(symbols(rows).withColumn("key", _key()))
    runs = blocks(marked)
    edits, ends = solved(runs)
    audited = stored(audits(edits, ends))
    turns = marked.groupBy("key", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS])
    counts = turns.groupBy(F.col("key").alias("_key")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(f).alias(f) for f in FAULTS])
    ids = rows_of(conversations, {"conv_id": columns.get("conv_id", "conv_id")}).distinct().withColumn("id_key", _key())
    out = ids
    for other, name in ((counts, "_key"), (illegal(runs), "k"), (audited, "key"),
                        (text_digests(rows, audited).withColumnRenamed("key", "d"), "d")):
        out = out.join(other, F.col("id_key") == F.col(name), "left").drop(name)
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
