"""Joins on ranges and in order, sessions, versions, sketches, frames and captured
pages against plain versions."""

import difflib
import json
import os
import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from veritrail import schemas
from veritrail.functions.text import block_ratio
from veritrail.operators import asof, documents, frames, intervals, logs, sketches, tables, verify
from veritrail.sources import captured
from veritrail.streaming import joins, sessions

# --- ranges ---------------------------------------------------------------------------


def test_overlap_join(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab") if i % 3 else "hot", a, a + rng.choice([0, 1, 5, 300])) for i in range(150) for a in [rng.randrange(2000)]]
    right = [(i, rng.choice("ab") if i % 3 else "hot", a, a + rng.choice([0, 2, 40, 1500])) for i in range(120) for a in [rng.randrange(2000)]]
    left += [(900, "a", None, 5), (901, None, 1, 5), (902, "none", 1, 5)]
    names = ["k string", "{0}f bigint", "{0}t bigint"]
    l, r = (spark.createDataFrame(rows, ", ".join([f"{s}id bigint", *names]).format(s)) for rows, s in ((left, "l"), (right, "r")))
    for closed in (False, True):
        def meet(x, y):
            if None in x[1:] or x[1] != y[1]:
                return False
            return (x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]) if closed else (
                x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
        want = sorted((x[0], y[0]) for x in left for y in right if meet(x, y))
        for width in (7, 64, 5000):
            for how in ("inner", "left"):
                got = intervals.overlap_join(l, r, ["k"], (F.col("lf"), F.col("lt")), (F.col("rf"), F.col("rt")), width, how, closed)
                pairs = [(x.lid, x.rid) for x in got.collect()]
                alone = [(x[0], None) for x in left if x[0] not in {p for p, _ in want}] if how == "left" else []
                assert sorted(pairs, key=repr) == sorted(want + alone, key=repr)


def test_span_sections_of_a_long_document(spark):
    """Twenty thousand lines are joined by stretches, each a small part."""
    lines = [f"Line {i} says so [{i % 9}]. And then [1, 2] it ends. " if i % 2 else "" for i in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "no mark"), (4, "open [3] end")], "doc_id int, text string")
    got = documents.span_sections(df).collect()
    assert len(got) == 20_001
    at = {r.start: (r.paragraph_id, r.sentence_id) for r in got if r.doc_id == 1}
    offset, want = 0, {}
    for i, line in enumerate(lines):
        for mark in ("[", "[1, 2]"):
            if mark in line:
                place = line.index(mark)
                want[offset + place] = (i, 0 if place < 25 else 1)
        offset += len(line) + 1
    assert at == want
    assert [(r.paragraph_id, r.sentence_id) for r in got if r.doc_id == 4] == [(0, 0)]
    plan = documents.span_sections(df)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


# --- order ----------------------------------------------------------------------------


def test_asof_join(spark):
    rng = random.Random(2)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), rng.randrange(60), i) for i in range(300)] + [(1000, "z", 5, 0), (1001, "hot", None, 0)]
    right = [(key(), rng.randrange(60), rng.choice([None, "x", "y"]), i) for i in range(200)]
    # One instant holds many right rows; the greatest values count.
    right += [("b", 30, v, 7) for v in ("p", "q", "r")] * 2
    l = spark.createDataFrame(left, "id bigint, k string, t bigint, c0 bigint").repartition(7)
    r = spark.createDataFrame(right, "k string, t bigint, v string, n bigint").repartition(5)
    for inclusive in (True, False):
        got = asof.asof_join(l, r, ["k"], ["t"], ["t"], ["v", "n"], inclusive)
        assert got.columns == ["id", "k", "t", "c0", "v", "n"]
        for row in got.collect():
            before = [x for x in right if x[0] == row.k and row.t is not None and (x[1] <= row.t if inclusive else x[1] < row.t)]
            best = max(before, key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3])) if before else (None,) * 4
            assert (row.v, row.n) == best[2:], row
        assert got.count() == len(left)
    assert asof.asof_join(l, r.where("false"), ["k"], ["t"], ["t"], ["v"]).where("v IS NOT NULL").count() == 0
    assert asof.asof_join(l.where("false"), r, ["k"], ["t"], ["t"], ["v"]).count() == 0


def test_asof_join_spreads_a_hot_key(spark):
    """All rows of one key: the only value in force stands before all others and is
    carried over the ranges; no range holds more than its share."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    l = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") + 10).alias("t"))
    r = spark.createDataFrame([("hot", 1, "first"), ("hot", 15_000, "second")], "k string, t bigint, v string")
    got = asof.asof_join(l, r, ["k"], ["t"], ["t"], ["v"])
    assert {x.v: x["count"] for x in got.groupBy("v").count().collect()} == {"first": 14_990, "second": 5_010}
    parts = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and max(parts) < 15_000


def test_tiles_and_percent_ranks(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "v", None]), rng.choice([None, 0.1, 0.5, 0.5, 0.9])) for i in range(203)]
    df = spark.createDataFrame(rows, "id int, venue string, s double")
    got = {r.id: r.tile for r in frames.tiles(df, ["venue"], ["s", "id"], 4).collect()}
    df.createOrReplaceTempView("tiled")
    want = {r.id: r.t for r in spark.sql("SELECT id, ntile(4) OVER (PARTITION BY venue ORDER BY s, id) AS t FROM tiled").collect()}
    assert got == want
    ranks = {(r.venue, r.s): (r.n, r.percent_rank) for r in frames.percent_ranks(df, ["venue"], "s").collect()}
    plain = spark.sql("SELECT DISTINCT venue, s, percent_rank() OVER (PARTITION BY venue ORDER BY s) AS p, count(*) OVER (PARTITION BY venue, s) AS n "
                      "FROM tiled WHERE s IS NOT NULL").collect()
    assert ranks == {(r.venue, r.s): (r.n, r.p) for r in plain}
    few = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "id int, venue string, s double")
    assert sorted(r.tile for r in frames.tiles(few, ["venue"], ["s"], 4).collect()) == [1, 2]
    years = spark.createDataFrame([("v", y) for y in (2000, 2000, 2003, 2004, 2009, None)], "venue string, year int")
    assert sorted((r.year, r.n, r.trailing) for r in frames.trailing_counts(years, ["venue"], "year", 5).collect()) == [
        (2000, 2, 2), (2003, 1, 3), (2004, 1, 4), (2009, 1, 1)]


def test_cube_tells_totals_from_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "p string, q string")
    got = {(r.p, r.q, r.level): r.n for r in logs.count_cube(df, ["p", "q"]).collect()}
    assert got[None, None, 3] == 3 and got["a", None, 0] == 1 and got["a", None, 1] == 2 and got[None, "x", 2] == 2 and got[None, "x", 0] == 1


# --- streams --------------------------------------------------------------------------

START = datetime(2026, 1, 1)


def put(folder, name, rows):
    """A file of (user_id, minute, n) events. A name sorts by age."""
    folder.mkdir(exist_ok=True)
    path = folder / f"{name}.json"
    path.write_text("\n".join(json.dumps({"user_id": u, "minute": m}) for u, m in rows))
    os.utime(path, (1_700_000_000 + int(name), 1_700_000_000 + int(name)))


def stream_of(spark, folder):
    return (spark.readStream.schema("user_id INT, minute INT").option("maxFilesPerTrigger", 1).json(str(folder))
            .select("user_id", "minute", (F.lit(START) + F.make_dt_interval(mins=F.col("minute"))).alias("event_time")))


def test_sessions_as_stream(spark, tmp_path):
    src, out, check = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ck")
    put(src, "1", [(1, 0), (1, 10), (2, 5), (1, 25)])
    put(src, "2", [(1, 100), (2, 20), (2, 200)])

    def drain():
        query = sessions.write_sessions(stream_of(spark, src), out, check, "30 minutes", available_now=True, gap="30 minutes")
        query.awaitTermination(120)
        return sessions.late_rows(query)

    assert drain() == 0
    first = spark.read.parquet(out).count()
    # It goes on from its checkpoint: the row of minute 3 is late, the last one closes all before.
    put(src, "3", [(1, 300), (2, 205)])
    put(src, "4", [(1, 3), (3, 2_000)])
    put(src, "5", [(3, 2_001)])
    assert drain() == 1
    got = spark.read.parquet(out)
    assert got.count() > first
    kept = [(u, m) for f in sorted(src.glob("*.json")) for u, m in [tuple(json.loads(x).values()) for x in f.read_text().split("\n")]]
    kept.remove((1, 3))
    batch = sessions.sessions(spark.createDataFrame(
        [(u, START + timedelta(minutes=m)) for u, m in kept], "user_id int, event_time timestamp"), gap="30 minutes")
    shape = lambda df: sorted((r.user_id, r.first_event, r.session_end, r.n) for r in df.collect() if r.user_id != 3)
    assert shape(got) == shape(batch)


def test_stream_join_is_the_batch_join(spark, tmp_path):
    found, checked = tmp_path / "found", tmp_path / "checked"
    a = [[(1, 0), (2, 1), (1, 50)], [(1, 100), (3, 110)], [(4, 150), (1, 160)]]
    b = [[(1, 30), (2, 70)], [(1, 110), (1, 140)], [(4, 210), (5, 150)]]
    for name, parts in ((found, a), (checked, b)):
        for i, rows in enumerate(parts):
            put(name, str(i + 1), rows)
        # Much later rows let both watermarks pass.
        put(name, "8", [(99, 5_000)])
        put(name, "9", [(98, 9_000)])
    side = lambda df, name: df.select(F.col("user_id").alias("paper_id"), F.col("event_time").alias(f"{name}_at"), F.col("minute").alias(name))
    stream = joins.followed_within(side(stream_of(spark, found), "found"), side(stream_of(spark, checked), "checked"), seconds=3600,
                                   delays=("10 minutes", "10 minutes"))
    query = stream.writeStream.format("memory").queryName("followed").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    rows = lambda parts: spark.createDataFrame([(u, m, START + timedelta(minutes=m)) for p in parts for u, m in p], "user_id int, minute int, event_time timestamp")
    batch = joins.followed_within(side(rows(a), "found"), side(rows(b), "checked"), seconds=3600)
    shape = lambda df: sorted(((r.paper_id, r.found, r.checked) for r in df.collect() if r.paper_id < 90), key=repr)
    assert shape(spark.table("followed")) == shape(batch)
    assert shape(batch) == sorted([(1, 0, 30), (2, 1, None), (1, 50, 110), (1, 100, 110), (1, 100, 140), (3, 110, None), (4, 150, 210),
                                   (1, 160, None)], key=repr)


# --- versions --------------------------------------------------------------------------


def test_upsert_touches_the_buckets_it_hits(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    rows = lambda xs: spark.createDataFrame(xs, "k string, v string, at bigint")
    tables.upsert(rows([(f"k{i}", "old", i) for i in range(500)]), target, ["k"], ["at"], buckets=32)
    assert len(list((tmp_path / "t/data/v=0").glob("bucket=*"))) == 32
    version = tables.upsert(rows([("k1", "new", 900), ("k2", "stale", 0), ("k1", "newest", 901), ("k600", "more", 1)]), target, ["k"], ["at"])
    assert version == 1 and len(list((tmp_path / "t/data/v=1").glob("bucket=*"))) <= 3
    table = lambda *v: {r.k: r.v for r in tables.latest_table(spark, target, *v).collect()}
    now = table()
    assert len(now) == 501 and (now["k1"], now["k2"], now["k600"]) == ("newest", "old", "more")
    assert table(0)["k1"] == "old"
    # The same batch again, and an empty one, change nothing.
    tables.upsert(rows([("k1", "new", 900), ("k2", "stale", 0), ("k1", "newest", 901), ("k600", "more", 1)]), target, ["k"], ["at"], version=1)
    assert table() == now
    assert tables.upsert(rows([]), target, ["k"], ["at"]) == 1 and table() == now
    # A version that was not finished is not seen.
    (tmp_path / "t/manifest/v=1/_SUCCESS").rename(tmp_path / "t/manifest/v=1/unfinished")
    assert table()["k1"] == "old"


def test_verification_cache(spark, tmp_path):
    papers = lambda *ids: spark.createDataFrame([(i, f"Title {i}", [f"A Name{i}"], 2020, f"10.1/{i}") for i in ids],
                                                "ord int, title string, authors array<string>, year int, doi string")
    registry = lambda *ids: {
        "crossref": spark.read.schema(schemas.CROSSREF_WORK).json(spark.sparkContext.parallelize([json.dumps(
            {"DOI": f"10.1/{i}", "title": [f"Title {i}"], "author": [{"given": "A", "family": f"Name{i}"}], "issued": {"date-parts": [[2020]]}}) for i in ids])),
        "s2_search": spark.createDataFrame([], "query_title string, rank int, " + schemas.S2_PAPER),
        "openalex": spark.createDataFrame([], schemas.OPENALEX_WORK),
        "openalex_search": spark.createDataFrame([], "query_title string, rank int, " + schemas.OPENALEX_WORK)}
    path = f"file://{tmp_path}/cache"
    run = lambda p, r: {x.ord: (x.verification_status, x.verification_cached) for x in verify.verify_and_keep(p, path, **r).collect()}
    assert run(papers(1, 2), registry(1)) == {1: ("LIKELY_REAL", False), 2: ("UNVERIFIED", False)}
    # Known DOIs keep their verdict although the registry has changed.
    assert run(papers(1, 2, 3), registry(2, 3)) == {1: ("LIKELY_REAL", True), 2: ("UNVERIFIED", True), 3: ("LIKELY_REAL", False)}
    assert tables.latest_table(spark, path).count() == 3


# --- sketches --------------------------------------------------------------------------


def test_sketches_merge_and_keep_their_bounds(spark, tmp_path):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "c2").otherwise("hot").alias("claim"), (F.col("id") * 7919 % 20_011).alias("paper"),
        (F.col("id") * 31 % 1_000 / 1000).alias("score"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("d"))
    path = f"file://{tmp_path}/sketches"
    by_day = sketches.daily(df, ["claim"], F.col("d"), F.col("paper"), F.col("score"))
    sketches.store(by_day, path)
    whole = sketches.merged(sketches.load(spark, path), ["claim"])
    halves = sketches.merged(sketches.merged(sketches.load(spark, path, last_day="2026-01-02"), ["claim"]).unionByName(
        sketches.merged(sketches.load(spark, path, first_day="2026-01-03"), ["claim"])), ["claim"])
    a, b = ({r.claim: r for r in sketches.report(x, ["claim"]).collect()} for x in (whole, halves))
    exact = {r.claim: r for r in df.groupBy("claim").agg(F.countDistinct("paper").alias("papers"), F.count("score").alias("n")).collect()}
    for claim, row in exact.items():
        assert a[claim].n == b[claim].n == row.n and a[claim].distinct == b[claim].distinct
        assert abs(a[claim].distinct - row.papers) <= 3 * sketches.DISTINCT_ERROR * row.papers
        for q, one, two in zip((0.25, 0.5, 0.75), a[claim].quantiles, b[claim].quantiles):
            assert abs(one - q) <= sketches.RANK_ERROR + 0.002 and abs(two - q) <= sketches.RANK_ERROR + 0.002
    # A day that is written again replaces itself only.
    sketches.store(by_day.where("day = '2026-01-03'"), path)
    assert {r.claim: r.n for r in sketches.merged(sketches.load(spark, path), ["claim"]).collect()} == {c: r.n for c, r in exact.items()}


# --- titles and pages -------------------------------------------------------------------


def test_block_ratio_is_the_plain_one():
    rng = random.Random(4)
    plain = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    pairs = [("abab" * 20, "baba" * 20), ("a" * 150, "a" * 149), ("abcd", "bcda"), ("x", "y"), ("private thread", "private volatile thread"),
             ("ab" * 150, "ba" * 150), ("a" * 300, "a" * 300), ("the of " * 60, "of the " * 50), ("q" + "ab " * 90, "ab " * 90 + "q")]
    for n in (3, 8, 30, 120, 260):
        for _ in range(60):
            letters = rng.choice(["ab", "abc ", "abcdefghij klm"])
            a = "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
            b = "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
            if rng.random() < 0.5:
                at = rng.randrange(len(a) + 1)
                b = a[:at] + b[:3] + a[at:]
            pairs.append((a, b))
    for a, b in pairs:
        assert abs(block_ratio(a, b) - plain(a, b)) < 1e-12, (a, b)
    assert block_ratio("", "x") == block_ratio(None, "x") == 0.0


def test_captured_pages(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    work = lambda i: {"id": f"W{i}", "title": f"T {i}", "publication_year": 2000 + i if i != 4 else None, "type": "article" if i % 2 else "preprint",
                      "authorships": [{"author": {"display_name": f"A {i}"}}], "abstract_inverted_index": {"word": [0, i]}, "unknown": 1}
    for p in range(3):
        (folder / f"p{p}.json").write_text(json.dumps({"query": f"q{p}", "results": [work(i) for i in range(p * 4, p * 4 + 4)]}))
    (folder / "empty.json").write_text('{"query": "none", "results": null}')
    path, schema = f"file://{folder}", "id STRING, title STRING, publication_year INT, type STRING, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, " \
        "abstract_inverted_index MAP<STRING, ARRAY<INT>>"
    df = captured.captured(spark, path, "openalex", schema)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 12
    first = df.where("id = 'W1'").first()
    assert (first.query, first.page, first["rank"], first.authorships[0].author.display_name, first.abstract_inverted_index) == ("q0", "p0.json", 1, "A 1", {"word": [0, 1]})
    some = df.where("publication_year >= 2003 AND publication_year < 2009 AND type = 'article' AND title <> 'T 5'")
    assert sorted(r.id for r in some.collect()) == ["W3", "W7"]
    from contextlib import redirect_stdout
    from io import StringIO
    with redirect_stdout(StringIO()) as shown:
        some.explain("formatted")
    pushed = next(x for x in shown.getvalue().split("\n") if x.startswith("PushedFilters"))
    assert all(x in pushed for x in ("GreaterThanOrEqual(publication_year,2003)", "LessThan(publication_year,2009)", "EqualTo(type,article)"))
    # What the read took over is not tested again behind it.
    behind = [x for x in shown.getvalue().split("\n") if x.startswith("Condition")]
    assert all("publication_year" not in x for x in behind) and any("title" in x for x in behind)

    def drain():
        query = captured.captured_stream(spark, path, "openalex", schema).select("id").writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert drain() == 12
    (folder / "q1.json").write_text(json.dumps({"query": "later", "results": [work(77)]}))
    assert drain() == 13
