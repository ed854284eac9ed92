"""Vector join, token ids, packing and token files."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import grid_join, packing, token_files
from veritrail.llm.tokens import Encoder

from . import brute
from .conftest import pairs

ODD = ["", " a", "  a", "a  b", "a \n b", "\n\n x", "é    b", "don't  I'll", "x" * 500 + " y   z", "a <|endoftext|> b",
       "a\x1c b", "　 b c", "tab\t x", " ", "   ", "a ", "a b ", "x\n y", "word. Word, word! (word)", "a\xa0 b", "a\x85 b",
       "à b é c. ñ, 1. 2, .. ,, a.. b,", "ª º. ſ, ǆ", "\n", "a\n", "\na", "a\n\nb", "a\n b\nc", "x.\ny,\nz\n",
       "a\n\xa0b", "é\nÉa\n¿b", "a\r\nb"]


def key(rows):
    return sorted(rows, key=repr)


def brute_vectors(rows, threshold=0.93):
    def ok(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = {i: (np.array(v, float) / np.linalg.norm(v), label) for i, v, label in rows if i is not None and ok(v, label)}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1]
             and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= threshold]
    found = brute.components([i for i, _, _ in rows if i is not None], links)
    n = {i: sum(i in link for link in links) for i in found}
    return [(i, n.get(i, 0), found.get(i), i is None or found[i] == i) for i, _, _ in rows]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 16)
    monkeypatch.setattr(grid_join, "LEAF", 4)
    monkeypatch.setattr(grid_join, "LONG", 3)
    monkeypatch.setattr(grid_join, "PARTNERS", 2)
    rng = np.random.default_rng(7)
    rows, centre = [], rng.normal(size=(5, 12))
    for i in range(220):
        v = centre[i % 5] + rng.normal(size=12) * (0.05, 0.25, 0.6)[i % 3]
        rows.append((i * 2, v.tolist(), i % 2))
    rows += [(1001, rows[0][1], 0), (1003, rows[0][1], 0), (1005, rows[0][1], 1), (1007, [3 * x for x in rows[4][1]], 0)]
    rows += [(2001, None, 0), (2003, [], 0), (2005, [0.0] * 12, 0), (2007, [float("nan")] * 12, 0), (2009, rows[0][1], None),
             (2011, [None, *rows[0][1][1:]], 0), (2013, [float("inf"), *rows[0][1][1:]], 0), (2015, [1.0, 2.0], 0),
             (2017, [2.0, 4.0], 0), (None, rows[0][1], 0), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn(
        "block", F.lit(2)).withColumn("vector", F.lit(3))
    want = key(brute_vectors(rows))
    assert key(map(tuple, grid_join.near_copies(df.repartition(5)).collect())) == want
    assert sum(r[1] for r in want) > 500
    twice = grid_join.near_copies(df.union(df.limit(3)))
    assert set(map(tuple, twice.collect())) == set(map(tuple, want))
    assert grid_join.near_copies(df.where("false")).count() == 0


def test_leaves_do_not_lose_links():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(300, 6))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    u = u[np.lexsort(u[:, :3].T[::-1])]
    box, eps = u[:, :4], np.sqrt(2 - 2 * 0.93)
    i, j = grid_join.join_units(u, u, box, box, 0.93, eps, True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.93, 1))
    assert set(zip(i, j)) == set(zip(a, b))


@pytest.fixture(scope="module")
def encoder():
    if not Path("/opt/tokenizers/byte_bpe_50k.json").exists():
        pytest.skip("public tokenizers not present")
    return Encoder()


def test_encoder_equals_the_library(encoder, small_docs):
    texts = ODD + [t or "" for _, t in pairs(small_docs)]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder._tokenizer.encode_batch(texts, add_special_tokens=False)]
    texts = [t.encode() for t in texts]
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1]) == want[::-1]


def expected(encoder, rows, end):
    return [(i, encoder.encode([(t or "").encode()])[0] + np.array([end], "<u4").tobytes()) for i, t in rows]


def test_packing(encoder, all_docs):
    packed = packing.pack_documents(all_docs, keep_ids=True).cache()
    rows = packed.collect()
    docs = [(i, x) for i, x in expected(encoder, pairs(all_docs), 1)]
    seen, windows = [], {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.append((r["doc_id"], r["start"], r["doc_tokens"], bytes(r["ids"])))
    want = [(i, s, len(x) // 4, x[4 * s: 4 * (s + k)]) for i, x in docs for s, k in packing.cut(len(x) // 4)]
    assert key(seen) == key(want)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(windows) <= total / 2048 * 1.03 + 2
    whole = {r["sequence_id"]: (r["n_tokens"], len(r["ids"])) for r in packing.sequences(packed).collect()}
    assert whole == {k: (sum(x for _, x in v), 4 * sum(x for _, x in v)) for k, v in windows.items()}
    packed.unpersist()
    assert packing.pack_documents(all_docs.where("false")).count() == 0


def test_differencing():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (40, 7), (400, 31)):
        sizes = rng.integers(1, 500, n)
        bins = packing.difference(sizes, m)
        assert len(bins) == n and bins.max() < m
        if n >= 40:
            full = np.bincount(bins, sizes, m)
            assert full.max() - full.min() <= sizes.max()
    assert np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4]).max() <= 16
    assert np.bincount(packing.partition(np.array([1500] * 5)), [1500] * 5).max() == 1500


def test_token_files(encoder, spark, all_docs, tmp_path):
    want = sorted(expected(encoder, pairs(all_docs), 2), key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.digests(all_docs, f"file://{tmp_path}/x", file_bytes=50_000).collect()
    assert len(got) == len(want)
    by_id = {}
    start = 0
    for i, ids in want:
        by_id.setdefault(i, []).append((start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    for r in got:
        if len(by_id[r["doc_id"]]) == 1:
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == by_id[r["doc_id"]][0]
    files = sorted(Path(tmp_path, "x").glob("part-*"))
    assert len(files) > 3 and all(f.read_bytes()[-4:] == b"\xb1\xea\x92\x8f" for f in files)
    import zstandard
    frames = zstandard.ZstdDecompressor().stream_reader(files[0].read_bytes(), read_across_frames=True).read()
    assert frames  # any zstandard reader passes over the seek table
    some = token_files.read(spark, f"file://{tmp_path}/x", wanted=[want[5][0]]).collect()
    assert {bytes(r["ids"]) for r in some} == {x for i, x in want if i == want[5][0]}


def test_starts_of_very_many_files(encoder, spark, tmp_path):
    """File numbers of one task pass a thousand, whose names no longer sort."""
    rows = [(i, f"text {i} " + "word " * (i % 5)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["start"] for r in token_files.digests(df, f"file://{tmp_path}/many", file_bytes=1).collect()}
    start, want = 0, {}
    for i, ids in expected(encoder, rows, 2):
        want[i] = start
        start += len(ids) // 4
    assert got == want
    assert len(list(Path(tmp_path, "many").glob("part-*"))) == 1200


def test_width_of_ids():
    assert [token_files.id_width(n) for n in (50_256, 65_535, 65_536)] == [2, 2, 4]
    with pytest.raises(ValueError, match="do not fit"):
        token_files.id_width(65_536, 2)


def test_special_token_strings(encoder):
    text = "a <|endoftext|> b<|endoftext|>c. <|endoftext|>, x"
    want = [encoder._tokenizer.encode(t, add_special_tokens=False).ids for t in (text, text[2:])]
    assert 50256 in want[0]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([text.encode(), text[2:].encode()])] == want
    plain = np.frombuffer(Encoder(special=False).encode([text.encode()])[0], "<u4").tolist()
    assert 50256 not in plain and len(plain) > len(want[0])


def test_token_file_checks():
    file = token_files.build_file([4, 9], [b"\1\0\2\0", b""], 2) + b"\xb1\xea\x92\x8f"
    assert [(d, i, list(x), n) for d, i, x, n in token_files.read_file(file)] == [(4, 0, [1, 2], 2), (9, 1, [], 0)]
    assert [x is None for _, _, x, _ in token_files.read_file(file, [9])] == [True, False]
    with pytest.raises(ValueError, match="not a token file"):
        list(token_files.read_file(file[:-4] + b"abcd"))
    with pytest.raises(ValueError, match="incomplete"):
        list(token_files.read_file(file[20:]))
    broken = bytearray(file)
    n = 3
    broken[len(file) - 9 - 12 * n + 8] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.read_file(bytes(broken)))


def test_empty_and_clashing(clashing, tmp_path):
    for call in (packing.pack_documents, lambda d: token_files.digests(d, f"file://{tmp_path}/{d.count()}")):
        assert call(clashing.where("false")).count() == 0
        assert call(clashing).count() > 0
