"""Removal of repeated 50-byte strings against a plain version."""

import random

import numpy as np

from veritrail.llm import suffix_dedup as S

from . import brute
from .conftest import pairs


def key(rows):
    return sorted(rows, key=repr)


def test_documents(all_docs):
    assert key(map(tuple, S.digests(all_docs).collect())) == key(brute.spans50(pairs(all_docs)))


def test_passages_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 3000)
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (49, 50, 51, 120, 400)]
    rows = []
    for i in range(150):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300)))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("xyzé") + p[k + 1:]
            text += p[: rng.randrange(45, len(p) + 1)] if rng.random() < 0.5 else p
        rows.append((rng.randrange(10_000), text))
    rows += [(20_000 + k, t) for k, t in enumerate(["a" * 300, "a" * 60, "ab" * 100, "ba" * 50, "a" * 49, "é" * 40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert key(map(tuple, S.digests(df).collect())) == key(brute.spans50(rows))
    kept = {r["doc_id"]: (r["kept"], r["spans"]) for r in S.deduplicate(df).collect()}
    for i, t in rows:
        gone = bytearray(t.encode())
        for s in reversed(kept[i][1]):
            del gone[s["from"]: s["to"]]
        if sum(j == i for j, _ in rows) == 1:
            assert bytes(gone) == bytes(kept[i][0])


def test_runs_cover_every_window():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab c") for _ in range(n)) for n in (0, 10, 49, 50, 51, 500, 3000)] + [b"a" * 200]
    r = S.Runs(texts)
    seen = sorted((int(d), int(f) + k) for d, f, c in zip(r.doc, r.first, r.count) for k in range(c))
    assert seen == [(i, p) for i, t in enumerate(texts) for p in range(max(0, len(t) - 49))]
    assert r.count.max() <= 27


def test_sort_and_tries():
    rng = np.random.default_rng(6)
    data = bytes(rng.integers(97, 99, 3000, np.uint8)) + bytes(range(200)) * 4 + b"z" * 200
    starts = rng.permutation(len(data) - 60)
    words = S._words(np.frombuffer(data + bytes(50), np.uint8))
    order = S.shallow_sort(words, starts)
    keys = [data[s: s + S.SHALLOW] for s in starts[order]]
    assert keys == sorted(keys)
    owner = rng.integers(0, 40, len(starts))
    least = {}
    for s, o in zip(starts.tolist(), owner.tolist()):
        least[data[s: s + 50]] = min(o, least.get(data[s: s + 50], o))
    want = [least[data[s: s + 50]] < o for s, o in zip(starts.tolist(), owner.tolist())]
    assert S.repeats(data + bytes(50), starts, owner).tolist() == want
    trie = S.BlindTrie()
    strings = [bytes(rng.integers(97, 99, 9, np.uint8)) for _ in range(300)]
    for i, s in enumerate(strings):
        trie.insert(s, i)
    leaves = list(trie.leaves())
    assert [s for s, _ in leaves] == sorted(set(strings))
    assert all(strings[i] == s for s, members in leaves for i in members) and sum(len(m) for _, m in leaves) == 300


def test_empty_and_clashing(clashing):
    assert S.digests(clashing.where("false")).count() == 0
    assert S.digests(clashing).count() == clashing.count()
