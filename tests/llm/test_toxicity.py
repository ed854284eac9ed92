"""The recurrent network: gradients, held-out accuracy, and defined cases."""

import random

import numpy as np
import pytest

from veritrail.llm import toxicity as T


def test_gradients(monkeypatch):
    monkeypatch.setattr(T.np, "float32", np.float64)
    words = T.Words([b"abc de fgh ijk", b"xx abc yyyyyyyyyyyyyyyyyyyyyyyyyy q de"])
    net = T.Network(np.sort(words.hash[:3]))
    base, label, weight = np.cumsum(words.counts) - words.counts, np.array([1.0, 0.0]), np.array([2.0, 1.0])

    class Whole:  # no word is hidden
        def random(self, n):
            return np.ones(n)

    def loss():
        logit = net.scores(words)[1]
        return float((weight * (np.log1p(np.exp(logit)) - label * logit)).sum() / 2)

    gradients = net.learn(words, base, words.counts, label, weight, Whole())
    rng = np.random.default_rng(0)
    for name, value in net.parameters().items():
        for flat in rng.choice(value.size, min(6, value.size), replace=False):
            at = np.unravel_index(flat, value.shape)
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert gradients[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_every_word_is_in_a_window():
    texts = [b" ".join(b"w%d" % i for i in range(n)) for n in (0, 1, 47, 48, 49, 84, 85, 500)] + [b"x" * 100]
    words = T.Words(texts)
    doc, first, count = words.windows()
    base = np.cumsum(words.counts) - words.counts
    for k, n in enumerate(words.counts):
        covered = {int(f) - int(base[k]) + i for d, f, c in zip(doc, first, count) if d == k for i in range(c)}
        assert covered == set(range(n))
    assert words.counts[-1] == 7  # 100 bytes, 16 at a time


def corpus(n, seed):
    rng = random.Random(seed)
    bad = ["worthless", "rubbish", "nastling", "vileness"]
    plain = [f"{a}{b}" for a in ("ta", "ri", "mo", "len", "sol") for b in ("ko", "pa", "nu", "dir", "sem", "ga")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(1 + len(words) // 30):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "er", "s", "."])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, edge_docs, clashing):
    rows, labels = corpus(700, 1)
    docs = spark.createDataFrame([*rows, (9001, ""), (9002, None), (9003, " \n "), (None, "tako worthless")],
                                 "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (9002, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    net = T.fit(docs, marks)
    scored = T.score(docs, net).collect()
    truth = {i: t for i, _, t in labels}
    score = {r["doc_id"]: r["score"] for r in scored if r["doc_id"] in truth}
    import zlib
    test = [i for i in score if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((score[i] >= T.THRESHOLD) == bool(truth[i]) for i in test)
    assert len(test) > 150 and right / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert [r["score"] for r in scored if r["doc_id"] in (9001, 9002, 9003)] == [0, 0, 0]
    assert [r["score"] for r in scored if r["doc_id"] is None][0] > 0
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", T.held_out(docs["doc_id"]).alias("h")).collect()}
    assert {i for i, h in flags.items() if h and i in truth} == set(test)
    # Labels of held-out rows and of unknown rows change nothing.
    assert T.score(edge_docs, None).where("score <> 0").count() == 0
    assert T.score(clashing, net).count() == clashing.count()
    assert T.judged(clashing, marks.where("false")).where("predicted = 1").count() == 0
    assert T.judged(clashing.where("false"), marks).count() == 0
