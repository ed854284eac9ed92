"""Toxicity by a bidirectional gated recurrent network with attention pooling
over character and word inputs, trained in numpy.

A word's input is its embedding beside the pooled states of a network of the
same kind that reads its bytes; words of more than WORD_BYTES bytes are read as
several. The word network reads windows of WINDOW words, one every STRIDE words,
so they overlap; the score of a text is that of its worst window, and every word
of every text is in one or two of them.

Training is on a bounded sample: the POSITIVE_DOCS and NEGATIVE_DOCS labelled
texts of least hash, and of each at most DOC_WINDOWS evenly spread windows. A
label is true of some window only, so later epochs learn from the window that
scores highest. Labels are used for nothing else, and no other column is an input.

Defined cases: a null, empty or white-space text has score 0; without labels of
both kinds every score is 0; repeated rows score alike; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, as_bytes, blocks, rows_of

WINDOW = 48
STRIDE = 36
WORD_BYTES = 16
POSITIVE_DOCS = 1000
NEGATIVE_DOCS = 2500
DOC_WINDOWS = 8
VOCABULARY = 20_000
STEPS = 500
CLEAN_WEIGHT = 4.0
HIDDEN = 8
THRESHOLD = 0.7
_BATCH = 64
_SCORE_BLOCK = 1 << 21
_REMEMBERED = 300_000


class Words:
    """The words of some texts: the distinct ones with their bytes, and which of
    them stands at every place."""

    def __init__(self, texts: list[bytes]):
        b = Block(texts, lower=True)
        start, end, doc = b.words()
        parts = -(-(end - start) // WORD_BYTES)
        if len(parts) and parts.max() > 1:
            first = np.repeat(start, parts)
            nth = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = first + nth * WORD_BYTES
            end = np.minimum(np.repeat(end, parts), start + WORD_BYTES)
            doc = np.repeat(doc, parts)
        self.hash, place, self.at = np.unique(b.hashes(start, end), return_index=True, return_inverse=True)
        s, e = start[place], end[place]
        data = np.concatenate((b.data, np.zeros(WORD_BYTES, np.uint8)))
        data = np.where((data >= 65) & (data <= 90), data + 32, data)
        self.mask = np.arange(WORD_BYTES) < (e - s)[:, None]
        self.bytes = data[s[:, None] + np.arange(WORD_BYTES)] * self.mask
        self.counts = np.bincount(doc, minlength=len(texts))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first place and number of words of every window."""
        count = np.where(self.counts > 0, 1 + -(-np.maximum(0, self.counts - WINDOW) // STRIDE), 0)
        doc = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        base = np.cumsum(self.counts) - self.counts
        return doc, base[doc] + nth * STRIDE, np.minimum(WINDOW, self.counts[doc] - nth * STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Reader:
    """Bidirectional gated recurrent layer with attention pooling."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator):
        def weights(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        self.hidden = hidden
        self.p = {"w": weights(2, inputs, 3 * hidden), "u": weights(2, hidden, 3 * hidden),
                  "b": np.zeros((2, 3 * hidden), np.float32), "a": weights(2 * hidden, 2 * hidden),
                  "v": weights(2 * hidden, 1)[:, 0]}

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs times the weights of both directions: (..., 6 hidden)."""
        return np.concatenate([x @ self.p["w"][d] + self.p["b"][d] for d in (0, 1)], axis=-1)

    def forward(self, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Pooled states (B, 2 hidden) of projected (T, B, 6 hidden) with mask
        (T, B); what backward needs, if kept."""
        length, batch, _ = projected.shape
        n = self.hidden
        states = np.empty((length, batch, 2 * n), np.float32)
        full = mask.all(axis=1)
        saved: list = [[None] * length, [None] * length]
        for d in (0, 1):
            u = self.p["u"][d]
            h = np.zeros((batch, n), np.float32)
            for k in range(length) if d == 0 else range(length - 1, -1, -1):
                xw, hu = projected[k, :, 3 * n * d: 3 * n * (d + 1)], h @ u
                gates = _gate(xw[:, : 2 * n] + hu[:, : 2 * n])
                z, r = gates[:, :n], gates[:, n:]
                new = _squash(xw[:, 2 * n:] + r * hu[:, 2 * n:])
                if keep:
                    saved[d][k] = (h, z, r, new, hu[:, 2 * n:])
                after = new + z * (h - new)
                h = after if full[k] else np.where(mask[k][:, None], after, h)
                states[k, :, n * d: n * (d + 1)] = h
        key = _squash((states.reshape(-1, 2 * n) @ self.p["a"]).reshape(states.shape))
        logit = key @ self.p["v"]
        logit[~mask] = -1e9
        weight = np.exp(logit - logit.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return pooled, (saved, states, key, weight, mask) if keep else None

    def backward(self, d_pooled: np.ndarray, cache, grads: dict) -> np.ndarray:
        """Adds to grads; returns the gradient of `projected`."""
        saved, states, key, weight, mask = cache
        n = self.hidden
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_logit = weight * (d_weight - (weight * d_weight).sum(axis=0)) * mask
        grads["v"] += np.einsum("tb,tbh->h", d_logit, key)
        d_key = d_logit[..., None] * self.p["v"] * (1 - np.abs(key)) ** 2
        grads["a"] += np.tensordot(states, d_key, ((0, 1), (0, 1)))
        d_states = weight[..., None] * d_pooled + d_key @ self.p["a"].T
        out = np.empty((*mask.shape, 6 * n), np.float32)
        for d in (0, 1):
            ut = self.p["u"][d].T
            carry = np.zeros_like(d_states[0, :, :n])
            for k in range(len(mask) - 1, -1, -1) if d == 0 else range(len(mask)):
                before, z, r, new, hun = saved[d][k]
                total = d_states[k, :, n * d: n * (d + 1)] + carry
                live = total * mask[k][:, None]
                d_new = live * (1 - z) * (1 - np.abs(new)) ** 2
                d_z = live * (before - new) * 0.25 * ((z > 0) & (z < 1))
                d_r = d_new * hun * 0.25 * ((r > 0) & (r < 1))
                out[k, :, 3 * n * d: 3 * n * (d + 1)] = np.concatenate((d_z, d_r, d_new), axis=1)
                d_hu = np.concatenate((d_z, d_r, d_new * r), axis=1)
                grads["u"][d] += before.T @ d_hu
                carry = total - live + live * z + d_hu @ ut
        return out

    def backward_inputs(self, x: np.ndarray, d: np.ndarray, grads: dict) -> np.ndarray:
        """Gradient of the inputs x of `project`, from that of its result."""
        half = 3 * self.hidden
        for k in (0, 1):
            grads["w"][k] += x.T @ d[:, half * k: half * (k + 1)]
            grads["b"][k] += d[:, half * k: half * (k + 1)].sum(axis=0)
        return d[:, :half] @ self.p["w"][0].T + d[:, half:] @ self.p["w"][1].T


class Network:
    """The whole network and its vocabulary (hashes of words seen in training)."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        self.scale, self.shift = 1.0, 0.0  # from a text's highest logit to its score
        self.chars = Reader(HIDDEN, HIDDEN, rng)
        self.reader = Reader(3 * HIDDEN, HIDDEN, rng)
        self.free = {"bytes": rng.normal(0, 0.5, (256, HIDDEN)).astype(np.float32),
                     "words": rng.normal(0, 0.1, (len(vocabulary) + 1, HIDDEN)).astype(np.float32),
                     "out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), "bias": np.zeros(1, np.float32)}

    def parameters(self) -> dict[str, np.ndarray]:
        return {**{f"c_{k}": v for k, v in self.chars.p.items()}, **{f"r_{k}": v for k, v in self.reader.p.items()},
                **self.free}

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Row of the word embedding; 0 for unknown words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, chars: np.ndarray, mask: np.ndarray, rows: np.ndarray, keep: bool = False):
        """Inputs (n, 3 HIDDEN) of distinct words."""
        table = self.chars.project(self.free["bytes"])
        pooled, cache = self.chars.forward(table[chars.T], mask.T, keep)
        return np.concatenate((pooled, self.free["words"][rows]), axis=1), cache

    def _projected(self, words: Words, memory: dict | None) -> np.ndarray:
        """Projected inputs of the distinct words. Words that memory holds are
        not read again; it is emptied when it has grown too large."""
        fresh = np.arange(len(words.hash))
        out = np.empty((len(fresh), 6 * HIDDEN), np.float32)
        if memory:
            at = np.minimum(np.searchsorted(memory["hash"], words.hash), len(memory["hash"]) - 1)
            known = memory["hash"][at] == words.hash
            out[known] = memory["rows"][at[known]]
            fresh = np.flatnonzero(~known)
        rows = self.known(words.hash)
        lengths = words.mask.sum(axis=1)
        fresh = fresh[np.argsort(lengths[fresh], kind="stable")]
        for i in range(0, len(fresh), 2048):
            some = fresh[i: i + 2048]
            t = int(lengths[some].max())
            out[some] = self.reader.project(self.inputs(words.bytes[some, :t], words.mask[some, :t], rows[some])[0])
        if memory is not None:
            if not memory or len(memory["hash"]) > _REMEMBERED:
                memory.update(hash=words.hash, rows=out)
            else:
                both = np.concatenate((memory["hash"], words.hash[fresh]))
                order = np.argsort(both, kind="stable")
                memory.update(hash=both[order], rows=np.concatenate((memory["rows"], out[fresh]))[order])
        return out

    def scores(self, words: Words, size: int = 1024, memory: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Text and logit of every window."""
        doc, first, count = words.windows()
        if not len(doc):
            return doc, np.zeros(0, np.float32)
        table = self._projected(words, memory)
        logits = np.empty(len(doc), np.float32)
        order = np.argsort(count, kind="stable")
        for i in range(0, len(order), size):
            some = order[i: i + size]
            step = np.arange(int(count[some].max()))[:, None]
            at = words.at[np.minimum(first[some] + step, len(words.at) - 1)]
            pooled, _ = self.reader.forward(table[at], step < count[some])
            logits[some] = pooled @ self.free["out"] + self.free["bias"]
        return doc, logits

    def learn(self, words: Words, first: np.ndarray, count: np.ndarray, label: np.ndarray, weight: np.ndarray,
              rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of some windows."""
        step = np.arange(int(count.max()))[:, None]
        mask = step < count
        places = words.at[np.minimum(first + step, len(words.at) - 1)]
        distinct, local = np.unique(places, return_inverse=True)
        local = local.reshape(places.shape)
        rows = self.known(words.hash[distinct])
        rows = np.where(rng.random(len(rows)) < 0.3, 0, rows)  # unknown words must be read by their bytes
        x, char_cache = self.inputs(words.bytes[distinct], words.mask[distinct], rows, True)
        projected = self.reader.project(x)
        pooled, cache = self.reader.forward(projected[local], mask, True)
        p = _sigmoid(pooled @ self.free["out"] + self.free["bias"])
        d = ((p - label) * weight / len(label)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.parameters().items()}
        g["out"], g["bias"] = pooled.T @ d, d.sum(keepdims=True)
        reader = {k[2:]: v for k, v in g.items() if k.startswith("r_")}
        d_projected = self.reader.backward(d[:, None] * self.free["out"], cache, reader)
        d_words = np.zeros_like(projected)
        np.add.at(d_words, local.ravel(), d_projected.reshape(-1, projected.shape[1]))
        dx = self.reader.backward_inputs(x, d_words, reader)
        np.add.at(g["words"], rows, dx[:, 2 * HIDDEN:])
        chars = {k[2:]: v for k, v in g.items() if k.startswith("c_")}
        d_table = np.zeros((256, 6 * HIDDEN), np.float32)
        d_chars = self.chars.backward(dx[:, : 2 * HIDDEN], char_cache, chars)
        np.add.at(d_table, words.bytes[distinct].T.ravel(), d_chars.reshape(-1, 6 * HIDDEN))
        g["bytes"] += self.chars.backward_inputs(self.free["bytes"], d_table, chars)
        return g


def train(texts: list[bytes], owner: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
    """A network from windows (texts) of documents (owner, ascending) with
    labels by document. At first a window of each is drawn at random; later ones
    take the highest-scoring window of each and, of clean ones, a random one too."""
    words = Words(texts)
    seen = np.bincount(words.at, minlength=len(words.hash))
    frequent = np.argsort(-seen, kind="stable")[:VOCABULARY]
    net = Network(np.sort(words.hash[frequent[seen[frequent] > 2]]))
    rng = np.random.default_rng(seed)
    base = np.cumsum(words.counts) - words.counts
    filled = np.flatnonzero(words.counts > 0)
    by_doc = np.split(filled, np.searchsorted(owner[filled], np.arange(1, len(labels))))
    usable = [k for k in range(len(labels)) if len(by_doc[k])]
    first, second = ({k: np.zeros_like(v) for k, v in net.parameters().items()} for _ in range(2))
    done, best, next_choice = 0, None, steps // 4
    while done < steps and usable:
        picked = [int(rng.choice(by_doc[k])) for k in usable]
        if done >= next_choice:
            logits = np.full(len(texts), -np.inf, np.float32)
            doc, found = net.scores(words)
            np.maximum.at(logits, doc, found)
            best = [int(by_doc[k][np.argmax(logits[by_doc[k]])]) for k in usable]
            next_choice = done + steps // 6
        if best:
            picked = best + [w for w, k in zip(picked, usable, strict=True) if labels[k] == 0]
        chosen = np.array(picked)
        rng.shuffle(chosen)
        for i in range(0, len(chosen), _BATCH):
            some = chosen[i: i + _BATCH]
            y = labels[owner[some]].astype(np.float32)
            g = net.learn(words, base[some], np.minimum(WINDOW, words.counts[some]), y, np.ones(len(y)), rng)
            done += 1
            rate = 0.01 if done < 0.75 * steps else 0.003
            for k, v in net.parameters().items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                v -= rate * (first[k] / (1 - 0.9 ** done)) / (np.sqrt(second[k] / (1 - 0.999 ** done)) + 1e-8)
            if done >= steps:
                break
    if usable:
        doc, found = net.scores(words)
        highest = np.full(len(labels), -np.inf)
        np.maximum.at(highest, owner[doc], found)
        net.scale, net.shift = calibrate(highest[usable], labels[usable])
    return net


def calibrate(logits: np.ndarray, labels: np.ndarray, weight: float = CLEAN_WEIGHT) -> tuple[float, float]:
    """Scale and shift of a text's highest logit by logistic regression on the
    sample. Clean texts weigh more: there are more of them outside the sample,
    and whole texts have more windows to be wrong in."""
    x = np.stack((logits, np.ones(len(logits))), axis=1)
    w = np.where(labels == 1, 1.0, weight)
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (p - labels)) + 1e-2 * (beta - [1.0, 0.0]) * len(labels)
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2) * len(labels)
        beta = beta - np.linalg.solve(hessian, gradient)
    return float(max(beta[0], 0.1)), float(beta[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_windows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE_DOCS,
                     negatives: int = NEGATIVE_DOCS) -> DataFrame:
    """(doc_id, toxic, windows) of the bounded training sample: windows are cut
    where the texts are, so no long text travels."""
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    picked = [usable.where(F.col("toxic") == k).groupBy("doc_id").agg(F.lit(k).alias("toxic")).orderBy(*order).limit(n)
              for k, n in ((1, positives), (0, negatives))]
    picked = picked[0].union(picked[1])
    rows = docs.where("doc_id IS NOT NULL").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(2)):
                words = text.split()
                starts = range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)  # as Words.windows
                if len(starts) > DOC_WINDOWS:
                    starts = [starts[i] for i in np.linspace(0, len(starts) - 1, DOC_WINDOWS).astype(int)]
                out.append([b" ".join(w[:256] for w in words[s: s + WINDOW]) for s in starts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary()))],
                                             names=["doc_id", "toxic", "windows"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, windows array<binary>")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        **bounds: int) -> Network | None:
    sample = training_windows(rows_of(docs, {"doc_id": doc_id, "text": text}),
                              rows_of(labels, {"doc_id": "doc_id", "toxic": "toxic"}), **bounds)
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["windows"]))
    y = np.array([r["toxic"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    texts = [bytes(w) for r in rows for w in r["windows"]]
    return train(texts, np.repeat(np.arange(len(rows)), [len(r["windows"]) for r in rows]), y)


def score(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    rows = rows_of(docs, {"doc_id": doc_id, "text": text})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            texts = as_bytes(batch.column(1))
            out = np.zeros(len(texts))
            for i, j in blocks(texts, _SCORE_BLOCK) if net is not None else ():
                doc, logits = net.scores(Words(texts[i:j]), memory=memory)
                best = np.full(j - i, -np.inf)
                np.maximum.at(best, doc, logits)
                out[i:j] = np.where(np.isfinite(best), _sigmoid(net.scale * best + net.shift), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    scored = score(docs, fit(docs, labels, doc_id, text, **bounds), doc_id, text)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
