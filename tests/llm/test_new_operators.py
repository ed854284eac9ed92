"""Conversation repair, sharding and token alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veritrail.llm import conversation, interleave, token_align

from .brute import STRIP, sha

# --- conversations -----------------------------------------------------------

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_edits(rows):
    """Least (cost, audit) by a table over all rows and states, from the end."""
    best = {p: (0, "") if p in ("", "a") else None for p in ("", "s", "u", "a")}

    def with_inserts(table):
        for _ in range(3):
            for p in table:
                behind = table[NEXT[p]]
                if behind is not None:
                    way = (behind[0] + 3, "I" + behind[1])
                    table[p] = way if table[p] is None else min(table[p], way)
        return table

    best = with_inserts(best)
    for role, fault in reversed(rows):
        now = {}
        for p in best:
            ways = [(4, "D", p)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                first = role[:1]
                if first == "s" and p == "" or first == "u" and p != "u" or first == "a" and p == "u":
                    ways.append((more, "K", first))
                ways.append((3 + more, "R", NEXT[p]))
            found = [(c + best[q][0], x + best[q][1]) for c, x, q in ways if best[q] is not None]
            now[p] = min(found) if found else None
        best = with_inserts(now)
    return best[""]


def plain_repair(table):
    space = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            fault = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            if fault == 0:
                continue
            if fault == 1:
                text = ""
            if fault == 2:
                text = "".join(x for x in text if x not in ".!?")
            if fault == 4:
                role = "user"
            rows += [(turn, role, text)] * (2 if fault == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marks = set(), []
        for _, role, text in rows:
            body = text.strip(STRIP)
            marks.append("blank" if not body else "duplicate" if (role, text) in seen else
                         "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = plain_edits([(r[1], m) for r, m in zip(rows, marks)])
        fixed, state, at = [], "", 0
        for letter in audit:
            if letter in "IR":
                state = NEXT[state]
                fixed.append(({"u": "user", "a": "assistant"}[state], "" if letter == "I" else rows[at][2]))
            elif letter == "K":
                state = rows[at][1][0]
                fixed.append(rows[at][1:])
            at += letter != "I"
        turns = [r[0] for r in rows if r[0] is not None]
        first = ["-" if not r[1] else r[1][0] for r in rows]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *[marks.count(x) for x in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
                     sha("\n".join(f"{r}:{t}" for r, t in fixed)))
    return out


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def made_up(seed=5, convs=60):
    rng = random.Random(seed)
    words = ["fine.", "open", "", " \t\n", "what?", "ends! ", None, "a.b", "same text."]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, 14)):
            turn = rng.choice([t, t, t, t + 2, None])
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ünder"]),
                         rng.choice(words) if rng.random() < .7 else f"text {rng.random()}."))
    rows += [(None, 1, "user", "hello."), (None, None, "assistant", "x" * 200_000 + "."), (7, 3, "user", "a.")] * 2
    return rows


def got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def test_conversations(spark):
    rows = made_up()
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    assert got(conversation.repair(df)) == plain_repair(rows)
    clashing = df.select("*", *[F.lit(1).alias(n) for n in ("key", "place", "symbol", "block", "fault", "digest", "k")])
    assert got(conversation.repair(clashing)) == plain_repair(rows)
    assert conversation.repair(df.where("false")).count() == 0


def test_long_conversations_in_levels(spark, monkeypatch):
    """One conversation holds most rows; blocks and groups are made small, so that
    several levels are needed and borders fall everywhere."""
    monkeypatch.setattr(conversation, "ROWS", 3)
    monkeypatch.setattr(conversation, "FAN", 2)
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", f"c{t}?", f"d{t}"]))
            for t in range(150)] + made_up(3, 12)
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    assert got(conversation.repair(df)) == plain_repair(rows)


def test_crossings_are_audit_least():
    rng = random.Random(1)
    kinds = {(r, f): chr(97 + 3 * "-sua".index(r) + i) for r in "-sua" for i, f in enumerate((None, "truncated", "blank"))}
    for n in [*range(1, 9), 40, 200]:
        for _ in range(120 if n < 9 else 12):
            rows = [rng.choice(list(kinds)) for _ in range(n)]
            text = "".join(kinds[r] for r in rows)
            end, cost, closing = conversation.closing(conversation.block_summary(text))
            audit = conversation.block_edits(text, conversation.START, end) + closing
            assert (cost, audit) == plain_edits(rows)


def test_repaired_rows(spark):
    rows = made_up(9, 20)
    damaged = conversation.damaged(spark.createDataFrame(rows, CONVERSATIONS))
    result = conversation.repair(spark.createDataFrame(rows, CONVERSATIONS))
    audited = result.select(conversation._key().alias("key"), "audit").where("audit <> ''")
    texts = {}
    for r in sorted(conversation.repaired(damaged, audited).collect(), key=lambda r: r["number"]):
        texts.setdefault(r["key"], []).append(f"{r['role']}:{r['text']}")
    for r in result.collect():
        key = "n" if r["conv_id"] is None else f"v{r['conv_id']}"
        assert sha("\n".join(texts.get(key, []))) == r["repaired_sha256"]


# --- shards --------------------------------------------------------------------


def plain_shards(rows, n):
    """rows: (doc_id, text, source)."""
    def key(r):
        return (hashlib.md5(f"shard-1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0,
                zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[2], []).append(r)
    placed = []
    for source, own in by_source.items():
        own.sort(key=key)
        placed += [((2 * k + 1) / (2 * len(own)), source is not None, source or "", k, r) for k, r in enumerate(own)]
    placed.sort(key=lambda x: x[:4])
    out = []
    for at, (*_, r) in enumerate(placed):
        shard = at * n // len(placed)
        text = (r[1] or "").encode()
        out.append((r[0], len(text) + 8, zlib.crc32(text), shard, at - -(-shard * len(placed) // n)))
    return out


def test_shards(spark, edge_rows, edge_docs, clashing):
    rows = [(r[0], r[1], r[3]) for r in edge_rows]
    for n in (1, 5, 24, 100):
        for df in (edge_docs, clashing):
            shards = interleave.digests(df, n).collect()
            assert sorted([tuple(r)[:3] + (r["shard"], r["slot"]) for r in shards], key=repr) == sorted(
                plain_shards(rows, n), key=repr)
    assert interleave.digests(edge_docs.where("false")).count() == 0


def test_shards_keep_the_mixture(small_docs):
    shards = interleave.assign(small_docs, 8).cache()
    counts = Counter((r["source"], r["shard"]) for r in shards.collect())
    total = Counter(r["source"] for r in shards.collect())
    rows = Counter(r["shard"] for r in shards.collect())
    assert max(rows.values()) - min(rows.values()) <= 1
    for source, n in total.items():
        assert all(abs(counts[source, s] - n / 8) < 2 for s in range(8))
    slots = {}
    for r in shards.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    shards.unpersist()


def test_written_shards(spark, clashing, tmp_path):
    folder = f"file://{tmp_path}/shards"
    sums = {r["shard"]: (r["n_rows"], r["n_bytes"]) for r in interleave.write_shards(clashing, folder, 4).collect()}
    back = spark.read.parquet(folder)
    assert sorted(back.columns) == sorted([*clashing.columns, "shard_no"])
    assert {r["shard_no"]: r["count"] for r in back.groupBy("shard_no").count().collect()} == {
        s: n for s, (n, _) in sums.items()}
    assert not back.drop("shard_no").exceptAll(clashing.select(*back.drop("shard_no").columns)).count()


# --- alignment -----------------------------------------------------------------


def plain_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in chars} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in chars)}
    every, links = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
        whole = b" " + text.encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = ([sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 500 else None
                          for x in (bytes_a, bytes_b))
        if ends_a is None or ends_b is None:
            import itertools
            ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        common = sorted(set(ends_a) & set(ends_b))
        groups, i, j, own = [], 0, 0, Counter()
        for end in common:
            ga, gb = [], []
            while i < len(ends_a) and ends_a[i] <= end:
                ga.append(ids_a[i])
                i += 1
            while j < len(ends_b) and ends_b[j] <= end:
                gb.append(ids_b[j])
                j += 1
            own[ga[-1], gb[-1]] += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        links += own
        every.append((doc_id, len(ids_a), len(ids_b), len(groups), own, sha(";".join(groups)) if groups else ""))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, na, nb, g, sum(own.values()), sum(n for (x, y), n in own.items() if links[x, y] == best[y]),
             sum(n * links[p] for p, n in own.items()), digest) for d, na, nb, g, own, digest in every]


ODD = ["a  b", " a", "a▁b", "<s> x </s>", "A<|endoftext|>b <|endoftext|>", "<unk><0x41>", "x\ty\nz", "日本語 テスト", "ﬁ ½ é", "\x00a",
       "don't  stop", " ", "\n", "😀 emoji", "word" * 400]


@pytest.mark.skipif(not Path("/opt/tokenizers").exists(), reason="public tokenizers not present")
def test_alignment(spark, all_docs, clashing):
    odd = spark.createDataFrame([(9000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    docs = all_docs.select("doc_id", "text").union(odd).repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    result = [tuple(r) for r in token_align.linked(docs).collect()]
    assert sorted(result, key=repr) == sorted(plain_alignment(rows), key=repr)
    assert sum(r[1] == 0 for r in result) > 3
    assert token_align.linked(docs.where("false")).count() == 0
    assert token_align.linked(clashing).count() == clashing.count()


def test_common_ends():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 80)
        a, b = (sorted(rng.sample(range(1, n + 40), rng.randint(1, n))) for _ in range(2))
        if rng.random() < .5:
            b = sorted({*b, *a[len(a) // 3:]})
        a, b = sorted({*a, 200}), sorted({*b, 200})
        at_a, at_b = token_align.common_ends(a, b)
        assert [a[i] for i in at_a] == [b[j] for j in at_b] == sorted(set(a) & set(b))
