"""Plain versions of the operators over lists of rows, straight from their
definitions."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if wins[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": n < 20 or 100 * len(hit) > 30 * n}


def line_dedup(rows):
    def key(line):
        k = lower(line.strip(STRIP))
        return k if len(k) >= 10 else None
    owners = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if key(line) is not None:
                    owners[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) is None or min(owners[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ngram(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    real = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    order = {k: (rows[k][0], k) for k in real}
    links = []
    for x in range(len(real)):
        for y in range(x):
            a, b = sets[real[x]], sets[real[y]]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and \
                    100 * len(a & b) >= percent * len(a | b):
                links.append((order[real[x]], order[real[y]]))
    found = components(order.values(), links)
    return [(i, len(sets[k]), found[order[k]][0] if k in order else i) for k, (i, _) in enumerate(rows)]


ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
                    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    found.sort()
    names = ("assign", "access", "hex")
    return [sum(k == j for _, k, _ in found) for j in range(3)], \
        ",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)


def spans50(rows):
    owner = {}
    docs = [(i, (t or "").encode()) for i, t in rows]
    for i, b in docs:
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p:p + 50]
                owner[s] = min(owner.get(s, i), i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        if i is not None:
            end = 0
            for p in range(len(b) - 49):
                if owner[b[p:p + 50]] < i:
                    a = max(p, end)
                    end = p + 50
                    gone[a:end] = b"\1" * (end - a)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), n, sha(kept)))
    return out
