"""Text columns. Everything here is a built-in expression except the title
similarity, which is an Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that never count as keywords.
STOPWORDS = (
    "a an the and or but is are was were be been being have has had do does did "
    "will would could should may might can shall must of in on at to for with from "
    "by as into during including until against among throughout despite towards "
    "upon concerning regarding considering than such this that these those which "
    "who whom whose what when where why how all any both each few more most other "
    "some no nor not only own same so too very i me my we us our you your he him "
    "his she her it its they them their however therefore thus while although also "
    "propose method approach paper present results show study research using based "
    "via through over under between presented conducted"
).split()

# Whitespace and word characters as the source data defines them: the four
# ASCII separators count as space, combining marks do not count as letters.
SPACE = r"[\s\x1c-\x1f]"
#: The characters of SPACE under (?U), for trimming without a pattern.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
          + "\u2028\u2029\u202f\u205f\u3000")
NON_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f]"
KEYWORD = r"(?U)\b[A-Za-z][A-Za-z\-]{2,}\b"
CJK = "[一-鿿]"
ENDERS = ".!?。！？；"
CLOSERS = "\"')】」』”"
SENTENCE = f"[^{ENDERS}]*[{ENDERS}][{CLOSERS}]*|[^{ENDERS}]+\\z"
SENTENCE_BOUNDARY = rf"(?U)(?<=[.!?。！？]){SPACE}+(?=[^\s\x1c-\x1f])|(?<=[。！？])(?=[^\s\x1c-\x1f])"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def text_or_null(col: Column) -> Column:
    """Empty text as null; the value is computed once."""
    return bind(col, lambda v: F.when(v != "", v))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def rstrip(col: Column, chars: str) -> Column:
    return F.regexp_replace(col, rf"[{chars}]+\z", "")


def words(col: Column) -> Column:
    """Whitespace tokens. Extraction keeps its compiled pattern from row to
    row, which `split` does not."""
    return F.regexp_extract_all(col, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def word_count(col: Column) -> Column:
    return F.size(words(col))


def normalize_title(col: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text_or_empty(col)), f"(?U){NON_WORD}", " ")
    return strip(F.regexp_replace(spaced, f"(?U){SPACE}+", " "))


def is_chinese(col: Column) -> Column:
    return text_or_empty(col).rlike(CJK)


def keyword_tokens(text: Column) -> Column:
    """All keyword occurrences in text order."""
    found = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(KEYWORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS))


def keywords(text: Column, top_n: int = 10) -> Column:
    """Most frequent keywords; ties keep the order of first appearance.

    One sort of (word, position) per row, then run lengths: linear memory and
    no shuffle, whatever the length of the text. `sort_array` compares natively
    (`array_sort` evaluates an expression for every comparison), and a run is
    ranked by one number: its negative length, then its first position.
    """
    base = F.lit(1 << 32)

    def ranked(placed: Column) -> Column:
        starts = F.filter(
            F.transform(placed, lambda t, i: F.when((i == 0) | (t["w"] != F.get(placed, i - 1)["w"]), i)),
            lambda i: i.isNotNull())
        return bind(starts, lambda s: F.transform(
            s, lambda at, k: (at - F.coalesce(F.get(s, k + 1), F.size(placed))).cast("bigint") * base
            + F.get(placed, at)["i"]))

    def top(tokens: Column) -> Column:
        placed = F.sort_array(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.transform(F.slice(F.sort_array(bind(placed, ranked)), 1, top_n),
                           lambda r: F.get(tokens, F.pmod(r, base).cast("int")))

    return bind(keyword_tokens(text), top)


def coverage(claim_keywords: Column, other_keywords: Column) -> Column:
    """Share of the first keyword set found in the second; 0 if either is empty."""
    hit = F.size(F.array_intersect(claim_keywords, other_keywords))
    return F.when(
        (F.size(claim_keywords) > 0) & (F.size(other_keywords) > 0),
        hit / F.size(claim_keywords),
    ).otherwise(F.lit(0.0))


def keyword_overlap(a: Column, b: Column) -> Column:
    return bind(keywords(a, 50), lambda ka: bind(keywords(b, 50), lambda kb: coverage(ka, kb)))


def sentences(text: Column) -> Column:
    """Sentences by end mark and following space; a fragment of fewer than
    three words joins the sentence before it."""
    raw = F.filter(
        F.transform(F.split(strip(text_or_empty(text)), SENTENCE_BOUNDARY), strip),
        lambda s: s != "")

    def fold(done: Column, frag: Column) -> Column:
        joined = F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.concat_ws(" ", F.element_at(done, -1), frag)))
        return F.when((F.size(done) > 0) & (word_count(frag) < 3), joined).otherwise(
            F.concat(done, F.array(frag)))

    return F.aggregate(raw, F.array().cast("array<string>"), fold)


def running_sums(numbers: Column) -> Column:
    """Sums up to every element of an array of integers: the array is added to
    itself moved by 1, 2, 4, ... places, so that no array grows element by
    element however long it is. Only moves within the array are made."""
    needed = F.length(F.bin(F.greatest(F.size(numbers) - 1, F.lit(0))))
    moves = F.slice(F.array(*[F.lit(1 << i) for i in range(31)]), F.lit(1), needed)

    def step(sums: Column, move: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0), move), F.slice(sums, 1, F.size(sums) - move))
        return F.when(move < F.size(sums), F.zip_with(sums, moved, lambda x, y: x + y)).otherwise(sums)

    return F.aggregate(moves, numbers, step)


def paragraphs(text: Column) -> Column:
    """Array of {id, start, text} of the lines that are not blank; `start` is the
    line's character offset."""
    def placed(lines: Column) -> Column:
        ends = running_sums(F.transform(lines, lambda p: F.length(p) + 1))
        return bind(ends, lambda e: F.transform(lines, lambda p, i: F.struct(
            i.alias("id"), (F.get(e, i) - F.length(p) - 1).alias("start"), p.alias("text"))))

    return F.filter(bind(F.split(text_or_empty(text), "\n"), placed), lambda p: strip(p["text"]) != "")


def sentence_spans(text: Column) -> Column:
    """Array of {start, end, text}: every end mark closes a sentence together
    with the quotes and brackets behind it; `end` is exclusive."""
    def placed(pieces: Column) -> Column:
        ends = running_sums(F.transform(pieces, lambda p: F.length(p)))
        return F.zip_with(pieces, ends, lambda piece, end: F.struct(
            (end - F.length(F.ltrim(piece, F.lit(SPACES)))).alias("start"), end.alias("end"),
            strip(piece).alias("text")))

    pieces = F.regexp_extract_all(text_or_empty(text), F.lit(SENTENCE), F.lit(0))
    return F.filter(bind(pieces, placed), lambda s: s["text"] != "")


def unnest(df: DataFrame, array: Column | str, *keep: Column | str, value: str,
           position: str | None = None) -> DataFrame:
    """A row per array element. Written as an outer explode with a filter behind
    it: the plain one makes the optimizer test the array's size at the scan,
    which computes an expensive array a second time."""
    rows = F.posexplode_outer(array).alias(position, value) if position else F.explode_outer(array).alias(value)
    return df.select(*keep, rows).where(F.col(value).isNotNull())


# --- names -----------------------------------------------------------------

def author_name(author: Column) -> Column:
    """Display name of a {name, given, family} struct."""
    parts = strip(F.concat_ws(" ", text_or_empty(author["given"]), text_or_empty(author["family"])))
    return F.when(text_or_empty(author["name"]) != "", strip(author["name"])).otherwise(parts)


def last_name(name: Column) -> Column:
    """Text before the comma, else the last token."""
    return F.when(F.instr(name, ",") > 0, strip(F.substring_index(name, ",", 1))).otherwise(
        text_or_empty(F.try_element_at(words(name), F.lit(-1))))


def first_author(authors: Column) -> Column:
    return text_or_empty(F.get(authors, 0))


def first_author_last_name(authors: Column) -> Column:
    return last_name(first_author(authors))


def match_last_name(authors: Column) -> Column:
    """Last name used for duplicate matching: lower case, no edge punctuation."""
    name = first_author(authors)
    plain = F.regexp_replace(
        F.lower(text_or_empty(F.try_element_at(words(name), F.lit(-1)))), r"^[,.]+|[,.]+\z", "")
    return F.when(F.instr(name, ",") > 0, F.lower(strip(F.substring_index(name, ",", 1)))).otherwise(plain)


def family_given(name: Column) -> Column:
    """'Given Family' becomes 'Family, Given'; comma names and single names stay."""
    parts = words(name)
    flipped = F.concat(
        F.element_at(parts, -1), F.lit(", "),
        F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    return F.when((F.instr(name, ",") == 0) & (F.size(parts) >= 2), flipped).otherwise(name)


def last_token_first(name: Column) -> Column:
    """Last word, comma, the rest; also for names that already hold a comma."""
    parts = words(name)
    return F.when(F.size(parts) >= 2, F.concat(
        F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "))).otherwise(name)


def initials(given: Column) -> Column:
    parts = F.regexp_extract_all(given, F.lit(r"(?U)[^\s\x1c-\x1f\-]+"), F.lit(0))
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " ")


def _name_parts(name: Column) -> Column:
    """{last, given, single}: the pieces both author renderings need."""
    def split_name(n: Column) -> Column:
        tokens = words(n)
        comma = F.instr(n, ",") > 0
        return F.struct(
            F.when(comma, strip(F.substring_index(n, ",", 1)))
            .otherwise(text_or_empty(F.try_element_at(tokens, F.lit(-1)))).alias("last"),
            F.when(comma, strip(F.regexp_replace(n, "^[^,]*,", "")))
            .otherwise(F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), " "))
            .alias("given"),
            (~comma & (F.size(tokens) < 2)).alias("single"),
            n.alias("name"))
    return bind(strip(name), split_name)


def author_initials_first(name: Column) -> Column:
    return bind(_name_parts(name), lambda p: F.when(p["single"], p["name"]).otherwise(
        F.concat(initials(p["given"]), F.lit(" "), p["last"])))


def author_last_initials(name: Column) -> Column:
    return bind(_name_parts(name), lambda p: F.when(p["single"], p["name"]).otherwise(
        F.concat(p["last"], F.lit(", "), initials(p["given"]))))


# --- similarity ------------------------------------------------------------

def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence with one machine-word-style bit row."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    total = len(a) + len(b)
    return 1.0 - (total - 2 * lcs_length(a, b)) / total


@F.pandas_udf(DoubleType())
def _indel_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([indel_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


_POPULAR_FROM = 200  # length from which frequent characters are no anchors


def _anchors(b: str) -> list:
    """b with what cannot anchor a block replaced by something equal to nothing:
    in long texts, characters that make up more than one in a hundred."""
    if len(b) < _POPULAR_FROM:
        return list(b)
    often = {ch for ch in set(b) if b.count(ch) > len(b) // 100 + 1}
    return [None if ch in often else ch for ch in b]


def _automaton(part: list) -> tuple[list[dict], list[int], list[int], list[int]]:
    """Suffix automaton of the runs between None: transitions, links, lengths and
    first end of each state."""
    steps, link, length, first = [{}], [-1], [0], [-1]

    def added(size: int, end: int, transitions: dict, suffix: int) -> int:
        steps.append(transitions)
        length.append(size)
        first.append(end)
        link.append(suffix)
        return len(steps) - 1

    def split(p: int, q: int, ch: str) -> int:
        """The state of the part of q that p leads to."""
        clone = added(length[p] + 1, first[q], dict(steps[q]), link[q])
        while p != -1 and steps[p].get(ch) == q:
            steps[p][ch] = clone
            p = link[p]
        link[q] = clone
        return clone

    last = 0
    for at, ch in enumerate(part):
        if ch is None:
            last = 0
            continue
        p = last
        if ch in steps[p]:  # only at the start of a run that was seen before
            q = steps[p][ch]
            last = q if length[q] == length[p] + 1 else split(p, q, ch)
            continue
        last = added(length[p] + 1, at, {}, 0)
        while p != -1 and ch not in steps[p]:
            steps[p][ch] = last
            p = link[p]
        if p != -1:
            q = steps[p][ch]
            link[last] = q if length[q] == length[p] + 1 else split(p, q, ch)
    return steps, link, length, first


def _longest_block(a: str, part: list) -> tuple[int, int, int]:
    """(start in a, start in part, length) of the longest common run; of equal
    ones the first in a, then the first in part."""
    steps, link, length, first = _automaton(part)
    state = size = 0
    best = (0, 0, 0)
    for i, ch in enumerate(a):
        while state and ch not in steps[state]:
            state = link[state]
            size = length[state]
        if ch in steps[state]:
            state = steps[state][ch]
            size += 1
        if size > best[2]:
            best = (i - size + 1, first[state] - size + 1, size)
    return best


def block_ratio(a: str | None, b: str | None) -> float:
    """Twice the characters in matching blocks over both lengths: the longest
    common block, then the same on both sides of it."""
    if not a or not b:
        return 0.0
    anchors, same, todo = _anchors(b), 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j, n = _longest_block(a[a0:a1], anchors[b0:b1])
        i, j = i + a0, j + b0
        if not n:
            i, j = a0, b0
        # Characters that are no anchors may still lengthen a block.
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
            n += 1
        if n:
            same += n
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return 2.0 * same / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _block_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([block_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def normalized_similarity(a: Column, b: Column) -> Column:
    """Similarity of two titles that are already normalised."""
    return _indel_ratio(a, b)


def title_similarity(a: Column, b: Column, method: str = "indel") -> Column:
    """Similarity of normalised titles, 0 when either is empty: 1 - insertions and
    deletions over the summed lengths ("indel"), or the share of characters in
    matching blocks ("blocks")."""
    ratio = {"indel": _indel_ratio, "blocks": _block_ratio}[method]
    return ratio(normalize_title(a), normalize_title(b))
