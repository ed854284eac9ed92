import random

from pyspark.sql import functions as F

from veritrail.functions import claims as C
from veritrail.functions import cite, ids
from veritrail.functions import scores as S
from veritrail.functions import text as X

UTAUT = ("The unified theory of acceptance and use of technology (UTAUT2) was proposed by Venkatesh and "
         "colleagues, which extends the original technology acceptance model.")
L = F.lit


def test_keywords_order_and_ties(value):
    assert value(F.array_join(X.keywords(L(UTAUT), 6), " ")) == "acceptance technology unified theory use proposed"
    assert value(X.keywords(L("foo- foo -bar a-b x2y ünder z"), 5)) == ["foo", "bar", "a-b"]
    assert value(X.keywords(L(None).cast("string"), 5)) == []


def test_similarity_is_indel_ratio(value):
    assert abs(value(X.title_similarity(L("abcdef"), L("azced"))) - 6 / 11) < 1e-12
    assert abs(value(X.title_similarity(L("kitten"), L("sitting"))) - 8 / 13) < 1e-12
    assert value(X.title_similarity(L("Attention is all you need."), L("attention IS all, you need"))) == 1.0
    assert value(X.title_similarity(L(""), L("x"))) == 0.0


def test_lcs_against_table():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]
    rng = random.Random(7)
    for _ in range(300):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 90)))
        b = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 90)))
        assert X.lcs_length(a, b) == table(a, b)


def test_sentence_spans(value):
    text = 'Up 3.5%. "Yes." 好的。然后 tail  '
    spans = value(X.sentence_spans(L(text)))
    assert [s["text"] for s in spans] == ["Up 3.", "5%.", '"Yes."', "好的。", "然后 tail"]
    for s in spans:
        assert text[s["start"]:s["end"]].strip() == s["text"]


def test_sentences_merge_fragments(value):
    assert value(X.sentences(L("One two three. Four. Five six seven! 你好世界。"))) == [
        "One two three. Four.", "Five six seven! 你好世界。"]


def test_names(value):
    assert value(X.author_initials_first(L("John Quincy Smith"))) == "J. Q. Smith"
    assert value(X.author_last_initials(L("Smith, Jean-Luc"))) == "Smith, J. L."
    assert value(X.author_last_initials(L("Plato"))) == "Plato"
    assert value(X.family_given(L("Ann B. Lee"))) == "Lee, Ann B."


def test_ids(value):
    none, no = L(None).cast("string"), F.array().cast("array<string>")
    pid = lambda doi: value(ids.paper_id(L(doi), none, L(None).cast("int"), no))
    assert pid("10.48550/arXiv.1706.03762") == "5ce41086a48328a9"
    assert pid("https://doi.org/10.2307/41410412") == "0bb8eaa170513d0e"
    assert pid("doi:10.1000/X") == pid("10.1000/x.") == "d5d3bb5e750108a2"
    assert value(ids.claim_id(L(7)), ids.claim_id(L(1234))) == ("C007", "C1234")
    assert value(ids.bibtex_key(L("The attention of all"), L(2017), F.array(L("Vaswani, Ashish")))) == "Vaswani_2017_attention"


def test_claim_types_and_needs(value):
    kind, need = lambda t: value(C.claim_type(L(t))), lambda t: value(C.citation_need(L(t)))
    assert kind("增长了23 %左右的水平") == "STATISTICAL"
    assert kind("信任是一种信念") == "DEFINITION"
    assert kind("本算法很快") == "METHOD"
    assert kind("框架理论很好用") == "EMPIRICAL"
    assert kind("stamina matters") == "DEFINITION"
    assert kind(UTAUT) == "DEFINITION" and need(UTAUT) == "RECOMMENDED"
    assert need("In this paper we propose X.") == "NOT_NEEDED"
    assert need("It cost $X in total.") == "REQUIRED"
    assert need("Smoking causes cancer.") == "REQUIRED"
    assert need("as shown in (2020A) it holds") == "REQUIRED"


def test_compound_split(value):
    s = "Students use many tools every single day but teachers still prefer the classic printed books"
    assert value(C.split_compound(L(s))) == [
        "Students use many tools every single day", "teachers still prefer the classic printed books"]
    assert value(C.split_compound(L("A b c and d e f"))) == ["A b c and d e f"]


def test_noise(value):
    assert value(*[C.is_noise(L(t)) for t in ("too short here", "We show that this works well.", "短句子", "这是一个足够长的句子。", "A proper sentence stands here.")]) == (
        True, True, True, False, False)


def test_concepts_and_queries(value):
    cs = value(C.concepts_and_synonyms(L(UTAUT), L(UTAUT)))
    assert cs["concepts"] == ["acceptance", "technology", "unified", "theory", "use", "proposed", "adoption", "usage intention"]
    assert cs["synonyms"] == ["adoption", "usage intention", "behavioral intention", "technology adoption",
                              "technology use", "adoption", "usage intention", "behavioral intention"]
    array = lambda v: F.array(*[L(x) for x in v])
    made = value(C.search_queries(L(UTAUT), array(cs["concepts"]), array(cs["synonyms"]), L(""), L(""), L("DEFINITION")))
    assert [q["type"] for q in made] == ["precise", "broad", "synonym", "domain", "foundational"]
    assert made[2]["query"] == UTAUT.replace("acceptance", "usage intention", 1)
    assert made[3]["query"] == "acceptance technology unified adoption"
    zh = value(C.concepts_and_synonyms(L("生成式人工智能影响学生学习"), L("生成式人工智能影响学生学习")))
    assert zh["concepts"] == ["generative artificial intelligence", "artificial intelligence", "students", "learning", "impact"]


def test_py_round_matches_python(spark):
    rng = random.Random(3)
    xs = [0.125, 2.675, 0.285, 0.375, 0.005, 1.005, 0.615, 0.29, 0.5] + [rng.random() for _ in range(2000)] + [
        i / 40 * 0.75 + j / 8 * 0.25 for i in range(41) for j in range(9)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.select("x", S.py_round(F.col("x"), 2).alias("a"), S.py_round(F.col("x"), 4).alias("b")).collect():
        assert (row.a, row.b) == (round(row.x, 2), round(row.x, 4))


def test_bands_and_caps(value):
    levels = value(*[S.support_level(L(x)) for x in (.95, .80, .65, .45, .10)])
    assert levels == ("DIRECT", "DIRECT", "PARTIAL", "BACKGROUND", "INSUFFICIENT_EVIDENCE")
    assert value(S.cap_metadata_only(L(0.9), L("x")), S.cap_metadata_only(L(0.9), L("It was published in 2020"))) == (0.74, 0.9)
    assert value(S.contradicts(L("X improves Y"), L("it does not improve Y"))) is True
    assert value(*[S.recency(L(y), 2026) for y in (2030, 2024, 2021, 2016, 2006, 1990, 0)]) == (1.0, 1.0, .8, .5, .3, .1, .1)
    assert value(*[S.years_close(L(a), L(b)) for a, b in ((2015, 2016), (2015, 2020), (0, 1900))]) == (True, False, True)


def test_citation_styles(spark):
    df = spark.createDataFrame([("Attention is all you need.", ["Vaswani, Ashish", "Noam Shazeer", "Niki Parmar"], 2017, "NeurIPS Proceedings", "10.1/A")],
                               "title string, authors array<string>, year int, venue string, doi string")
    p = cite.PaperColumns()
    got = df.select(*[cite.citation_entry(p, s, L(3)).alias(s) for s in ("ieee", "apa", "nature", "vancouver", "gbt7714")],
                    cite.apa_in_text(p).alias("m"), cite.apa_in_text(p, L("a"), True).alias("n")).first()
    assert got.ieee == '[3] A. Vaswani, N. Shazeer, and N. Parmar, "Attention is all you need," in *NeurIPS Proceedings*, 2017, doi: 10.1/a.'
    assert got.apa == "Vaswani, A., Shazeer, N., & Parmar, N. (2017). Attention is all you need. *NeurIPS Proceedings*. https://doi.org/10.1/a"
    assert got.vancouver == "3. Vaswani A, Shazeer N, Parmar N. Attention is all you need. NeurIPS Proceedings. 2017."
    assert (got.m, got.n) == ("(Vaswani et al., 2017)", "Vaswani et al. (2017a)")


def test_many_authors_and_combined_markers(value):
    names = F.transform(F.sequence(L(1), L(21)), lambda i: F.concat(L("Ann N"), i.cast("string")))
    assert value(cite.apa_authors(names)).endswith("N19, A., ... N21, A.")
    assert value(cite.ieee_authors(names)) == "A. N1, et al."
    assert value(cite.gbt_authors(F.array(L("张三"), L("Li, Si"), L("A B"), L("C D")))) == "张三, Li S, B A, 等"
    assert value(cite.apa_combine(F.array(L("(A, 2020)"), L("(B, 2021)")))) == "(A, 2020; B, 2021)"
