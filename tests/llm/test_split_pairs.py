import random

import pytest

from metrikon.llm import pairs, split
from metrikon.llm.split import SplitConfig

SMALL = SplitConfig(max_words=30, overlap=4, min_words=8, window=3, mean_gap=6)


def sample_text(n, seed, stops=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(50)))
        if stops and r.random() < 0.12:
            out[-1] += "."
        if stops and r.random() < 0.04:
            out[-1] += "\n\n"
    return " ".join(out)


@pytest.mark.parametrize("n, stops", [(31, True), (200, True), (500, False), (1000, True)])
def test_pieces_cover_the_text(n, stops):
    text = sample_text(n, n, stops)
    words = text.split()
    got = split.pieces(text, SMALL)
    assert len(got) > 1
    rebuilt = []
    for i, (index, piece, size, overlap, kind) in enumerate(got):
        w = piece.split()
        assert index == i + 1 and len(w) == size <= 30 and kind in (*split.KINDS, "end")
        assert overlap == (0 if i == 0 else min(4, len(rebuilt)))
        assert w[:overlap] == (rebuilt[-overlap:] if overlap else [])
        rebuilt += w[overlap:]
    assert rebuilt == words
    assert got[-1][4] == "end" and (not stops or any(x[4] in ("sentence", "paragraph") for x in got))


def test_edits_stay_local():
    text = sample_text(3000, 5)
    words = text.split(" ")
    words[1500:1500] = ["inserted"] * 3
    new_content = lambda t: {tuple(p.split()[o:]) for _, p, _, o, _ in split.pieces(t, SMALL)}
    before, after = new_content(text), new_content(" ".join(words))
    assert len(before - after) <= 12 < len(before) / 4


def test_headings_and_white_space():
    body = "word " * 12
    text = body.strip() + "\n## Head\n" + body * 3
    assert any(p[4] == "heading" for p in split.pieces(text, SMALL))
    wide = "　".join(["w"] * 31)
    assert len(split.pieces(wide, SMALL)) > 1 and len(split.pieces(" ".join(["w"] * 31), SMALL)) > 1
    assert len(split.pieces("​".join(["w"] * 100), SMALL)) == 1
    assert split.pieces(None, SMALL) == split.pieces("", SMALL) == split.pieces("  \n", SMALL) == []


def test_minimum_is_kept():
    words = lambda n: " ".join(["w"] * n)
    text = "one two three four five. " + words(300) + "\n" + words(500)
    assert [(size, overlap, kind) for _, _, size, overlap, kind in split.pieces(text, SplitConfig())] == [(305, 0, "line"), (560, 60, "end")]
    tail = " ".join(words(39) + " w." for _ in range(18))  # 720 words in sentences of 40
    assert [size - overlap for _, _, size, overlap, _ in split.pieces(tail, SplitConfig())][-1] >= 240
    assert [kind for *_, kind in split.pieces("one two. " + words(900), SplitConfig())][0] == "sentence"


def test_split_config():
    for bad in ({"overlap": 700}, {"min_words": 0}, {"min_words": 660}, {"window": 0}):
        with pytest.raises(ValueError):
            SplitConfig(**bad)


def test_split_table(spark):
    long = sample_text(100, 1)
    rows = [("a", long, "x"), ("a", long, "y"), ("b", "short", "x"), ("c", None, "x"), ("d", " ", "x"), (None, sample_text(40, 2), "x"), ("e", " ".join(["w"] * 30), "x"), ("f", " ".join(["w"] * 31), "x")]
    df = spark.createDataFrame(rows, "id string, body string, piece_index string")
    got = split.split_oversized(df, "t", "id", "body", SMALL)
    assert {(r["record_table"], r["record_id"]) for r in got.collect()} == {("t", "a"), ("t", None), ("t", "f")}
    a = got.where("record_id = 'a'")
    assert a.count() == len(split.pieces(long, SMALL))
    assert split.split_oversized(df.where("false"), "t", "id", "body", SMALL).count() == 0


CONTEXT = "The old mill keeps grain for 40 days after the harvest, as set in ABC-1234. The second mill does not open unless the northern crew signs it."
Q = "How long does the old mill keep grain after the harvest under ABC-1234?"
CASES = [
    ("direct_fact", Q, "for 40 days", CONTEXT, None),
    ("direct_fact", Q, "The old mill keeps grain for 40 days after the harvest, as set in ABC-1234", CONTEXT, None),
    ("direct_fact", Q, None, CONTEXT, "empty"),
    ("Direct-Fact", Q, " ​. ", CONTEXT, "empty"),
    ("direct_fact", Q, "(n/a)", CONTEXT, "empty"),
    (" Out of-Context ", Q, None, None, None),
    ("out_of_context", Q, "", "", None),
    ("direct_fact", Q, "The old mill keeps grain for", CONTEXT, "truncated"),
    ("direct_fact", Q, "The old mill keeps grain for 40 days after the har", CONTEXT, "truncated"),
    ("direct_fact", Q, "The old mill keeps grain...", CONTEXT, "truncated"),
    ("direct_fact", Q, "for 40 days after the", CONTEXT, "truncated"),
    ("direct_fact", Q, "for 40 days (after", CONTEXT, "truncated"),
    ("direct_fact", Q, "unless the northern crew signs it", CONTEXT, None),
    ("direct_fact", Q, "I'm sorry, but I cannot answer this question.", CONTEXT, "refusal"),
    ("direct_fact", Q, "Lo siento, no puedo responder a esta pregunta.", CONTEXT, "refusal"),
    ("direct_fact", Q, Q.upper(), CONTEXT, "copy"),
    ("direct_fact", Q, "Q: " + Q, None, "copy"),
    ("direct_fact", Q, "Die alte Mühle behält das Korn nach der Ernte für 40 Tage, festgelegt in ABC-1234.", CONTEXT, "other_language"),
    ("direct_fact", Q, "Старая мельница хранит зерно 40 дней после сбора, как указано в ABC-1234.", CONTEXT, "other_language"),
    ("direct_fact", Q, "The old mill keeps grain for 40 days after", None, "truncated"),
    ("direct_fact", Q, "The old mill keeps grain for 40 days after the harvest, as set in ABC-1234", None, None),
    ("direct_fact", Q, "40 days", None, None),
    (None, Q, '"Sorry, I cannot open record 5"', 'It shows "Sorry, I cannot open record 5" then.', None),
    (None, None, "40 days", None, None),
    (None, None, None, None, "empty"),
]


@pytest.mark.parametrize("limit", [0, 100_000])
def test_defects(spark, limit):
    rows = [(f"q{i}", q, c, a, x, "clash") for i, (c, q, a, x, _) in enumerate(CASES)] + [("q2", Q, "direct_fact", None, CONTEXT, "clash")]
    df = spark.createDataFrame(rows, "query_id string, query_text string, category string, expected_answer string, expected_context string, evidence string")
    got = {r["query_id"]: r["defect"] for r in pairs.defective_pairs(df, broadcast_rows=limit, salts=3).collect()}
    assert got == {f"q{i}": w for i, (*_, w) in enumerate(CASES) if w}
    assert pairs.defective_pairs(df.where("false")).count() == 0


def test_neighbours_decide_beside_a_context(spark):
    short, long = "The new barn keeps the hay dry", "The new barn keeps the hay dry for two winters."
    cases = [(long, None, False), (short, "Nothing on barns here.", True), (short, None, True), (short, f"{short}. So it does.", False), (short, long, True), (None, None, False)]
    rows = [(f"q{i}", "What does the new barn keep?", "out_of_context" if a is None else "direct_fact", a, c) for i, (a, c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "query_id string, query_text string, category string, expected_answer string, expected_context string")
    got = {r["query_id"]: r["defect"] for r in pairs.defective_pairs(df).collect()}
    assert got == {f"q{i}": "truncated" for i, (*_, cut) in enumerate(cases) if cut}


def test_sentences_of_other_contexts_show_cut_answers(spark):
    """No context of its own: the sentence it breaks off from stands in the context of another row."""
    rows = [("q0", "How long?", "direct_fact", "The old mill keeps grain for 40", None), ("q1", "Who signs?", "direct_fact", "the northern crew", CONTEXT), ("q2", "Whole?", "direct_fact", CONTEXT.split(". ")[0], None)]
    df = spark.createDataFrame(rows, "query_id string, query_text string, category string, expected_answer string, expected_context string")
    assert [(r["query_id"], r["evidence"]) for r in pairs.defective_pairs(df).collect()] == [("q0", "a longer text begins with it")]


def test_open_marks():
    assert pairs.is_open('it shows "no "record') and pairs.is_open('it shows "no') and pairs.is_open("a (b")
    assert not pairs.is_open('it shows "no record" then') and not pairs.is_open("a (b)") and not pairs.is_open('5" pipes and 6" pipes')


def test_neighbours(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(300)] + [None, "ab", "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    have = {t for t in texts if t}
    assert {x["t"] for x in pairs.shortened_texts(df).collect()} == {a for a in have if any(b != a and b.startswith(a) for b in have)}


def test_short_answers_are_compared(spark):
    cases = [("The old mil", True), ("The old mill keeps grain.", False), ("North", False), ("Northern lights are seen.", False), ("New York", False), ("New York is large.", False), ("The mill.", False), ("The mill stands.", False), ("36 points", False), ("36 points are given.", False), (" ", None)]
    df = spark.createDataFrame([(f"q{i}", "What is it?", "direct_fact", a, None) for i, (a, _) in enumerate(cases)], "query_id string, query_text string, category string, expected_answer string, expected_context string")
    got = {r["query_id"]: r["defect"] for r in pairs.defective_pairs(df).collect()}
    assert got == {"q0": "truncated", "q10": "empty"}


def test_limits_of_any_length(spark):
    lengths = [(n,) for n in range(249_990, 250_010) for _ in range(2)] + [(250_000,)] * 70 + [(5,)] * 30 + [(6,)] * 30 + [(1,)] * 19 + [(None,)] * 90
    assert pairs.length_limits(spark.createDataFrame(lengths, "n int")) == [250_000]
    r = random.Random(8)
    many = [r.randrange(1, 90) for _ in range(900)] + [r.randrange(1, 90)] * 150 + [7] * 140 + [300] * 20
    counts = {n: many.count(n) for n in set(many)}
    want = sorted(n for n, c in counts.items() if c >= 20 and c > 6 * max(1, sum(counts.get(n + d, 0) for d in (-3, -2, -1, 1, 2, 3)) / 6))
    assert pairs.length_limits(spark.createDataFrame([(n,) for n in many], "n int")) == want and 300 in want


def test_length_limit(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 60) for _ in range(3)] + [(37,)] * 80, "n int")
    assert pairs.length_limits(df) == [37]


PAIR = "query_id string, query_text string, category string, expected_answer string, expected_context string"


@pytest.mark.parametrize("limit", [0, 100_000])
def test_rare_words_of_a_language_count_in_all_rows(spark, limit):
    """Words of three rows among 9,000: an answer made of them alone is of their language, wherever the rows stand."""
    rows = [(f"q{i}", Q, "direct_fact", "for 40 days", CONTEXT) for i in range(9000)]
    rare = [[f"{a}{b}korn" for b in "bdf"] for a in ("ma", "me", "mi", "mo", "mu", "la")]
    for n, words in enumerate(rare):
        rows += [(f"r{n}{i}", "Wer ist das?", "direct_fact", "das ist er", f"Die Mühle ist alt und das ist er mit der {' und '.join(words)} von dem Haus.") for i in range(3)]
        rows.append((f"d{n}", Q, "direct_fact", " ".join(words).capitalize() + " dort.", CONTEXT))
    df = spark.createDataFrame(rows, PAIR)
    got = {(r["query_id"], r["defect"], r["evidence"]) for r in pairs.defective_pairs(df, broadcast_rows=limit, salts=3).collect()}
    assert got == {(f"d{n}", "other_language", "de for en") for n in range(len(rare))}


@pytest.mark.parametrize("held", [10, 200_000])
def test_lexicon_holds_every_word(spark, held):
    """More than 20,000 words, of three rows each; no word of two rows or of two languages."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    words = ["q" + name(i) for i in range(21_000)]
    german = "der die das und ist nicht mit von " + " ".join(words) + " zweisprachig"
    english = "the of to and is are for with zweisprachig"
    rows = [("a", "selten", None, None, german), ("b", "selten", None, None, german), (None, "wort", None, None, german)] + [(f"e{i}", "wort", None, None, english) for i in range(3)]
    got = {r["word"]: (r["language"], r["share"]) for r in pairs.learn_lexicon(spark.createDataFrame(rows, PAIR).repartition(3), held=held).collect()}
    assert all(got[w] == ("de", pytest.approx(0.8)) for w in words) and got["the"] == ("en", pytest.approx(0.8))
    assert not {"selten", "zweisprachig", "wort"} & set(got)
