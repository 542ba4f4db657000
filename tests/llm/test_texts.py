import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrikon.llm import bpe, leakage, lookalike

TEXTS = ["Hello world, it's 2024!", "", None, "   ", "\n\n a b　 c \t", "Größe naïve café", "Привет мир", "日本語テスト 検索", "🔎✅ ok", "<|endoftext|> x", "x" * 700, "don't we'll THEY'RE", " " * 90 + "end", "a\r\nb", "éclair", "1234567890" * 9, "https://example.org/a/very/long/path/that/never/ends?with=query&and=more#frag"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("kept,longest", [(8192, bpe.LONGEST), (3, 24)])
def test_encoding(spark, tokenizer, kept, longest):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("ab é1 \n.ü") for _ in range(r.randrange(60))) for _ in range(40)] + ["Quevrumael kept it"] * 30 + ["=" * 5000 + " " + "qz" * 60, "абвгд" * 50]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = bpe.encode(df, "doc_id", "text", kept_words=kept, longest=longest)
    rows = {r["doc_id"]: list(r["ids"]) for r in got.collect()}
    want = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [rows[i] for i in range(len(texts))] == [w.ids for w in want]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(got, "ids").collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert bpe.encode(df.where("false"), "doc_id", "text").count() == 0
    assert bpe.corpus_counts(got).first()["documents"] == len(texts)


def test_heap_merges(tokenizer):
    ranks = bpe.load_ranks()
    r = random.Random(4)
    for n in (1, 2, 5, 30, 400):
        word = "".join(r.choice("aabcdeniorst") for _ in range(n))
        assert bpe.merge_bytes(word.encode(), ranks) == tokenizer.encode(word, add_special_tokens=False).ids


SAME = [
    ("A naïve café, page 10", "A naïve café, page 10"),
    ("space bar", "spаce bаr"),
    ("space bar", "space bar"),
    ("space bar", "sp​ace­ b⁠ar﻿"),
    ("Code 42: ok", "Ｃｏｄｅ ４２： ｏｋ"),
    ("Поиск сервиса ёлка", "Пoиск ceрвиcа ёлка"),
    ("Boston", "Βostοn"),
    ("digit", "ԁiɡit"),
]
APART = [("space", "Space"), ("cafe", "café"), ("m2", "m²"), ("page 10", "page 11"), ("a b", "a  b"), ("a, b", "a. b"), ("line one", "line\none"), ("бор", "6op")]


def test_forms_by_table():
    form = lambda t: lookalike.skeleton(lookalike.base_form(t))
    for a, b in SAME:
        assert form(a) == form(b) and a != b
    for a, b in APART:
        assert form(a) != form(b)
    assert lookalike.table_form("Пoиск") == "Поиск" and lookalike.table_form("spаce") == "space"


def test_forms_of_many_texts():
    texts = [t for pair in SAME + APART for t in pair] + TEXTS + ["a\x00ｂ", "￣x"]
    assert lookalike.base_forms(texts) == [t if t is None else lookalike.base_form(t) for t in texts]


def test_trie():
    trie = lookalike.Trie()
    for w, n in (("space", 5), ("spacé", 1), ("spice", 9), ("сор", 3)):
        trie.add(w, n)
    assert trie.reached("spа​ce") == [("space", 5, 0)]
    assert trie.reached("cop") == [("сор", 3, 0)] and trie.reached("spac") == [] and trie.reached("spacer") == []
    assert sorted(trie.reached("spаce", 1)) == [("space", 5, 0), ("spacé", 1, 1), ("spice", 9, 1)]
    assert sorted(trie.reached("sрacer", 1)) == [("space", 5, 1), ("spacé", 1, 1)] and sorted(trie.reached("spac", 2)) == [("space", 5, 1), ("spacé", 1, 2), ("spice", 9, 2)]
    assert lookalike.canonical("cоp", [("сор", 3, 0), ("cop", 1, 0)]) == "cop"
    assert lookalike.canonical("zоo", []) == "zoo"


def test_trie_costs_are_edit_distances():
    r = random.Random(9)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(60)})
    trie = lookalike.Trie()
    for w in words:
        trie.add(w, 1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = following(row, i, x, b)
        return row[-1]

    def following(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        return new

    for _ in range(40):
        run = "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))
        for limit in (0, 1, 2):
            assert sorted(trie.reached(run, limit)) == sorted((w, 1, distance(run, w)) for w in words if distance(run, w) <= limit)


def test_letters_drawn_like_two_others(spark):
    """A palochka is an I or an l: equal skeletons miss the second, the vocabulary knows it."""
    texts = ["the list is long", "the Ӏist is long", "In time", "Ӏn time", "Indeed lime", "ӏndeed lime"]
    assert lookalike.skeleton("Ӏist") != "list"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (2, 20_000):
        forms = {r["id"]: r["form"] for r in lookalike.normalize_texts(df, "doc_id", "text", slice_rows=rows).collect()}
        assert [forms[k] for k in range(6)] == [texts[k // 2 * 2] for k in range(6)]


@pytest.mark.parametrize("limit", [0, 100_000])
def test_lookalike_pairs(spark, limit):
    texts = [t for pair in SAME + APART for t in pair] + [SAME[0][0], None, "", " ​", " ", "х", "x", "сор вода", "сop вода", "cop вода"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    rows = lookalike.normalize_texts(df, "doc_id", "text", slice_rows=7, broadcast_rows=limit, salts=2).collect()
    forms = {r["id"]: r["form"] for r in rows}
    assert len(rows) == len(texts) and forms[texts.index(None)] is None and forms[texts.index("")] == ""
    key = {i: lookalike.skeleton(lookalike.base_form(t)) for i, t in enumerate(texts) if t is not None}
    for a in key:
        for b in key:
            assert (forms[a] == forms[b]) == (key[a] == key[b])
    got = [tuple(r) for r in lookalike.lookalike_pairs(df.union(df), "doc_id", "text", broadcast_rows=limit, salts=2).collect()]
    want = {(a, b) for a in key for b in key if a < b and key[a] == key[b] and texts[a] != texts[b] and key[a].strip()}
    assert len(got) == len(set(got)) and set(got) == want
    assert lookalike.lookalike_pairs(df.where("false"), "doc_id", "text").count() == 0


def local_score(doc, item, free_start=True):
    """Smith-Waterman score cell by cell; without ``free_start`` the alignment begins at the first words of both."""
    rows = [[0 if free_start else -j - i for j in range(len(doc) + 1)] for i in range(len(item) + 1)]
    for i, w in enumerate(item, 1):
        for j, v in enumerate(doc, 1):
            best = max(rows[i - 1][j - 1] + (2 if v == w else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            rows[i][j] = max(0, best) if free_start else best
    return max(map(max, rows))


def test_extensions():
    assert local_score("x a b y c d z".split(), "a b c d".split()) == 7
    r = random.Random(7)
    pairs = [tuple([r.choice("abcd") for _ in range(r.randrange(25))] for _ in range(2)) for _ in range(300)]
    for code in (np.uint16, np.uint32):
        for step in (1, -1):
            sides = []
            for k in (0, 1):
                flat = np.array([4 * ord(c) for p in pairs for c in p[k][::step]], dtype=code)
                size = np.array([len(p[k]) for p in pairs])
                sides.append(leakage.Side(flat, np.cumsum(size) - (size if step > 0 else 1), size, np.full(len(pairs), step)))
            assert leakage.extensions(*sides, cells=200).tolist() == [max(0, local_score(*p, free_start=False)) for p in pairs]


@pytest.mark.parametrize("limit", [150, 2_000_000])
def test_leaks(spark, limit):
    r = random.Random(11)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 300}"
    items = [[word() for _ in range(r.randrange(8, 40))] for _ in range(20)] + [["the"] * 14]
    docs = []
    for i in range(150):
        d = [word() for _ in range(r.randrange(0, 60))]
        if i % 2:
            it = r.choice(items)
            a = r.randrange(len(it))
            d[len(d) // 2 : len(d) // 2] = it[a : a + r.randrange(8, 20)]
        docs.append(d)
    noisy = lambda d: "".join((w.upper() if r.random() < 0.3 else w) + r.choice([" ", ", ", "\n", " ​"]) for w in d)
    rows = [(i, noisy(d)) for i, d in enumerate(docs)] + [(900, None), (901, ""), (None, noisy(items[0]))]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, pos int")
    tests = spark.createDataFrame([(i, " ".join(t), 1) for i, t in enumerate(items)] + [(99, None, 1)], "item_id long, text string, h int")
    out = leakage.leaks(df, tests, block_words=limit)
    got = {(x["doc_id"], x["item_id"]) for x in out.where("longest_run >= 12").collect()}
    grams = lambda w: {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
    assert got == {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if grams(d) & grams(t)}
    for x in out.collect():
        assert 2 * x["longest_run"] <= x["score"] <= local_score(docs[x["doc_id"]], items[x["item_id"]])
    assert leakage.leaks(df.where("false"), tests).count() == 0 and leakage.leaks(df, tests.where("false")).count() == 0


def test_edited_copy_scores(spark):
    item = [f"word{i}" for i in range(30)]
    copy = item[:]
    copy[10:11], copy[20:21] = [], ["changed", "twice"]
    df = spark.createDataFrame([(1, "start " + " ".join(copy))], "doc_id long, text string")
    row = leakage.leaks(df, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).first()
    assert row["longest_run"] == 10 and row["score"] >= 50 and row["item_words"] == 30


@pytest.mark.parametrize("copies", [4, 40, 400])
def test_edited_copies_at_any_frequency(spark, copies):
    r = random.Random(copies)
    item = [f"word{i}" for i in range(20)]
    texts = []
    for i in range(copies):
        copy = item[:]
        copy[10] = f"changed{i % 3}"
        texts.append(" ".join(r.choice("klmnop") for _ in range(r.randrange(30))) + " " + " ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = leakage.leaks(df, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((x["doc_id"], x["score"], x["longest_run"], x["seed_places"]) for x in out) == [(i, 37, 10, copies) for i in range(copies)]


def test_recall_of_edited_copies(spark):
    """One word in eight edited: at least nine of ten copies come out with most of the score of a whole copy."""
    r = random.Random(13)
    items = [[f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(r.randrange(30, 90))] for _ in range(40)]
    texts = []
    for k in range(400):
        out = []
        for w in items[k % 40]:
            p = r.random()
            out += [w] if p > 1 / 8 else [] if p < 1 / 24 else ["other", w] if p < 1 / 12 else ["other"]
        texts.append((k, " ".join(out)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = leakage.leaks(df, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    hits = found.where("score >= item_words AND doc_id % 40 = item_id").count()
    assert hits >= 0.9 * len(texts)


def test_copies_edited_in_many_documents(spark):
    item = [f"word{i}" for i in range(13)]
    first, last = item[:6] + ["x"] * 7, ["y"] * 7 + item[7:]  # each keeps one n-gram of six, and not the same
    texts = [" ".join(first)] * 9 + [" ".join(last)] * 5 + ["no word of it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = leakage.leaks(df, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string"))
    assert sorted((x["doc_id"], x["score"], x["longest_run"]) for x in out.collect()) == [(i, 12, 6) for i in range(14)]


def test_long_insertions_and_short_items(spark):
    item = [f"word{i}" for i in range(60)]
    tail = [w if k % 6 < 5 else "changed" for k, w in enumerate(item[30:])]  # no n-gram of six
    doc = ["before"] * 150 + item[:30] + ["between"] * 40 + tail + ["after"] * 150
    df = spark.createDataFrame([(1, " ".join(doc)), (2, "so word70 word71 word72 word73 word74 word75 word76 it is")], "doc_id long, text string")
    tests = spark.createDataFrame([(5, " ".join(item)), (6, " ".join(f"word{i}" for i in range(70, 78))), (7, "word70 word71")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["longest_run"]) for r in leakage.leaks(df, tests).collect()}
    assert local_score(doc, item) == 66
    assert got == {(1, 5): (66, 30), (2, 6): (14, 7)}


def test_compared_words():
    assert lookalike.compared_words("В oтчёте") == lookalike.compared_words("в ОТЧЁТЕ")
    assert lookalike.compared_words("Вutton") == ["button"] and lookalike.compared_words(None) == []
    assert lookalike.compared_words("sp​ace-bar_x") == ["space", "bar", "x"]
    texts = [t for pair in SAME + APART for t in pair] + TEXTS + ["a\x00b", "￣x", "İstanbul ΣΑΣ", "ｶﾞ gã"]
    owner, found = lookalike.compared_hashes(texts)
    words = [(k, w) for k, t in enumerate(texts) for w in lookalike.compared_words(t)]
    assert owner.tolist() == [k for k, _ in words]
    assert len(set(zip([w for _, w in words], found.tolist()))) == len({w for _, w in words}) == len(set(found.tolist()))
