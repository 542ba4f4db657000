import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrikon.llm import neardup, sampling


def words_of(t):
    import regex

    return frozenset(w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or ""))


def brute(rows, num=4, den=5):
    sets = {i: words_of(t) for i, t in rows if i is not None and words_of(t)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def corpus(n, seed, length, vocabulary, rare):
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        if texts and r.random() < 0.5:
            w = r.choice(texts)[:]
            for _ in range(r.randrange(0, 1 + len(w) // 5)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [f"new{r.randrange(9)}"], [w[k], "extra"]])
            r.shuffle(w)
        else:
            w = [f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(r.randrange(1, length))] + [f"r{i}{j}" for j in range(r.randrange(rare + 1))]
        texts.append(w or ["x"])
        rows.append((f"d{i}", " ".join(w)))
    return rows


@pytest.mark.parametrize("n, length, vocabulary, rare", [(250, 12, 30, 3), (200, 60, 50, 0), (200, 40, 400, 6)])
def test_no_pair_is_lost(spark, n, length, vocabulary, rare):
    rows = corpus(n, n + length, length, vocabulary, rare)
    df = spark.createDataFrame(rows, "id string, text string")
    got = [(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(df, "t", "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("most, rows, sample", [(3, 0, 20_000), (3, 100_000, 10), (40, 100_000, 0)])
def test_frequent_keys(spark, most, rows, sample):
    """Frequent words only, so that keys are split, salted, and joined with or without a broadcast."""
    texts = corpus(150, 9, 50, 60, 5)
    df = spark.createDataFrame(texts, "id string, text string")
    members, sets, _ = neardup.staged_sets(df, "id", "text", "test", broadcast_rows=rows)
    found = neardup.similar_sets(sets, most=most, broadcast_rows=rows, sample_sets=sample, salts=3)
    by_set = {}
    for r in members.collect():
        by_set.setdefault(r["sid"], []).append(r["id"])
    pairs = [(r["sid_a"], r["sid_b"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    got = {tuple(sorted((a, b))) for x, y in pairs for a in by_set[x] for b in by_set[y]}
    same = {tuple(sorted((a, b))) for v in by_set.values() for a in v for b in v if a < b}
    assert got | same == brute(texts)


def test_edges(spark):
    rows = [("a", "One two three", 1), ("b", "THREE one, two!", 1), ("a", "One two three", 1), ("c", None, 1), ("d", "...", 1), ("e", "", 1), (None, "One two three", 1), ("f", "x " * 5000, 1), ("g", "x", 1)]
    df = spark.createDataFrame(rows, "id string, text string, sid int")
    assert {(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(df, "t", "id", "text").collect()} == {("a", "b"), ("f", "g")}
    classes = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in neardup.near_duplicate_classes(df, "id", "text").collect()}
    assert classes == {"a": ("a", 2, 0), "b": ("a", 2, 0), "f": ("f", 2, 0), "g": ("f", 2, 0)}
    assert neardup.near_duplicates(df.where("false"), "t", "id", "text").count() == 0


def test_errors():
    for n in range(1, 60):
        for b in range(n, 80):
            for shared in range(n + 1):
                if 5 * shared >= 4 * (n + b - shared):
                    d = n + b - 2 * shared
                    assert d <= min(neardup.most_errors(n, 4, 5), neardup.most_errors(b, 4, 5), neardup.most_errors(b, 4, 5, partner=n))
                    assert n.bit_length() - 1 >= (-(-b * 4 // 5)).bit_length() - 1
    assert all(neardup.chunks_of(k, 4, 5, 0.0) > neardup.most_errors(2 ** (k + 1) - 1, 4, 5) for k in range(12))


def test_chunks_partition_the_words():
    word = np.arange(1, 40, dtype=np.uint64)
    row = np.repeat([0, 1, 2], 13)
    owner, chunk, value = neardup._chunk_values(neardup._mixed(word, 1), word, row, np.array([3, 1, 5]))
    assert list(np.bincount(owner)) == [3, 1, 5]
    for r in range(3):
        assert np.bitwise_xor.reduce(value[owner == r]) == np.bitwise_xor.reduce(word[row == r])


TARGETS = "plan_id int, category string, target_permille int, min_rows long, sample_permille int"


def test_sampling(spark):
    r = random.Random(1)
    names = ["direct_fact", " Direct-Fact ", "DIRECT  FACT", "paraphrase", "keyword search", "other", None]
    rows = [(f"q{i}", r.choice(names), "x") for i in range(3000)] + [("q1", "direct_fact", "x"), (None, "direct_fact", "x")]
    rows = [x for i, x in enumerate(rows) if i == 0 or x[0] != "q1"] + [("q1", "direct_fact", "y")] * 2
    df = spark.createDataFrame(rows, "query_id string, category string, cell string")
    plans = [(1, "direct_fact", 500, 0, 300), (1, "paraphrase", 100, 400, 300), (1, "multi_hop", 10, 5, 300), (2, "keyword_search", 1000, 0, 1000), (2, "paraphrase", 0, 0, 1000), (3, "direct_fact", None, None, None)]
    targets = spark.createDataFrame([*plans, plans[0]], TARGETS)
    key = {"direct_fact": "direct_fact", " Direct-Fact ": "direct_fact", "DIRECT  FACT": "direct_fact", "paraphrase": "paraphrase", "keyword search": "keyword_search"}
    have = Counter({i: key[c] for i, c, _ in rows if i and c in key}.values())
    n = sum(have.values())
    need = {(p, c): max(m or 0, n * (s or 0) // 1000 * (t or 0) // 1000) for p, c, t, m, s in plans}
    got = sampling.sample(targets, df, cell_bits=4).collect()
    assert Counter((r["plan_id"], r["category"]) for r in got) == Counter({k: min(v, have[k[1]]) for k, v in need.items() if min(v, have[k[1]])})
    assert len({(r["plan_id"], r["id"]) for r in got}) == len(got)
    assert {tuple(r) for r in sampling.exhausted(targets, df).collect()} == {(p, c, v, have[c]) for (p, c), v in need.items() if have[c] < v}
    again = {(r["plan_id"], r["id"]) for r in sampling.sample(targets, df.repartition(7), cell_bits=4).collect()}
    assert again == {(r["plan_id"], r["id"]) for r in got}
    other = {(r["plan_id"], r["id"]) for r in sampling.sample(targets, df, cell_bits=9).collect()}
    assert other == again
    assert sampling.sample(targets, df.where("false")).count() == 0
    assert {(r["plan_id"], r["category"]) for r in sampling.exhausted(targets, df.where("false")).collect()} == {(1, "paraphrase"), (1, "multi_hop")}
    assert sampling.sample(targets.where("false"), df).count() == 0


def test_sample_is_uniform(spark):
    df = spark.range(4000).select(F.concat(F.lit("q"), F.col("id")).alias("query_id"), F.lit("paraphrase").alias("category"))
    targets = spark.createDataFrame([(1, "paraphrase", 1000, 0, 500)], TARGETS)
    ids = [int(r["id"][1:]) for r in sampling.sample(targets, df).collect()]
    assert len(ids) == 2000 and abs(np.mean(ids) - 2000) < 100


def test_rows_are_read_once_and_cells_merge(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("q"), F.col("id")).alias("query_id"), F.lit("paraphrase").alias("category"))
    df.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    out = sampling.sample(spark.createDataFrame([(1, "paraphrase", 1000, 0, 500)], TARGETS), rows, cell_bits=4)
    assert not any(str(tmp_path) in f for f in out.inputFiles()) and out.count() == 250
    first = sorted((r["priority"] % 2**64, r["id"]) for r in sampling.reservoirs(rows, "query_id", "category").collect())[:250]
    assert {r["id"] for r in out.collect()} == {i for _, i in first}
    cells = sampling.merged_cells(sampling.reservoirs(rows, "query_id", "category", cell_bits=4)).collect()
    assert len(cells) == 16 and sum(r["count"] for r in cells) == 500
    assert all(len(r["ids"]) == r["count"] and [tuple(x) for x in r["ids"]] == sorted(tuple(x) for x in r["ids"]) for r in cells)
