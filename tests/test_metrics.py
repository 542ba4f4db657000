import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metrikon.functions import metrics as m
from metrikon.schema import ValidationError

BINARY = [
    (m.NDCG(3), ["d1", "d2", "d3"], ["d1", "d3"], 0.9197207891),
    (m.NDCG(5), ["d1", "d4", "d2", "d9", "d8"], ["d2", "d8", "d10"], 0.416181),
    (m.Precision(5), ["d1", "d4", "d2", "d9", "d8"], ["d2", "d8", "d10"], 0.4),
    (m.Recall(5), ["d1", "d4", "d2", "d9", "d8"], ["d2", "d8", "d10"], 2 / 3),
    (m.MRR(5), ["d1", "d4", "d2"], ["d2"], 1 / 3),
    (m.HitRate(2), ["d1", "d4", "d2"], ["d2"], 0.0),
    (m.HitRate(3), ["d1", "d4", "d2"], ["d2"], 1.0),
    (m.AveragePrecision(5), list("abcde"), list("acf"), 0.5555555556),
    (m.AveragePrecision(4), ["d4", "d1", "d2", "d3"], ["d1", "d2"], 0.5833333333),
    (m.AveragePrecision(3), list("axyb"), list("ab"), 0.5),
    (m.ERR(3), ["a", "x"], ["a"], 0.0625),
    (m.RBP(3), list("abc"), list("abc"), 0.488),
    # a document listed twice: once for sets, each time for ranks, clamped to 1
    (m.Precision(2), ["a", "a"], ["a"], 0.5),
    (m.Recall(2), ["a", "a"], ["a"], 1.0),
    (m.NDCG(2), ["a", "a"], ["a"], 1.0),
    (m.AveragePrecision(2), ["a", "a"], ["a"], 1.0),
]


def value(spark, column, retrieved, expected):
    df = spark.createDataFrame([(retrieved, expected)], "retrieved array<string>, expected array<string>")
    return df.select(column(F.col("retrieved"), F.col("expected"))).first()[0]


@pytest.mark.parametrize("metric, retrieved, expected, want", BINARY, ids=lambda x: getattr(x, "name", None))
def test_known_values(spark, metric, retrieved, expected, want):
    assert value(spark, metric.column, retrieved, expected) == pytest.approx(want, abs=1e-6)


def test_graded(spark):
    df = spark.createDataFrame([(["d1", "d2", "d3"], {"d1": 3.0, "d2": 4.0, "d3": 1.0}, {"d1": 4.0, "d2": 2.0, "d3": 1.0})], "r array<string>, g map<string,double>, h map<string,double>")
    err, rbp, ndcg = df.select(m.ERR(3).graded(F.col("r"), F.col("g")), m.RBP(3).graded(F.col("r"), F.col("h")), m.NDCG(3).graded(F.col("r"), F.col("h"))).first()
    assert err == pytest.approx(0.7019, abs=1e-3)
    assert rbp == pytest.approx(0.312, abs=1e-9)
    assert ndcg == pytest.approx(1.0)
    one = spark.createDataFrame([(["a"], {"a": -1.0}), (["a"], {"a": 5.0}), (["a"], {"a": 4.0}), (["a"], {}), (["a"], None)], "r array<string>, g map<string,double>")
    assert [round(x[0], 6) for x in one.select(m.ERR(5).graded(F.col("r"), F.col("g"))).collect()] == [0.0, 0.9375, 0.9375, 0.0, 0.0]


@pytest.mark.parametrize("metric", [m.HitRate(3), m.Recall(3), m.Precision(3), m.MRR(3), m.NDCG(3), m.AveragePrecision(3), m.ERR(3), m.RBP(3)], ids=lambda x: x.name)
@pytest.mark.parametrize("retrieved, expected", [([], ["a"]), (["a"], []), ([], []), (None, ["a"]), (["a"], None), ([None], ["a"])])
def test_nothing_scores_zero(spark, metric, retrieved, expected):
    assert value(spark, metric.column, retrieved, expected) == 0.0


def test_summary_keeps_queries_without_gold(spark):
    rows = [("q1", ["d1", "d2", "d3"], ["d1", "d3"]), ("q2", ["x"], ["y"]), ("q3", ["x"], None)]
    df = spark.createDataFrame(rows, "query_id string, retrieved array<string>, expected array<string>")
    got = {r["metric"]: (r["score"], r["query_count"]) for r in m.summary(df, [m.NDCG(3), m.RBP(3, 0.95)]).collect()}
    assert got["ndcg@3"] == (pytest.approx(0.9197207891 / 3), 3)
    assert set(got) == {"ndcg@3", "rbp(p=0.95)@3"}
    assert m.NDCG(3).score(df.where("false")).first()[0] == 0.0
    d = m.diagnostics(df).first()
    assert (d["query_count"], d["avg_retrieved_count"], d["empty_retrieved_queries"], d["empty_expected_queries"]) == (3, 1.67, 0, 1)


def test_arguments():
    for bad in (0, -1, "x", None):
        with pytest.raises(ValidationError):
            m.Recall(bad)
    assert m.Recall("5").name == "recall@5" and m.ERR(3, 5).name == "err(max_grade=5)@3"
    with pytest.raises(ValueError):
        m.ERR(3, 0)
    for p in (0.0, 1.0, 1.5):
        with pytest.raises(ValueError):
            m.RBP(3, p)
    assert m.RBP(3).expected_search_depth == pytest.approx(5.0)
    with pytest.raises(ValidationError):
        m.check_metrics([])
    with pytest.raises(ValidationError):
        m.check_metrics([m.Recall(3), m.Recall(3)])


def test_residual(spark):
    assert spark.range(1).select(m.RBP(10).residual(F.lit(5))).first()[0] == pytest.approx(0.8**5)


def brute(r, e, k):
    e, top = set(e), r[:k]
    rel = [d in e for d in top]
    dcg = sum(1 / math.log2(i + 2) for i, x in enumerate(rel) if x)
    ideal = sum(1 / math.log2(i + 2) for i in range(min(k, len(e))))
    hits, ap = 0, 0.0
    for i, x in enumerate(rel):
        hits += x
        ap += x * hits / (i + 1)
    cascade, err = 1.0, 0.0
    for i, x in enumerate(rel):
        g = x / 16
        err += cascade * g / (i + 1)
        cascade *= 1 - g
    return {
        "hit_rate": float(any(rel)), "recall": len(set(top) & e) / len(e) if e else 0.0, "precision": len(set(top) & e) / k,
        "mrr": next((1 / (i + 1) for i, x in enumerate(rel) if x), 0.0), "ndcg": min(1, dcg / ideal) if e else 0.0,
        "average_precision": min(1, ap / len(e)) if e else 0.0, "err": err, "rbp": 0.2 * sum(0.8**i for i, x in enumerate(rel) if x),
    }


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdefgh"), max_size=9), st.lists(st.sampled_from("abcdefgh"), max_size=5)), min_size=1, max_size=20), st.integers(1, 8))
def test_against_brute_force(spark, cases, k):
    every = [m.HitRate(k), m.Recall(k), m.Precision(k), m.MRR(k), m.NDCG(k), m.AveragePrecision(k), m.ERR(k), m.RBP(k)]
    df = spark.createDataFrame([(i, r, e) for i, (r, e) in enumerate(cases)], "query_id int, retrieved array<string>, expected array<string>")
    for row in m.per_query(df, every).collect():
        r, e = cases[row["query_id"]]
        want = brute(r, e, k)
        for x in every:
            assert row[x.alias] == pytest.approx(want[x.key], abs=1e-9)
            assert 0.0 <= row[x.alias] <= 1.0
