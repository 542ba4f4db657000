import json

import pytest
from pyspark.sql import functions as F

from metrikon.functions import metrics as m
from metrikon.operators import judges, match, retrieve
from metrikon.plans.evaluate import EvaluationResults, Evaluator, label
from metrikon.schema import ValidationError

DOCS = [
    ("t1", "The night train to Lisbon leaves at nine from platform four"),
    ("t2", "Bicycles travel free on regional ferries outside the summer months"),
    ("t3", "A visa for the island costs forty crowns and lasts thirty days"),
    ("t4", "Lost luggage is kept at the harbour office for sixty days"),
    ("t5", "The mountain hostel serves breakfast from six until ten"),
]
QUERIES = [
    ("q1", "when does the night train leave", None, [DOCS[0][1]]),
    ("q2", "do bicycles travel free on ferries", None, [DOCS[1][1]]),
    ("q3", "visa costs and lost luggage at the harbour office", None, [DOCS[2][1], DOCS[3][1]]),
]


@pytest.fixture(scope="module")
def travel(spark):
    docs = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(DOCS)], "doc_id string, text string, doc_pos long")
    queries = spark.createDataFrame(QUERIES, "query_id string, query_text string, expected_doc_ids array<string>, expected_answers array<string>")
    return queries, docs


def lexical(docs):
    return lambda q, k: retrieve.lexical_topk(docs, q, k)


def test_judged_end_to_end(travel):
    queries, docs = travel
    got = Evaluator(lexical(docs), [m.HitRate(1), m.Recall(1), m.Recall(2)]).evaluate(queries, docs)
    assert got.query_count == 3
    assert got.summary()["hit_rate@1"] == 1.0
    assert got.summary()["recall@1"] == pytest.approx(5 / 6)
    assert got.summary()["recall@2"] == pytest.approx(1.0)


def test_gold_ids_go_before_the_judge(travel):
    queries, docs = travel
    gold = queries.withColumn("expected_doc_ids", F.when(F.col("query_id") == "q1", F.array(F.lit(" T5 "))).otherwise(F.array(F.lit(" "))))
    rows = {r["query_id"]: r for r in label(gold, retrieve.lexical_topk(docs, gold, 1), docs).collect()}
    assert rows["q1"]["expected"] == ["t5"] and rows["q1"]["retrieved"] == ["t1"]
    assert rows["q2"]["retrieved"] == rows["q2"]["expected"]


def test_second_result_for_a_taken_label_is_a_miss(spark):
    q = spark.createDataFrame([("q", "", [], ["same text here"])], "query_id string, query_text string, expected_doc_ids array<string>, expected_answers array<string>")
    run = spark.createDataFrame([("q", 1, "a", {"text": "same text here"}), ("q", 2, "b", {"content": "Same  TEXT here"})], "query_id string, rank int, doc_id string, metadata map<string,string>")
    row = label(q, run).first()
    assert row["retrieved"][0] == "same text here" and row["retrieved"][1].startswith("retrieved_1:")


def test_assignment(spark):
    df = spark.createDataFrame([([[1, 2], [1], [2], []],), ([],), ([[0], [0]],)], "m array<array<int>>")
    assert [r[0] for r in df.select(match.assign_labels(F.col("m"))).collect()] == [[1, -1, 2, -1], [], [0, -1]]


def test_query_without_results_stays(spark, travel):
    queries, docs = travel
    got = label(queries, retrieve.lexical_topk(docs.where("false"), queries, 3), docs).collect()
    assert sorted((r["query_id"], len(r["retrieved"])) for r in got) == [("q1", 0), ("q2", 0), ("q3", 0)]


def test_candidates_last_document_wins(spark):
    docs = spark.createDataFrame([("A", "old", 1), (" a ", "new", 2), ("a", "  ", 3)], "doc_id string, text string, doc_pos long")
    run = spark.createDataFrame([("q", 1, "A", {"chunk": "Bit", "text": " "}), ("q", 2, None, None)], "query_id string, rank int, doc_id string, metadata map<string,string>")
    got = {r["rank"]: r["candidates"] for r in match.candidate_labels(run, docs).collect()}
    assert got == {1: ["a", "new", "bit"], 2: []}


def test_results_files(tmp_path):
    r = EvaluationResults({"b@1": 1 / 3, "a@1": 1}, 2, "2025-01-01T00:00:00+00:00")
    r.to_json(tmp_path / "x/r.json")
    r.to_csv(tmp_path / "y/r.csv")
    assert json.loads((tmp_path / "x/r.json").read_text()) == {"generated_at": "2025-01-01T00:00:00+00:00", "metrics": {"a@1": 1.0, "b@1": 1 / 3}, "query_count": 2}
    assert (tmp_path / "y/r.csv").read_text().split() == ["metric,score", "a@1,1", "b@1,0.333333333333"]
    with pytest.raises(ValidationError):
        EvaluationResults({}, -1)


def test_evaluator_arguments(spark, travel):
    queries, docs = travel
    with pytest.raises(ValidationError):
        Evaluator(lexical(docs), [])
    with pytest.raises(ValidationError):
        Evaluator(lexical(docs), [m.Recall(1)]).evaluate(queries.where("false"))


JUDGED = [
    ("Same Text", "same  text", 15, 0.6, True, 1.0),
    ("", "", 15, 0.6, True, 1.0),
    ("the bridge is open", "the bridge is not open", 15, 0.6, True, 0.0),
    ("open bridge", "an open bridge over the river", 15, 0.6, True, 1.0),
    ("9", "within 90 days", 15, 0.6, True, 1.0),
    ("red lamp post", "lamp of another post", 3, 0.6, False, 0.0),
    ("red lamp post", "lamp of another post", 2, 0.6, False, 2 / 3),
    ("lamp post red", "blue lamp post there", 2, 0.6, False, 2 / 3 + 0.05),
    ("lamp post red", "blue lamp post there", 2, 0.6, True, 2 / 3 + 0.05 + 0.1),
    ("the of and", "lamp", 1, 0.6, True, 0.0),
    (None, "lamp", 1, 0.6, True, 0.0),
]


@pytest.mark.parametrize("expected, retrieved, least, ratio, boost, want", JUDGED)
def test_token_overlap(spark, expected, retrieved, least, ratio, boost, want):
    j = judges.TokenOverlapJudge(least, ratio, boost)
    df = spark.createDataFrame([("which lamp", expected, retrieved)], "query string, expected_text string, retrieved_text string")
    score = df.select(j.score(F.col("query"), F.col("expected_text"), F.col("retrieved_text"))).first()[0]
    assert score == pytest.approx(want)
    assert j.judged(df).first()["relevant"] == (want >= ratio)


def test_other_judges(spark):
    df = spark.createDataFrame([("a b", "x y z", "x y q"), ("a", "one two", "three")], "query string, expected_text string, retrieved_text string")
    vectors = lambda texts: [[1.0, float("x" in t)] for t in texts]
    assert [r["relevant"] for r in judges.SemanticJudge(vectors, 0.9).judged(df).collect()] == [True, True]
    assert [r["relevant"] for r in judges.LLMJudge(lambda p: "YES" if "x y q" in p else "no, it is not").judged(df).collect()] == [True, False]
    assert [r["relevant"] for r in judges.BatchJudge(lambda b: b["expected_text"].str.len() > 5).judged(df).collect()] == [False, True]
    ratio = judges.token_ratio_judge(2, 0.6)
    assert [r[0] for r in df.select(ratio(F.col("query"), F.col("expected_text"), F.col("retrieved_text"))).collect()] == [True, False]
    assert judges.provider_name(" Gemini ") == "google"
    with pytest.raises(ValueError):
        judges.provider_name("nobody")


def test_replies(spark):
    texts = ["Yes.", "NO", "not at all", "none", "It is relevant", "irrelevant", "The match is a mismatch", "Correct", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(judges.parse_relevance(F.col("t"))).collect()]
    assert got == [True, False, False, False, True, False, False, True, False, False]


def test_vectors(spark):
    rows = [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.9, 0.1, 0.0]), ("z", [0.0, 0.0, 0.0]), ("n", None), ("a2", [1.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    q = spark.createDataFrame([("q1", [1.0, 0.0, 0.0]), ("q2", [0.0, 1.0, 0.0])], "vec_id string, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in retrieve.vector_topk(corpus, q, 3).orderBy("query_id", "rank").collect()]
    assert got == [("q1", 1, "a"), ("q1", 2, "a2"), ("q1", 3, "c"), ("q2", 1, "b"), ("q2", 2, "c"), ("q2", 3, "a")]
    blocks = [(r["query_id"], r["rank"], r["doc_id"]) for r in retrieve.vector_topk(corpus, q, 3, block=1).orderBy("query_id", "rank").collect()]
    assert blocks == got
    assert retrieve.vector_topk(corpus.where("false"), q, 3, "l2").count() == 0
    assert retrieve.vector_topk(corpus, q.where("false"), 3, "dot").count() == 0
    with pytest.raises(ValidationError):
        retrieve.vector_topk(corpus, q, 3, "manhattan")


def test_external_retriever(spark, travel):
    queries, _ = travel
    run = retrieve.external_run(queries, lambda text, k: [(f"d{i}", 1.0 / (i + 1), {"n": i}) for i in range(9)], 2).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in run)[:2] == [("q1", 1, "d0"), ("q1", 2, "d1")]
    with pytest.raises(Exception, match="no id"):
        retrieve.external_run(queries, lambda text, k: [(None, 1.0, {})], 2).collect()


def test_streamed_runs(spark, tmp_path):
    from metrikon.streaming.reevaluate import reevaluate

    src = str(tmp_path / "in")
    spark.createDataFrame([("r1", "q", 1, "a"), ("r2", "q", 1, "b")], "run_id string, query_id string, rank int, doc_id string").write.parquet(src)
    queries = spark.createDataFrame([("q", ["a"])], "query_id string, expected_doc_ids array<string>")
    stream = spark.readStream.schema("run_id string, query_id string, rank int, doc_id string").parquet(src)
    reevaluate(stream, queries, [m.HitRate(1)], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["run_id"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("r1", 1.0), ("r2", 0.0)}
