import datetime as dt
import json
import logging

import pytest

from metrikon import log, session
from metrikon.functions import metrics as m
from metrikon.operators.match import label_by_ids
from metrikon.operators.order import numbered
from metrikon.schema import ValidationError
from metrikon.sources.tables import read_table, write_table
from metrikon.streaming.reevaluate import reevaluate, windowed_hits


def test_windows(spark, tmp_path):
    t = dt.datetime(2025, 1, 1, 6)
    rows = [(t, "a", "d1"), (t + dt.timedelta(hours=1), "a", " "), (t + dt.timedelta(days=1), "a", None), (t, "b", "d2")]
    src = str(tmp_path / "in")
    schema = "retrieved_at timestamp_ntz, retriever string, doc_id string"
    spark.createDataFrame(rows, schema).write.parquet(src)
    q = windowed_hits(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["window_start"].day, r["retriever"], r["results"], r["without_id"]) for r in spark.table("hits").collect())
    assert got == [(1, "a", 2, 1), (1, "b", 1, 0), (2, "a", 1, 1)]


def test_runs_of_a_batch_are_scored_together(spark, tmp_path):
    queries = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["c"]), ("q3", [])], "query_id string, expected_doc_ids array<string>")
    rows = [("r1", "q1", 1, "A "), ("r1", "q1", 2, "x"), ("r1", "q2", 1, "x"), ("r1", "q2", 2, "c"), ("r2", "q1", 1, "b"), ("r2", "q1", 1, "b"), ("r2", "q1", 2, "a"), ("r2", "q9", 1, "a")]
    src = str(tmp_path / "in")
    schema = "run_id string, query_id string, rank int, doc_id string"
    spark.createDataFrame(rows, schema).write.parquet(src)
    for _ in range(2):  # nothing new: the second start adds nothing
        reevaluate(spark.readStream.schema(schema).parquet(src), queries, [m.Recall(2), m.MRR(2)], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["run_id"], r["metric"]): (r["score"], r["query_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("r1", "recall@2"): (0.5, 3), ("r1", "mrr@2"): (0.5, 3), ("r2", "recall@2"): (pytest.approx(1 / 3), 3), ("r2", "mrr@2"): (pytest.approx(1 / 3), 3)}
    one = {(r["metric"], r["score"]) for r in m.summary(label_by_ids(queries, spark.createDataFrame(rows, schema).where("run_id = 'r1'"), 2), [m.Recall(2), m.MRR(2)]).collect()}
    assert one == {("recall@2", 0.5), ("mrr@2", 0.5)}


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_tables(spark, tmp_path, kind):
    df = spark.createDataFrame([("recall@5", 0.5), ("mrr@5", 0.25)], "metric string, score double")
    write_table(df, str(tmp_path / kind), kind)
    back = read_table(spark, str(tmp_path / kind), kind, df.schema)
    assert sorted(tuple(r) for r in back.collect()) == [("mrr@5", 0.25), ("recall@5", 0.5)]
    with pytest.raises(ValidationError):
        read_table(spark, "x", "xml")


def test_staged_tables_go_with_their_scope(spark):
    kept = session.staged(spark.range(3), "kept")
    with session.staging():
        gone = session.staged(spark.range(4), "gone")
        assert gone.count() == 4
    assert kept.count() == 3
    with pytest.raises(Exception, match="exist|not found|NOT_EXIST"):
        gone.count()


def test_global_order(spark):
    df = spark.range(500).selectExpr("(id * 37) % 500 AS k", "id % 3 AS s").repartition(6)
    rows = sorted((r["k"], r["n"], r["total"]) for r in numbered(numbered(df, ["k"], "n"), ["k"], "total", "s").collect())
    by_key = {(i * 37) % 500: i % 3 for i in range(500)}
    total = 0
    for i, (k, n, running) in enumerate(rows):
        total += by_key[k]
        assert (k, n, running) == (i, i + 1, total)


def test_json_lines(capsys):
    log.configure_logging(level=logging.INFO, structured=True, force=True)
    log.get_logger("x").info("done", extra={"rows": 3})
    line = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert line["message"] == "done" and line["rows"] == 3 and line["logger"] == "metrikon.x"
    log.configure_logging(level="ERROR")
    assert logging.getLogger("metrikon").level == logging.ERROR
