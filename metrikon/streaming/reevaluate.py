"""Re-evaluation of runs that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metrikon.functions.metrics import Metric, check_metrics, per_query
from metrikon.functions.text import norm
from metrikon.operators.match import norm_ids


def run_scores(results: DataFrame, queries: DataFrame, metrics: list[Metric], run_col: str = "run_id") -> DataFrame:
    """(run_col, metric, score, query_count) of every run of ``results``, by gold ids, in one aggregation.

    Every run is scored over all queries; one that a run has no results for scores 0, so it is in the count and not in
    the sums. A run without any query of the set gives no row.
    """
    k = max(m.k for m in check_metrics(metrics))
    total = queries.count()
    hits = results.where(F.col("rank") <= k).select(run_col, "query_id", F.struct("rank", norm(F.col("doc_id")).alias("doc_id")).alias("h"))
    lists = hits.groupBy(run_col, "query_id").agg(F.array_sort(F.collect_set("h"))["doc_id"].alias("retrieved"))
    gold = queries.select("query_id", norm_ids(F.col("expected_doc_ids")).alias("expected"))
    scored = per_query(lists.join(gold, "query_id"), metrics, keep=(run_col,))
    sums = scored.groupBy(run_col).agg(*(F.sum(m.alias).alias(m.alias) for m in metrics))
    each = F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), (F.col(m.alias) / F.lit(total)).alias("score")) for m in metrics)))
    return sums.select(run_col, each.alias("s")).select(run_col, "s.metric", "s.score", F.lit(total).cast("long").alias("query_count"))


def reevaluate(results: DataFrame, queries: DataFrame, metrics: list[Metric], path: str, checkpoint: str, run_col: str = "run_id") -> StreamingQuery:
    """Append (epoch, run_id, metric, score, query_count) to ``path`` for each batch of ``results``.

    A batch must hold whole runs. A batch that is tried again overwrites its own folder, so the output holds
    each epoch once.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        run_scores(batch, queries, metrics, run_col).write.mode("overwrite").partitionBy(run_col).parquet(f"{path}/epoch={epoch}")

    return results.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_hits(results: DataFrame, every: str = "1 day", late: str = "3 days") -> DataFrame:
    """Rows and empty ids per retriever and window of ``retrieved_at``, with a watermark for late deliveries."""
    rows = results.withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp")).withWatermark("retrieved_at", late)
    grouped = rows.groupBy(F.window("retrieved_at", every).alias("w"), "retriever")
    counted = grouped.agg(F.count("*").alias("results"), F.count_if(F.coalesce(F.trim("doc_id"), F.lit("")) == "").alias("without_id"))
    return counted.select(F.col("w.start").alias("window_start"), "retriever", "results", "without_id")
