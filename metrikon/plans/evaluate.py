"""The evaluator: one lazy plan from queries and a run to all metrics, and its results."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrikon.functions.metrics import Metric, check_metrics, summary
from metrikon.log import get_logger
from metrikon.operators.judges import Judge, TokenOverlapJudge
from metrikon.operators.match import candidate_labels, contexts, label_by_ids, label_by_judge, norm_ids
from metrikon.schema import ValidationError, parent_made, require_text

log = get_logger(__name__)


@dataclass(frozen=True)
class EvaluationResults:
    metric_scores: dict[str, float]
    query_count: int
    generated_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def __post_init__(self) -> None:
        if self.query_count < 0:
            raise ValidationError("query_count must not be negative")
        object.__setattr__(self, "metric_scores", {require_text(k, "metric name"): float(v) for k, v in self.metric_scores.items()})

    def summary(self) -> dict[str, float]:
        return dict(self.metric_scores)

    def to_dict(self) -> dict[str, object]:
        return {"metrics": self.summary(), "query_count": self.query_count, "generated_at": self.generated_at}

    def to_json(self, path: str | os.PathLike) -> None:
        with open(parent_made(path), "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2, sort_keys=True)

    def to_csv(self, path: str | os.PathLike) -> None:
        with open(parent_made(path), "w", encoding="utf-8", newline="") as f:
            rows = csv.writer(f)
            rows.writerow(("metric", "score"))
            rows.writerows((name, f"{self.metric_scores[name]:.12g}") for name in sorted(self.metric_scores))


def label(queries: DataFrame, run: DataFrame, documents: DataFrame | None = None, judge: Judge | None = None, max_k: int | None = None, include_doc_id: bool = True) -> DataFrame:
    """(query_id, retrieved, expected) of all queries: by gold ids where a query has any, else by the judge."""
    judge = judge or TokenOverlapJudge()
    has_gold = F.size(norm_ids(F.col("expected_doc_ids"))) > 0
    by_id, asked = queries.where(has_gold), queries.where(~has_gold)
    rows = run if max_k is None else run.where(F.col("rank") <= max_k)
    open_run = rows.join(asked.select("query_id"), "query_id", "left_semi")
    candidates = candidate_labels(open_run, documents, include_doc_id)
    judged = judge.judged(contexts(asked, candidates))
    return label_by_ids(by_id, rows, max_k).unionByName(label_by_judge(asked, candidates, judged))


class Evaluator:
    """Scores a retriever, ``(queries, k) -> run``, by metrics that share one labelling at the largest cutoff."""

    def __init__(self, retriever: Callable[[DataFrame, int], DataFrame], metrics: list[Metric], judge: Judge | None = None) -> None:
        self.retriever, self.metrics, self.judge = retriever, check_metrics(list(metrics)), judge or TokenOverlapJudge()

    def plan(self, queries: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """(metric, score, query_count), lazily."""
        k = max(m.k for m in self.metrics)
        return summary(label(queries, self.retriever(queries, k), documents, self.judge, k), self.metrics)

    def evaluate(self, queries: DataFrame, documents: DataFrame | None = None) -> EvaluationResults:
        if queries.isEmpty():
            raise ValidationError("the dataset has no queries")
        rows = self.plan(queries, documents).collect()
        log.info("evaluated", extra={"metrics": len(rows)})
        return EvaluationResults({r["metric"]: r["score"] for r in rows}, rows[0]["query_count"])
