"""Ranking metrics as Column expressions over arrays of at most max-k elements.

Set metrics (hit rate, recall, precision) count a repeated document once; ranked ones count it at each rank and
are clamped to 1. A query without gold scores 0 and stays in the mean.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrikon.log import get_logger
from metrikon.schema import ValidationError, repeated, require_positive

log = get_logger(__name__)


def unit(c: Column) -> Column:
    """Clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def flags(retrieved: Column, expected: Column, k: int) -> Column:
    """1.0 or 0.0 for each of the first k: is it expected?"""
    e = texts(expected)
    return F.transform(F.slice(texts(retrieved), 1, k), lambda d: F.when(F.coalesce(F.array_contains(e, d), F.lit(False)), 1.0).otherwise(0.0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def discounts(k: int) -> list[float]:
    """1 / log2(rank + 1) of ranks 1..k, computed once on the driver."""
    return [1.0 / math.log2(i + 1) for i in range(1, k + 1)]


def doubles(values: list[float]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def dcg(gains: Column, k: int) -> Column:
    """Discounted sum of at most k gains."""
    return total(F.zip_with(gains, F.slice(doubles(discounts(k)), F.lit(1), F.size(gains)), lambda g, d: g * d))


def shared(retrieved: Column, expected: Column, k: int) -> Column:
    """Number of distinct expected documents among the first k."""
    return F.size(F.array_intersect(F.slice(texts(retrieved), 1, k), texts(expected)))


@dataclass(frozen=True)
class Metric:
    """A metric at cutoff k. ``column`` builds its value for one query; ``grades`` is a map from id to grade."""

    k: int

    key = "metric"

    def __post_init__(self) -> None:
        object.__setattr__(self, "k", require_positive(self.k, "k"))

    @property
    def name(self) -> str:
        return f"{self.key}@{self.k}"

    @property
    def alias(self) -> str:
        return self.name.replace("@", "_at_").replace("(", "_").replace(")", "").replace("=", "_").replace(".", "_")

    def top_k(self, retrieved: Column) -> Column:
        return F.slice(texts(retrieved), 1, self.k)

    def of_flags(self, rel: Column, found: Column, gold: Column) -> Column:
        """From the flags (1.0 or 0.0) of the first k or fewer, the number of distinct relevant ones, and that of gold documents."""
        raise NotImplementedError

    def column(self, retrieved: Column, expected: Column) -> Column:
        return self.of_flags(flags(retrieved, expected, self.k), shared(retrieved, expected, self.k), F.size(F.array_distinct(texts(expected))))

    def score_query(self, retrieved_doc_ids: Sequence[str], expected_answers: Collection[str]) -> float:
        """The value of one list at hand, by the same expression as in a plan."""
        return self._of_lists([retrieved_doc_ids], [expected_answers])[0]

    def _of_lists(self, retrieved: Sequence[Sequence[str]], expected: Sequence[Collection[str]]) -> list[float]:
        rows = [(i, list(r), list(e)) for i, (r, e) in enumerate(zip(retrieved, expected, strict=True))]
        frame = SparkSession.builder.getOrCreate().createDataFrame(rows, "i int, retrieved array<string>, expected array<string>")
        return [r["value"] for r in frame.select("i", self.column(F.col("retrieved"), F.col("expected")).alias("value")).orderBy("i").collect()]

    def score(self, labelled: DataFrame | Sequence[Sequence[str]], retrieved: str | Sequence[Collection[str]] = "retrieved", expected: str = "expected") -> DataFrame | float:
        """The mean over all queries, 0.0 without any: one row (score) of a frame, a number of two lists of lists.

        Lists leave a log record with the figures of the batch.
        """
        if not isinstance(labelled, DataFrame):
            if isinstance(retrieved, str) or len(labelled) != len(retrieved):
                raise ValidationError("as many lists of expected texts as of retrieved ones are needed")
            values = self._of_lists(labelled, retrieved) if labelled else []
            mean = sum(values) / len(values) if values else 0.0
            sizes = [len(r) for r in labelled]
            figures = {"metric": self.name, "queries": len(values), "score": mean, "avg_retrieved_count": round(sum(sizes) / len(sizes), 2) if sizes else 0.0}
            figures |= {"empty_retrieved_queries": sizes.count(0), "empty_expected_queries": sum(not e for e in retrieved)}
            log.info("metric of a batch", extra=figures)
            return mean
        return labelled.agg(F.coalesce(F.avg(self.column(F.col(retrieved), F.col(expected))), F.lit(0.0)).alias("score"))


class HitRate(Metric):
    key = "hit_rate"

    def of_flags(self, rel: Column, found: Column, gold: Column) -> Column:
        return F.when(found > 0, 1.0).otherwise(0.0)


class Recall(Metric):
    key = "recall"

    def of_flags(self, rel: Column, found: Column, gold: Column) -> Column:
        return F.when(gold > 0, found / F.nullif(gold, F.lit(0))).otherwise(0.0)


class Precision(Metric):
    key = "precision"

    def of_flags(self, rel: Column, found: Column, gold: Column) -> Column:
        return found / F.lit(float(self.k))


class MRR(Metric):
    key = "mrr"

    def of_flags(self, rel: Column, found: Column, gold: Column) -> Column:
        at = F.array_position(rel, F.lit(1.0))
        return F.when(at > 0, F.lit(1.0) / F.nullif(at, F.lit(0))).otherwise(0.0)


class NDCG(Metric):
    key = "ndcg"

    def of_flags(self, rel: Column, found: Column, gold: Column) -> Column:
        sums, ideal = 0.0, [0.0]
        for d in discounts(self.k):
            sums += d
            ideal.append(sums)
        best = F.get(doubles(ideal), F.least(F.lit(self.k), gold).cast("int"))
        return F.when(best > 0, unit(dcg(rel, self.k) / F.nullif(best, F.lit(0.0)))).otherwise(0.0)

    def graded(self, retrieved: Column, grades: Column) -> Column:
        """With gains from a map of grades; grades of 0 or less are no gain."""
        gain = lambda d: F.greatest(F.coalesce(F.try_element_at(grades, d).cast("double"), F.lit(0.0)), F.lit(0.0))
        ranked = F.sort_array(F.filter(F.transform(F.map_values(grades), lambda g: g.cast("double")), lambda g: g > 0), asc=False)
        best = dcg(F.slice(ranked, 1, self.k), self.k)
        return F.coalesce(unit(dcg(F.transform(self.top_k(retrieved), gain), self.k) / F.nullif(best, F.lit(0.0))), F.lit(0.0))


class AveragePrecision(Metric):
    key = "average_precision"

    def of_flags(self, rel: Column, found: Column, gold: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("rank"), F.lit(0.0).alias("hits"), F.lit(0.0).alias("sum"))

        def step(s: Column, f: Column) -> Column:
            rank, hits = s["rank"] + 1.0, s["hits"] + f
            return F.struct(rank.alias("rank"), hits.alias("hits"), (s["sum"] + f * hits / rank).alias("sum"))

        summed = F.aggregate(rel, zero, step, lambda s: s["sum"])
        return F.when(gold > 0, unit(summed / F.nullif(gold, F.lit(0)))).otherwise(0.0)


@dataclass(frozen=True)
class ERR(Metric):
    max_grade: int = 4

    key = "err"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.max_grade < 1:
            raise ValueError("max_grade must be at least 1")

    @property
    def name(self) -> str:
        return f"err@{self.k}" if self.max_grade == 4 else f"err(max_grade={self.max_grade})@{self.k}"

    def of_grades(self, ranked: Column) -> Column:
        """From the grades (double) of the first k; the cascade ends once it falls below 1e-10."""
        top = float(2**self.max_grade)
        zero = F.struct(F.lit(0.0).alias("rank"), F.lit(1.0).alias("cascade"), F.lit(0.0).alias("sum"))

        def step(s: Column, g: Column) -> Column:
            rank = s["rank"] + 1.0
            r = (F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.least(F.lit(float(self.max_grade)), g))) - 1.0) / top
            gone = s["cascade"] < 1e-10
            return F.struct(rank.alias("rank"), F.when(gone, s["cascade"]).otherwise(s["cascade"] * (F.lit(1.0) - r)).alias("cascade"), F.when(gone, s["sum"]).otherwise(s["sum"] + s["cascade"] * r / rank).alias("sum"))

        return unit(F.aggregate(ranked, zero, step, lambda s: s["sum"]))

    def of_flags(self, rel: Column, found: Column, gold: Column) -> Column:
        return self.of_grades(rel)

    def graded(self, retrieved: Column, grades: Column) -> Column:
        return self.of_grades(F.transform(self.top_k(retrieved), lambda d: F.coalesce(F.try_element_at(grades, d).cast("double"), F.lit(0.0))))


@dataclass(frozen=True)
class RBP(Metric):
    p: float = 0.8

    key = "rbp"

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 0.0 < self.p < 1.0:
            raise ValueError("p must lie strictly between 0 and 1")

    @property
    def name(self) -> str:
        return f"rbp@{self.k}" if self.p == 0.8 else f"rbp(p={self.p})@{self.k}"

    @property
    def expected_search_depth(self) -> float:
        return 1.0 / (1.0 - self.p)

    def residual(self, n_retrieved: Column) -> Column:
        """Weight of the ranks that were not seen."""
        return F.pow(F.lit(self.p), F.least(F.lit(self.k), n_retrieved))

    def of_gains(self, gains: Column) -> Column:
        weights = doubles([self.p**i for i in range(self.k)])
        return unit(F.lit(1.0 - self.p) * total(F.zip_with(gains, F.slice(weights, F.lit(1), F.size(gains)), lambda g, w: g * w)))

    def of_flags(self, rel: Column, found: Column, gold: Column) -> Column:
        return self.of_gains(rel)

    def graded(self, retrieved: Column, grades: Column) -> Column:
        """Grades over the greatest grade of the whole map, if that is above 1."""
        greatest = F.coalesce(F.array_max(F.map_values(grades)).cast("double"), F.lit(1.0))
        scale = F.when(greatest > 1, greatest).otherwise(F.lit(1.0))
        return self.of_gains(F.transform(self.top_k(retrieved), lambda d: F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(grades, d).cast("double"), F.lit(0.0)) / scale)))


def check_metrics(metrics: list[Metric]) -> list[Metric]:
    if not metrics:
        raise ValidationError("at least one metric is needed")
    twice = repeated(m.name for m in metrics)
    if twice:
        raise ValidationError(f"metric names must be unique, repeated: {sorted(twice)}")
    return metrics


def precision_at_rank(retrieved: Column, expected: Column, rank: int) -> Column:
    """Share of relevant entries (repeated ones counted) in the first ``rank``; 0 beyond the list."""
    found = total(flags(retrieved, expected, rank))
    return F.when(F.size(texts(retrieved)) >= rank, found / F.lit(float(rank))).otherwise(0.0)


def flagged(labelled: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, rel, fresh, gold): per query the flags of the first k, those of first occurrences, the number of gold documents.

    Whatever the number of metrics and cutoffs, a list meets its gold documents once.
    """
    r, e = F.slice(texts(F.col("retrieved")), 1, k), F.col("expected")
    rows = labelled.select(*keep, r.alias("r"), flags(F.col("retrieved"), e, k).alias("rel"), F.size(F.array_distinct(texts(e))).alias("gold"))
    first = F.zip_with("rel", F.transform("r", lambda d, i: F.when(F.coalesce(F.array_position("r", d) == i + 1, F.lit(True)), 1.0).otherwise(0.0)), lambda a, b: a * b)
    return rows.select(*keep, "rel", first.alias("fresh"), "gold")


def scored(flags_: DataFrame, metrics: list[Metric], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a query of ``flagged`` with one column a metric."""

    def one(m: Metric) -> Column:
        return m.of_flags(F.slice("rel", 1, m.k), total(F.slice("fresh", 1, m.k)), F.col("gold")).alias(m.alias)

    return flags_.select(*keep, *(one(m) for m in check_metrics(metrics)))


def per_query(labelled: DataFrame, metrics: list[Metric], keep: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One row a query with one column a metric."""
    return scored(flagged(labelled, max(m.k for m in check_metrics(metrics)), keep), metrics, keep)


def summary(labelled: DataFrame, metrics: list[Metric]) -> DataFrame:
    """(metric, score, query_count) of all metrics from a single aggregation pass."""
    return summary_of_flags(flagged(labelled, max(m.k for m in check_metrics(metrics))), metrics)


def summary_of_flags(flags_: DataFrame, metrics: list[Metric]) -> DataFrame:
    """``summary`` from the rows of ``flagged``, or rows like them that were made without lists of gold documents."""
    row = scored(flags_, metrics).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(m.alias), F.lit(0.0)).alias(m.alias) for m in metrics))
    pairs = F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), F.col(m.alias).alias("score")) for m in metrics)))
    return row.select("n", pairs.alias("s")).select("s.metric", "s.score", F.col("n").alias("query_count"))


def diagnostics(labelled: DataFrame) -> DataFrame:
    """Batch figures: queries, mean list length (2 digits), queries without results, queries without gold."""
    r, e = F.size(texts(F.col("retrieved"))), F.size(texts(F.col("expected")))
    return labelled.agg(
        F.count("*").alias("query_count"),
        F.round(F.coalesce(F.avg(r), F.lit(0.0)), 2).alias("avg_retrieved_count"),
        F.count_if(r == 0).alias("empty_retrieved_queries"),
        F.count_if(e == 0).alias("empty_expected_queries"),
    )
