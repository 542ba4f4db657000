"""Exact top-k retrieval by blocks of queries, and the bridge to outside retrievers.

A block of queries goes to every executor, the corpus is scored against it an Arrow batch at a time (vectors by one
matrix product, texts by summed rows of a token table), and a task keeps the k best of its whole partition for each
query, so tasks x k rows a query are ranked at the end and the corpus is neither shuffled nor joined. The queries are
fetched by blocks, so the driver holds one. A join on tokens instead would shuffle every pair that shares a frequent
word: it took three times as long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from metrikon.functions.text import tokens
from metrikon.schema import RUN, ValidationError, require_positive

METRICS = ("cosine", "dot", "l2")
Scorer = Callable[[pd.DataFrame], np.ndarray]


def rank_run(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best scores of each query, equal scores by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col(id_col).alias("doc_id"), "score")


class _Kept:
    """The k best rows of each query so far, equal scores by id."""

    def __init__(self, k: int, names: np.ndarray, exclude_self: bool) -> None:
        self.k, self.names, self.exclude_self = k, names, exclude_self
        self.scores = np.full((len(names), 0), -np.inf)
        self.ids = np.empty((len(names), 0), dtype=object)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each id and a column for each query."""
        found = np.where(np.isfinite(scores), scores, -np.inf).T
        if self.exclude_self:
            place = {name: j for j, name in enumerate(self.names.tolist())}
            for r, i in enumerate(ids.tolist()):
                if i in place:
                    found[place[i], r] = -np.inf
        k = min(self.k, found.shape[1])
        # Whatever ties with the k-th best may still come in by its id, so it is kept until ids are compared.
        edge = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k, None]
        most = int((found >= edge).sum(axis=1).max())
        if most > found.shape[1] // 2:
            pick = np.broadcast_to(np.arange(found.shape[1]), found.shape)
        else:
            pick = np.argpartition(-found, most - 1, axis=1)[:, :most]
        scores = np.concatenate((self.scores, np.take_along_axis(found, pick, axis=1)), axis=1)
        names = np.concatenate((self.ids, ids.astype(object)[pick]), axis=1)
        rank = np.empty(names.shape, dtype=np.int64)
        _, rank.ravel()[:] = np.unique(names.ravel(), return_inverse=True)
        order = np.lexsort((rank, -scores), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(names, order, axis=1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that is kept."""
        q, r = np.nonzero(np.isfinite(self.scores))
        return self.names[q], self.ids[q, r], self.scores[q, r]


def _blocks(rows: DataFrame, block: int) -> Iterator[list[tuple]]:
    """The rows as lists of at most ``block``, fetched partition by partition."""
    held: list[tuple] = []
    for r in rows.toLocalIterator():
        held.append(tuple(r))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def _by_blocks(rows: DataFrame, asked: DataFrame, scorer: Callable[[list[tuple]], Scorer], k: int, block: int, exclude_self: bool) -> DataFrame:
    """The run of ``asked`` (query_id, what to score by) over ``rows`` with a column doc_id, scores rounded at the end."""
    types = asked.schema[0].dataType, rows.schema["doc_id"].dataType, T.DoubleType()
    schema = T.StructType([T.StructField(c, t) for c, t in zip(("query_id", "doc_id", "score"), types, strict=True)])

    def best_of(some: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Kept(k, np.array([q[0] for q in some], dtype=object), exclude_self)
            score = scorer(some)
            for b in batches:
                if len(b):
                    best.add(score(b), b["doc_id"].to_numpy())
            q, d, found = best.rows()
            yield pd.DataFrame({"query_id": q, "doc_id": d, "score": found})

        return rows.mapInPandas(run, schema)

    parts = [best_of(some) for some in _blocks(asked, block)] or [rows.sparkSession.createDataFrame([], schema)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rank_run(out, k).withColumn("score", F.round("score", 6))


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096, exclude_self: bool = False) -> DataFrame:
    """The k nearest vectors of each query, exactly: (query_id, rank, doc_id, score), ranked by the scores as they are and
    rounded to 6 digits on output.

    Both frames have ``id_col`` and ``vector_col``; the stated queries go through the driver by blocks, the corpus stays
    where it is. For ``l2`` the score is the negative distance. Null vectors and ids, and for cosine zero
    vectors, are never found; equal scores rank by id; an empty corpus or query set gives an empty run.
    """
    require_positive(k, "k")
    if metric not in METRICS:
        raise ValidationError(f"metric must be one of {METRICS}")

    def scorer(some: list[tuple]) -> Scorer:
        q = np.array([v for _, v in some], dtype=np.float64)

        def score(b: pd.DataFrame) -> np.ndarray:
            d = np.stack([np.asarray(v, dtype=np.float64) for v in b["vector"]])
            with np.errstate(divide="ignore", invalid="ignore"):
                if metric == "l2":
                    return -np.sqrt(np.maximum((d**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * (d @ q.T), 0))
                found = d @ q.T
                return found / (np.linalg.norm(d, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]) if metric == "cosine" else found

        return score

    asked = queries.select(id_col, vector_col).where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).distinct()
    rows = corpus.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("vector")).where("doc_id IS NOT NULL AND vector IS NOT NULL")
    return _by_blocks(rows, asked, scorer, k, block, exclude_self)


def lexical_topk(corpus: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query_text", id_col: str = "doc_id", text_col: str = "text", block: int = 2048, cells: int = 4_000_000) -> DataFrame:
    """The k texts with the largest share of each query's distinct tokens; texts without a shared token are not found.

    A query without tokens finds nothing; null texts and ids are left out; equal shares rank by id. About ``cells``
    values are summed at once.
    """
    require_positive(k, "k")
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens(F.col(query_text))).alias("t")).where("query_id IS NOT NULL AND size(t) > 0").distinct()

    def scorer(some: list[tuple]) -> Scorer:
        known = pd.Index(sorted({t for _, ts in some for t in ts}))
        has = np.zeros((len(known), len(some)), dtype=np.int16)
        for j, (_, ts) in enumerate(some):
            has[known.get_indexer(ts), j] = 1
        size = np.array([len(ts) for _, ts in some], dtype=np.float64)

        def score(b: pd.DataFrame) -> np.ndarray:
            sizes = b["tokens"].map(len).to_numpy()
            at = known.get_indexer(np.concatenate(b["tokens"].to_list()) if sizes.sum() else [])
            row = np.repeat(np.arange(len(b)), sizes)[at >= 0]
            at = at[at >= 0]
            out = np.full((len(b), len(some)), -np.inf)
            step = max(1, cells // len(some))
            first = 0
            while first < len(row):
                stop = min(first + step, len(row))
                if stop < len(row):  # whole texts only
                    stop = int(np.searchsorted(row, row[stop], "left")) if row[stop] > row[first] else int(np.searchsorted(row, row[first], "right"))
                here = row[first:stop]
                starts = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
                shared = np.add.reduceat(has[at[first:stop]], starts, axis=0, dtype=np.int32)
                out[here[starts]] = np.where(shared > 0, shared / size, -np.inf)
                first = stop
            return out

        return score

    rows = corpus.select(F.col(id_col).alias("doc_id"), F.array_distinct(tokens(F.col(text_col))).alias("tokens")).where("doc_id IS NOT NULL AND tokens IS NOT NULL")
    return _by_blocks(rows, asked, scorer, k, block, False)


def external_run(queries: DataFrame, retrieve: Callable[[str, int], Iterable[tuple[str, float, dict[str, str]]]], k: int) -> DataFrame:
    """RUN rows from an outside retriever: ``retrieve(text, k)`` gives (doc_id, score, metadata) in rank order.

    Called once a query on the executors; blank queries are an error, as is a hit without an id.
    """
    require_positive(k, "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, text in zip(b["query_id"], b["query_text"], strict=True):
                if text is None or not text.strip():
                    raise ValidationError("query must not be blank")
                for rank, (doc, score, metadata) in enumerate(list(retrieve(text.strip(), k))[:k], 1):
                    if doc is None or not str(doc).strip():
                        raise ValidationError("a hit has no id")
                    rows.append((q, rank, str(doc), float(score), {a: str(v) for a, v in (metadata or {}).items()}))
            yield pd.DataFrame(rows, columns=RUN.names)

    return queries.select("query_id", "query_text").mapInPandas(run, RUN)
