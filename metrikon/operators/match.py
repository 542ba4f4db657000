"""Relevance matching: gold ids, candidate labels, judged contexts, greedy assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrikon.functions.text import norm, strip

# Metadata keys that may hold a result's text, in order of preference.
TEXT_KEYS = ("text", "document", "content", "page_content", "chunk", "passage")


def norm_ids(a: Column) -> Column:
    """Normalised ids, blank ones dropped, each once; a null array gives an empty one."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(a, norm), lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def ranked_lists(run: DataFrame, max_k: int | None = None) -> DataFrame:
    """(query_id, retrieved): doc ids in rank order, a row delivered twice once. A cutoff goes before the shuffle and bounds the arrays."""
    rows = run if max_k is None else run.where(F.col("rank") <= max_k)
    pairs = rows.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("rank", "doc_id"))).alias("r"))
    return pairs.select("query_id", F.col("r.doc_id").alias("retrieved"))


def label_by_ids(queries: DataFrame, run: DataFrame, max_k: int | None = None) -> DataFrame:
    """(query_id, retrieved, expected) for every query, ids normalised on both sides.

    Left from queries: one without results has an empty list and stays. A null doc id keeps its rank as null.
    """
    q = queries.select("query_id", norm_ids(F.col("expected_doc_ids")).alias("expected"))
    r = ranked_lists(run.withColumn("doc_id", norm(F.col("doc_id"))), max_k)
    return q.join(r, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))


def corpus_texts(documents: DataFrame) -> DataFrame:
    """(doc_key, corpus_text): the last document of each normalised id by ``doc_pos``, blank texts left out."""
    d = documents.where(strip(F.col("text")) != "").select(norm(F.col("doc_id")).alias("doc_key"), "text", "doc_pos")
    return d.groupBy("doc_key").agg(F.max_by("text", "doc_pos").alias("corpus_text"))


def candidate_labels(run: DataFrame, documents: DataFrame | None = None, include_doc_id: bool = True) -> DataFrame:
    """``run`` with ``candidates``: the distinct normalised texts a result can be matched by.

    First the id (never dropped unless ``include_doc_id`` is off), then the corpus text of that id, then the
    metadata texts. A numeric id can lie within an expected answer by accident; the option is there for that.
    """
    keyed = run.withColumn("doc_key", norm(F.col("doc_id")))
    if documents is not None:
        keyed = keyed.join(corpus_texts(documents), "doc_key", "left")
    else:
        keyed = keyed.withColumn("corpus_text", F.lit(None).cast("string"))
    parts = [F.col("doc_key")] if include_doc_id else []
    parts.append(norm(F.col("corpus_text")))
    if "metadata" in run.columns:
        parts += [norm(F.try_element_at("metadata", F.lit(k))) for k in TEXT_KEYS]
    out = F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))
    return keyed.withColumn("candidates", out).drop("doc_key", "corpus_text")


def contexts(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, rank, label_pos, cand_pos, query, expected_text, retrieved_text): results x labels x candidates of a query."""
    labels = queries.select("query_id", F.col("query_text").alias("query"), F.posexplode(norm_ids(F.col("expected_answers"))).alias("label_pos", "expected_text"))
    found = candidates.select("query_id", "rank", F.posexplode("candidates").alias("cand_pos", "retrieved_text"))
    return found.join(labels, "query_id").select("query_id", "rank", "label_pos", "cand_pos", "query", "expected_text", "retrieved_text")


def assign_labels(per_rank: Column) -> Column:
    """Greedy assignment in rank order: each result takes its first label (position) that is still free, else -1.

    ``per_rank`` is an array, by rank, of the sorted positions of the labels that match there.
    """
    none = F.array().cast("array<int>")
    zero = F.struct(none.alias("used"), none.alias("out"))

    def step(s: Column, options: Column) -> Column:
        first = F.coalesce(F.get(F.array_except(options, s["used"]), F.lit(0)), F.lit(-1))
        used = F.when(first >= 0, F.array_append(s["used"], first)).otherwise(s["used"])
        return F.struct(used.alias("used"), F.array_append(s["out"], first).alias("out"))

    return F.aggregate(per_rank, zero, step, lambda s: s["out"])


def label_by_judge(queries: DataFrame, candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, retrieved, expected) from ``judged`` contexts (query_id, rank, label_pos, relevant).

    A result that takes a label appears as that label, any other as a name of its own that matches nothing, so
    a second result for a label already taken is a miss.
    """
    hits = judged.where("relevant").groupBy("query_id", "rank").agg(F.array_sort(F.collect_set(F.col("label_pos").cast("int"))).alias("labels"))
    none = F.array().cast("array<int>")
    every = candidates.select("query_id", "rank", F.get("candidates", F.lit(0)).alias("name")).join(hits, ["query_id", "rank"], "left")
    lists = every.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("labels", none).alias("labels"), "name"))).alias("r"))
    q = queries.select("query_id", norm_ids(F.col("expected_answers")).alias("expected"))
    taken = q.join(lists, "query_id", "left").withColumn("taken", F.coalesce(assign_labels(F.col("r.labels")), none))
    named = F.transform("taken", lambda t, i: F.when(t >= 0, F.get("expected", t)).otherwise(F.concat(F.lit("retrieved_"), i.cast("string"), F.lit(":"), F.coalesce(F.get("r", i)["name"], F.lit("")))))
    return taken.select("query_id", named.alias("retrieved"), "expected")
