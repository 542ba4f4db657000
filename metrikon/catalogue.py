"""Queries of the core operators with the SQL that DuckDB runs beside them. Each query takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrikon import catalogue_folds as folds
from metrikon import catalogue_sql as s
from metrikon import catalogue_text
from metrikon.functions import metrics as m
from metrikon.functions import text
from metrikon.operators import judges, match, references, retrieve
from metrikon.plans import evaluate
from metrikon.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = references.dataset_references(read(spark, d, "query_examples"), read(spark, d, "retrieval_results"))
    return references.orphan_references(refs, read(spark, d, "document_examples"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


@query
def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, d))


_P2 = r"""
WITH k AS (SELECT nullif(lower(regexp_replace(doc_id, '^[\s\p{Z}\x{85}\x1c-\x1f]+|[\s\p{Z}\x{85}\x1c-\x1f]+$', '', 'g')), '') AS key, added_at, deleted_at FROM document_examples),
refs AS (
  SELECT 'query_examples' AS ref_table, query_id AS ref_id, unnest(expected_doc_ids) AS raw, created_at AS seen FROM query_examples
  UNION ALL SELECT 'retrieval_results', CAST(result_id AS VARCHAR), doc_id, retrieved_at FROM retrieval_results),
r AS (SELECT DISTINCT ref_table, ref_id, seen, nullif(lower(regexp_replace(raw, '^[\s\p{Z}\x{85}\x1c-\x1f]+|[\s\p{Z}\x{85}\x1c-\x1f]+$', '', 'g')), '') AS key FROM refs),
j AS (SELECT r.ref_table, r.ref_id, r.key, r.seen, count(k.key) AS rows_,
        coalesce(bool_or(k.added_at <= r.seen), false) AS began,
        coalesce(bool_or(k.added_at <= r.seen AND (k.deleted_at IS NULL OR r.seen < k.deleted_at)), false) AS there
      FROM r LEFT JOIN k ON k.key = r.key WHERE r.key IS NOT NULL GROUP BY ALL),
o AS (SELECT DISTINCT ref_table, ref_id, key AS doc_id, CASE WHEN rows_ = 0 THEN 'missing' WHEN began THEN 'deleted' ELSE 'later' END AS reason, strftime(seen, '%Y-%m') AS period
      FROM j WHERE NOT there)
"""
SQL["p2_found"] = _P2 + "SELECT ref_table, ref_id, doc_id, reason, period FROM o"
SQL["p2_counts"] = _P2 + "SELECT ref_table, period, reason, count(*) AS orphans FROM o GROUP BY ALL"


# Retrieval over vectors: every id divisible by 100 is a query against all others.
METRICS10 = [m.HitRate(10), m.Recall(10), m.Precision(10), m.MRR(10), m.NDCG(10), m.AveragePrecision(10), m.ERR(10), m.RBP(10)]


def _vector_run(spark: SparkSession, d: str, metric: str = "cosine", where: str = "true") -> DataFrame:
    v = read(spark, d, "embeddings")
    return retrieve.vector_topk(v.where(where), v.where("vec_id % 100 = 0"), 10, metric, exclude_self=True)


def _vector_labelled(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", "label")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = queries.join(v, "label").where("vec_id <> query_id").groupBy("query_id").agg(F.collect_list(F.col("vec_id").cast("string")).alias("expected"))
    lists = match.ranked_lists(_vector_run(spark, d)).withColumn("retrieved", F.transform("retrieved", lambda x: x.cast("string")))
    return queries.select("query_id").join(lists, "query_id", "left").join(gold, "query_id", "left")


def _vector_flagged(spark: SparkSession, d: str) -> DataFrame:
    """As ``flagged``: a hit is relevant by its label, and a label's documents are counted, not listed."""
    v = read(spark, d, "embeddings").select("vec_id", "label")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("gold"))
    hits = _vector_run(spark, d).join(v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("found")), "doc_id")
    rel = hits.join(queries, "query_id").select("query_id", F.struct("rank", F.when(F.col("found") == F.col("label"), 1.0).otherwise(0.0).alias("rel")).alias("h"))
    lists = rel.groupBy("query_id").agg(F.array_sort(F.collect_list("h"))["rel"].alias("rel"))
    none = F.array().cast("array<double>")
    out = queries.join(sizes, "label", "left").join(lists, "query_id", "left").withColumn("rel", F.coalesce("rel", none))
    return out.select("query_id", "rel", F.col("rel").alias("fresh"), F.coalesce("gold", F.lit(0)).cast("int").alias("gold"))


def _vector_graded(spark: SparkSession, d: str) -> DataFrame:
    grade = F.transform("expected", lambda x: F.struct(x.alias("key"), (F.lit(1) + x.cast("long") % 4).cast("double").alias("value")))
    return _vector_labelled(spark, d).withColumn("grades", F.coalesce(F.map_from_entries(grade), F.create_map().cast("map<string,double>")))


def _six(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


for _name, _metric in (("cosine", "cosine"), ("dot", "dot"), ("l2", "l2")):

    def _topk(spark: SparkSession, d: str, metric: str = _metric) -> DataFrame:
        return _vector_run(spark, d, metric)

    QUERIES[f"vector_topk_{_name}"] = _topk


@query
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _vector_run(spark, d, where="label < 5")


_RUN = "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc AS doc_id, score FROM run"
SQL["vector_topk_cosine"] = f"WITH {s.vectors()} {_RUN}"
SQL["vector_topk_dot"] = f"WITH {s.vectors('list_inner_product(a.e, b.e)')} {_RUN}"
SQL["vector_topk_l2"] = f"WITH {s.vectors('-list_distance(a.e, b.e)')} {_RUN}"
SQL["vector_topk_filtered"] = f"WITH {s.vectors(where='b.label < 5')} {_RUN}"


@query
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return retrieve.lexical_topk(read(spark, d, "documents"), items, 10)


SQL["lexical_topk"] = f"""
WITH q AS (SELECT item_id AS query_id, list_distinct({s.toks('text')}) AS t FROM benchmark), qt AS (SELECT query_id, len(t) AS n, unnest(t) AS tok FROM q),
dt AS (SELECT doc_id, unnest(list_distinct({s.toks('text')})) AS tok FROM documents),
sc AS (SELECT query_id, doc_id, round(count(*) / any_value(n), 6) AS score FROM qt JOIN dt USING (tok) GROUP BY query_id, doc_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc QUALIFY rank <= 10"""

for _m in METRICS10:

    def _per_query(spark: SparkSession, d: str, metric: m.Metric = _m) -> DataFrame:
        return m.scored(_vector_flagged(spark, d), [metric], ("query_id",)).select("query_id", _six(F.col(metric.alias)).alias("value"))

    QUERIES[f"{_m.key}_at_k"] = _per_query
    SQL[f"{_m.key}_at_k"] = f"WITH {s.vectors()}, {s.metrics(10)} SELECT query_id, round({s.NAMES[_m.key]}, 6) AS value FROM m"


@query
def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return m.summary_of_flags(_vector_flagged(spark, d), METRICS10).withColumn("score", _six(F.col("score")))


def _summary_sql(k: int) -> str:
    return " UNION ALL ".join(f"SELECT '{key}@{k}' AS metric, round(avg({c}), 6) AS score, count(*) AS query_count FROM m" for key, c in s.NAMES.items())


SQL["metrics_summary"] = f"WITH {s.vectors()}, {s.metrics(10)} {_summary_sql(10)}"


def _runs_labelled(spark: SparkSession, d: str, max_k: int | None = None) -> DataFrame:
    """Every (run, query) with its list, up to ``max_k`` if no metric looks further, and gold ids; rows delivered twice once."""
    gold = read(spark, d, "query_examples").select("query_id", match.norm_ids(F.col("expected_doc_ids")).alias("expected")).dropDuplicates(["query_id"])
    rows = read(spark, d, "retrieval_results").select("run_id", "retriever", "query_id", F.struct("rank", text.norm(F.col("doc_id")).alias("doc_id")).alias("h"))
    rows = rows if max_k is None else rows.where(F.col("h.rank") <= max_k)
    lists = rows.groupBy("run_id", "retriever", "query_id").agg(F.array_sort(F.collect_set("h"))["doc_id"].alias("retrieved"))
    return lists.join(gold, "query_id", "left")


@query
def metrics_by_retriever(spark: SparkSession, d: str) -> DataFrame:
    scored = m.per_query(_runs_labelled(spark, d, 10), METRICS10, keep=("retriever",))
    return scored.groupBy("retriever").agg(F.count("*").alias("queries"), *(_six(F.avg(x.alias)).alias(x.key) for x in METRICS10))


SQL["metrics_by_retriever"] = f"WITH {s.RUNS}, {s.metrics(10)} SELECT retriever, count(*) AS queries, {', '.join(f'round(avg({c}), 6) AS {k}' for k, c in s.NAMES.items())} FROM m GROUP BY retriever"


@query
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by retriever and run with totals; nulls mark the totals."""
    some = [m.Recall(5), m.NDCG(5)]
    scored = m.per_query(_runs_labelled(spark, d, 5), some, keep=("retriever", "run_id"))
    return scored.rollup("retriever", "run_id").agg(F.count("*").alias("queries"), *(_six(F.avg(x.alias)).alias(x.key) for x in some))


SQL["metrics_rollup"] = f"WITH {s.RUNS}, {s.metrics(5)} SELECT retriever, run_id, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY ROLLUP (retriever, run_id)"


@query
def metrics_multi_k(spark: SparkSession, d: str) -> DataFrame:
    every = [kind(k) for k in (1, 3, 5, 10) for kind in (m.HitRate, m.Recall, m.Precision, m.MRR, m.NDCG, m.AveragePrecision, m.ERR, m.RBP)]
    return m.summary(_runs_labelled(spark, d, 10), every).withColumn("score", _six(F.col("score")))


SQL["metrics_multi_k"] = " UNION ALL ".join(f"SELECT * FROM (WITH {s.RUNS}, {s.metrics(k)} {_summary_sql(k)})" for k in (1, 3, 5, 10))


@query
def metric_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return m.diagnostics(_runs_labelled(spark, d))


SQL["metric_diagnostics"] = (
    f"WITH {s.RUNS}, {s.metrics(1000)} SELECT count(*) AS query_count, round(avg(got), 2) AS avg_retrieved_count, count_if(got = 0) AS empty_retrieved_queries, count_if(n = 0) AS empty_expected_queries FROM m"
)


@query
def metrics_with_empty_gold(spark: SparkSession, d: str) -> DataFrame:
    rows = m.per_query(_runs_labelled(spark, d).where(F.size(m.texts(F.col("expected"))) == 0), METRICS10, keep=("run_id", "query_id"))
    return rows.groupBy("run_id").agg(F.count("*").alias("queries"), *(F.max(x.alias).alias(x.key) for x in METRICS10))


SQL["metrics_with_empty_gold"] = f"WITH {s.RUNS}, {s.metrics(10)} SELECT run_id, count(*) AS queries, {', '.join(f'max({c}::DOUBLE) AS {k}' for k, c in s.NAMES.items())} FROM m WHERE n = 0 GROUP BY run_id"


@query
def metrics_duplicate_hits(spark: SparkSession, d: str) -> DataFrame:
    """Lists that hold a relevant document more than once: set metrics count it once, ranked ones each time."""
    rows = _runs_labelled(spark, d).where(F.size("retrieved") > F.size(F.array_distinct("retrieved")))
    return m.per_query(rows, METRICS10, keep=("run_id", "query_id")).select("run_id", "query_id", *(_six(F.col(x.alias)).alias(x.key) for x in METRICS10))


SQL["metrics_duplicate_hits"] = f"""WITH {s.RUNS}, {s.metrics(10)}, dup AS (SELECT query_id FROM run GROUP BY query_id HAVING count(*) > count(DISTINCT coalesce(doc, chr(1))))
SELECT run_id, qid AS query_id, {', '.join(f'round({c}, 6) AS {k}' for k, c in s.NAMES.items())} FROM m WHERE query_id IN (FROM dup)"""


@query
def err_graded(spark: SparkSession, d: str) -> DataFrame:
    return _vector_graded(spark, d).select("query_id", _six(m.ERR(10).graded(F.col("retrieved"), F.col("grades"))).alias("value"))


@query
def rbp_graded(spark: SparkSession, d: str) -> DataFrame:
    return _vector_graded(spark, d).select("query_id", _six(m.RBP(10).graded(F.col("retrieved"), F.col("grades"))).alias("value"))


@query
def ndcg_graded(spark: SparkSession, d: str) -> DataFrame:
    return _vector_graded(spark, d).select("query_id", _six(m.NDCG(10).graded(F.col("retrieved"), F.col("grades"))).alias("value"))


_GRADED = f"""WITH {s.vectors()}, gr AS (SELECT r.query_id, r.rank, coalesce(g.grade, 0) AS grade FROM run r LEFT JOIN gold g ON g.query_id = r.query_id AND g.doc = r.doc),
mx AS (SELECT query_id, max(grade) AS top, list(grade ORDER BY grade DESC) AS all_ FROM gold GROUP BY query_id)"""
SQL["err_graded"] = _GRADED + """, c AS (SELECT *, coalesce(exp(sum(ln(1 - (pow(2, grade) - 1) / 16)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS cas FROM gr)
SELECT query_id, round(sum(cas * (pow(2, grade) - 1) / 16 / rank), 6) AS value FROM c GROUP BY query_id"""
SQL["rbp_graded"] = _GRADED + " SELECT query_id, round(sum(0.2 * pow(0.8, rank - 1) * grade / CASE WHEN top > 1 THEN top ELSE 1 END), 6) AS value FROM gr JOIN mx USING (query_id) GROUP BY query_id"
SQL["ndcg_graded"] = _GRADED + """, ideal AS (SELECT query_id, list_sum(list_transform(range(1, least(10, len(all_)) + 1), lambda i: all_[i] / log2(i + 1))) AS best FROM mx)
SELECT query_id, round(sum(grade / log2(rank + 1)) / any_value(best), 6) AS value FROM gr JOIN ideal USING (query_id) GROUP BY query_id"""


@query
def rbp_residual(spark: SparkSession, d: str) -> DataFrame:
    sizes = _runs_labelled(spark, d).select(F.size("retrieved").alias("retrieved"))
    return sizes.groupBy("retrieved").agg(F.count("*").alias("queries")).select("retrieved", "queries", _six(m.RBP(20).residual(F.col("retrieved"))).alias("residual"))


SQL["rbp_residual"] = f"WITH {s.RUNS}, n AS (SELECT query_id, count(*) AS retrieved FROM run GROUP BY query_id) SELECT CAST(retrieved AS INTEGER) AS retrieved, count(*) AS queries, round(pow(0.8, least(20, retrieved)), 6) AS residual FROM n GROUP BY retrieved"


@query
def rbp_search_depth(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p, round(m.RBP(10, p).expected_search_depth, 6)) for p in (0.5, 0.8, 0.95)], "p double, depth double")


SQL["rbp_search_depth"] = "SELECT CAST(p AS DOUBLE) AS p, round(1 / (1 - CAST(p AS DOUBLE)), 6) AS depth FROM (VALUES (0.5), (0.8), (0.95)) t(p)"


@query
def precision_at_rank(spark: SparkSession, d: str) -> DataFrame:
    at = [_six(m.precision_at_rank(F.col("retrieved"), F.col("expected"), r)).alias(f"at_{r}") for r in (1, 3, 10)]
    return _runs_labelled(spark, d).select("run_id", "query_id", *at)


SQL["precision_at_rank"] = f"""WITH {s.RUNS}, {s.metrics(10)}, n AS (SELECT query_id, count(*) AS c FROM run GROUP BY query_id)
SELECT run_id, qid AS query_id, {', '.join(f'CASE WHEN c >= {r} THEN round(coalesce((SELECT sum(rel) FROM rel WHERE rel.query_id = m.query_id AND rank <= {r}), 0) / {r}, 6) ELSE 0 END AS at_{r}' for r in (1, 3, 10))} FROM m JOIN n USING (query_id)"""


@query
def idcg_table(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(m.texts(F.col("expected")))
    sizes = _runs_labelled(spark, d).select(n.alias("gold")).groupBy("gold").agg(F.count("*").alias("queries"))
    ones = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(10), F.col("gold")))), lambda i: F.when(F.col("gold") > 0, 1.0).otherwise(0.0))
    return sizes.select("gold", "queries", _six(m.dcg(ones, 10)).alias("idcg"))


SQL["idcg_table"] = f"WITH {s.RUNS}, {s.metrics(10)} SELECT CAST(n AS INTEGER) AS gold, count(*) AS queries, round(coalesce(list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS idcg FROM m GROUP BY n"


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    gold = read(spark, d, "query_examples").select("query_id", F.explode(match.norm_ids(F.col("expected_doc_ids"))).alias("doc")).distinct()
    rows = read(spark, d, "retrieval_results").select("run_id", "query_id", "rank", text.norm(F.col("doc_id")).alias("doc")).distinct()
    return rows, gold


@query
def hits_semi_join(spark: SparkSession, d: str) -> DataFrame:
    rows, gold = _hits(spark, d)
    return rows.join(gold, ["query_id", "doc"], "left_semi").select("run_id", "query_id", "rank", "doc")


@query
def misses_anti_join(spark: SparkSession, d: str) -> DataFrame:
    rows, gold = _hits(spark, d)
    return rows.join(gold, ["query_id", "doc"], "left_anti").select("run_id", "query_id", "rank", "doc")


@query
def id_match_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _runs_labelled(spark, d).select("run_id", "query_id", F.size(F.array_intersect("retrieved", m.texts(F.col("expected")))).alias("matched"))


_HITS = f"WITH g AS (SELECT DISTINCT query_id, unnest({s.ids('expected_doc_ids')}) AS doc FROM query_examples), r AS (SELECT DISTINCT run_id, query_id, rank, {s.norm('doc_id')} AS doc FROM retrieval_results)"
SQL["hits_semi_join"] = _HITS + " SELECT run_id, query_id, rank, doc FROM r WHERE EXISTS (SELECT 1 FROM g WHERE g.query_id = r.query_id AND g.doc = r.doc)"
SQL["misses_anti_join"] = _HITS + " SELECT run_id, query_id, rank, doc FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = r.query_id AND g.doc = r.doc)"
SQL["id_match_normalised"] = _HITS + " SELECT run_id, r.query_id, CAST(count(DISTINCT g.doc) AS INTEGER) AS matched FROM r LEFT JOIN g ON g.query_id = r.query_id AND g.doc = r.doc GROUP BY run_id, r.query_id"


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "document_examples").select("doc_id", "text", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("doc_pos"))


@query
def doc_lookup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return match.corpus_texts(_corpus(spark, d)).select("doc_key", F.length("corpus_text").alias("chars"))


SQL["doc_lookup_last_wins"] = f"SELECT {s.norm('doc_id')} AS doc_key, CAST(length(arg_max(text, loaded_at)) AS INTEGER) AS chars FROM document_examples WHERE {s.strip('text')} <> '' GROUP BY ALL"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "retrieval_results").select("run_id", F.concat_ws("|", "run_id", "query_id").alias("query_id"), "rank", "doc_id", "metadata").dropDuplicates(["query_id", "rank"])
    return match.candidate_labels(rows, _corpus(spark, d))


@query
def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    """All candidates in order; the retriever's name stands in the metadata as a text of the result."""
    rows = read(spark, d, "retrieval_results").select(F.concat_ws("|", "run_id", "query_id").alias("query_id"), "rank", "doc_id", F.create_map(F.lit("chunk"), "retriever").alias("metadata")).dropDuplicates(["query_id", "rank"])
    c = match.candidate_labels(rows, _corpus(spark, d))
    return c.select("query_id", "rank", F.size("candidates").alias("n"), F.md5(F.array_join("candidates", "|")).alias("h"))


SQL["candidate_labels"] = f"WITH {folds.candidates('[' + s.norm('hit.retriever') + ']')} SELECT query_id, rank, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(l, '|')) AS h FROM cand"


def _judged_queries(spark: SparkSession, d: str) -> DataFrame:
    """One query a run and question, its gold answers the document ids, so that judging has labels."""
    runs = read(spark, d, "retrieval_results").select("run_id", "query_id").distinct()
    q = read(spark, d, "query_examples").select("query_id", "query_text", "expected_doc_ids", "expected_answers").dropDuplicates(["query_id"])
    return runs.join(q, "query_id").withColumn("query_id", F.concat_ws("|", "run_id", "query_id"))


@query
def contexts_cross(spark: SparkSession, d: str) -> DataFrame:
    q = _judged_queries(spark, d).withColumn("expected_answers", F.col("expected_doc_ids"))
    return match.contexts(q, _candidates(spark, d)).select("query_id", "rank", "label_pos", "cand_pos", F.md5("query").alias("query"), "expected_text", F.md5("retrieved_text").alias("retrieved"))


SQL["contexts_cross"] = f"""WITH {folds.candidates()},
g AS (SELECT query_id AS qid, any_value(query_text) AS qt, any_value({s.ordered_ids('expected_doc_ids')}) AS g FROM query_examples GROUP BY query_id),
x AS (SELECT query_id, rank, l, qt, unnest(g) AS e, unnest(range(0, len(g))) AS i FROM cand JOIN g USING (qid))
SELECT query_id, rank, CAST(i AS INTEGER) AS label_pos, CAST(c AS INTEGER) AS cand_pos, md5(qt) AS query, e AS expected_text, md5(r) AS retrieved FROM (SELECT *, unnest(l) AS r, unnest(range(0, len(l))) AS c FROM x)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "generated_examples").select("query_id", F.col("query_text").alias("query"), F.col("expected_answer").alias("expected_text"), F.col("expected_context").alias("retrieved_text")).distinct()


@query
def judge_token_overlap_score(spark: SparkSession, d: str) -> DataFrame:
    score = judges.TokenOverlapJudge(min_tokens=2).score(F.col("query"), F.col("expected_text"), F.col("retrieved_text"))
    return _pairs(spark, d).select("query_id", _six(score).alias("score"))


@query
def judge_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    return judges.TokenOverlapJudge().judged(_pairs(spark, d)).select("query_id", "relevant")


SQL["judge_token_overlap_score"] = f"WITH {s.PAIRS}, {s.overlap_score('pairs_', 2)} SELECT query_id, round(score, 6) AS score FROM scored"
SQL["judge_token_overlap"] = f"WITH {s.PAIRS}, {s.overlap_score('pairs_', 15)} SELECT query_id, score >= 0.6 AS relevant FROM scored"


@query
def judge_token_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("query_id", judges.token_ratio_judge(3, 0.6)(F.col("query"), F.col("expected_text"), F.col("retrieved_text")).alias("relevant"))


@query
def judge_default_functional(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("query_id", judges.default_relevance(F.col("query"), F.coalesce("expected_text", F.lit("")), F.coalesce("retrieved_text", F.lit(""))).alias("relevant"))


_RATIO = f"""x AS (SELECT *, list_distinct({s.toks('e')}) AS w, list_intersect(list_distinct({s.toks('e')}), list_distinct({s.toks('r')})) AS sh, {s.toks('q')} AS qt FROM pairs_)"""


def _ratio(n: int) -> str:
    return f"coalesce(len(sh) >= {n} AND (len(sh) / nullif(len(w), 0) >= 0.6 OR (list_has_any(sh, qt) AND len(sh) / nullif(len(w), 0) >= 0.6 * 0.75)), false)"


SQL["judge_token_ratio"] = f"WITH {s.PAIRS}, {_RATIO} SELECT query_id, {_ratio(3)} AS relevant FROM x"
SQL["judge_default_functional"] = f"WITH {s.PAIRS}, {_RATIO} SELECT query_id, e = r OR ((contains(e, ' ') OR contains(r, ' ')) AND (contains(e, r) OR contains(r, e))) OR {_ratio(15)} AS relevant FROM x"


@query
def judge_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings")
    near = _vector_run(spark, d).select("query_id", "doc_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")), "query_id").join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("b")), "doc_id")
    c = judges.cosine(F.col("a"), F.col("b"))
    return near.select("query_id", "doc_id", _six(c).alias("cosine"), (c >= 0.35).alias("relevant"))


SQL["judge_cosine"] = f"WITH {s.vectors()} SELECT query_id, doc AS doc_id, score AS cosine, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.35 AS relevant FROM run JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = doc"


@query
def judge_llm_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies of many kinds before the answers of the table, which hold further words."""
    begins = ("Yes, ", " no. ", "It is a match: ", "irrelevant ", "correct or incorrect: ", "", "TRUE ", "Nothing accurate. ")
    e = read(spark, d, "generated_examples").select("query_id", "query_text", "expected_answer").dropDuplicates(["query_id"])
    n = F.length(F.coalesce("query_text", F.lit(""))) % len(begins)
    reply = F.concat(F.get(F.array(*map(F.lit, begins)), n), F.col("expected_answer"))
    return e.select("query_id", judges.parse_relevance(reply).alias("relevant"))


SQL["judge_llm_parse"] = """WITH e AS (SELECT query_id, any_value(coalesce(query_text, '')) AS q, any_value(expected_answer) AS a FROM generated_examples GROUP BY query_id),
r AS (SELECT query_id, lower(trim(coalesce(['Yes, ', ' no. ', 'It is a match: ', 'irrelevant ', 'correct or incorrect: ', '', 'TRUE ', 'Nothing accurate. '][length(q) % 8 + 1] || a, ''))) AS t FROM e)
SELECT query_id, CASE WHEN starts_with(t, 'yes') THEN true WHEN starts_with(t, 'no') THEN false ELSE regexp_matches(t, 'relevant|match|correct|accurate|true') AND NOT regexp_matches(t, 'irrelevant|mismatch|incorrect|inaccurate|false') END AS relevant FROM r"""


@query
def judge_llm_prompt(spark: SparkSession, d: str) -> DataFrame:
    made = judges.relevance_prompt(F.coalesce("query", F.lit("")), F.coalesce("expected_text", F.lit("")), F.coalesce("retrieved_text", F.lit("")))
    return _pairs(spark, d).select("query_id", F.md5(made).alias("h"))


SQL["judge_llm_prompt"] = f"""WITH {s.PAIRS} SELECT query_id, md5('Question asked: ' || q || chr(10) || 'Text that would answer it: ' || e || chr(10) || 'Text that was found: ' || r || chr(10) ||
'Does the text that was found say the same as the text that would answer the question? Wording does not count. Reply YES or NO.') AS h FROM pairs_"""


@query
def greedy_label_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Labels taken by rank, with conflicts: a result fits every gold id with its last character."""
    rows = _runs_labelled(spark, d).withColumn("expected", m.texts(F.col("expected")))
    end = lambda c: F.substring(c, -1, 1)
    options = F.transform("retrieved", lambda r: F.filter(F.transform(F.col("expected"), lambda e, i: F.when(end(e) == end(r), i).otherwise(F.lit(-1))), lambda i: i >= 0))
    return rows.select("run_id", "query_id", F.array_join(match.assign_labels(options), ",").alias("taken"))


SQL["greedy_label_assignment"] = f"""WITH RECURSIVE {s.RUNS}, gl AS (SELECT qs.query_id, {s.ordered_ids('g0.g')} AS g FROM qs LEFT JOIN g0 ON g0.query_id = qs.qid),
opts AS (SELECT run.query_id, run.rank, [CAST(i AS INTEGER) for i in range(0, len(gl.g)) if right(gl.g[i + 1], 1) = right(run.doc, 1)] AS o FROM run JOIN gl USING (query_id)),
{folds.greedy('opts')}
SELECT run_id, qid AS query_id, string_agg(CAST(coalesce(taken, -1) AS VARCHAR), ',' ORDER BY took.rank) AS taken FROM took JOIN qs USING (query_id) GROUP BY run_id, qid"""


@query
def evaluate_judged(spark: SparkSession, d: str) -> DataFrame:
    """Queries without gold ids, judged on answers: the gold ids serve as expected texts."""
    q = _judged_queries(spark, d).withColumn("expected_answers", F.col("expected_doc_ids")).withColumn("expected_doc_ids", F.array().cast("array<string>"))
    c = _candidates(spark, d)
    judged = judges.TokenOverlapJudge().judged(match.contexts(q, c))
    return m.summary(match.label_by_judge(q, c, judged), [m.HitRate(5), m.Recall(5), m.MRR(5)]).withColumn("score", _six(F.col("score")))


@query
def evaluate_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Gold ids where a query has any, the judge on its answers otherwise."""
    run = read(spark, d, "retrieval_results").select("run_id", F.concat_ws("|", "run_id", "query_id").alias("query_id"), "rank", "doc_id", "metadata").dropDuplicates(["query_id", "rank"])
    labelled = evaluate.label(_judged_queries(spark, d), run, _corpus(spark, d), max_k=10)
    return m.summary(labelled, [m.Recall(10), m.NDCG(10)]).withColumn("score", _six(F.col("score")))


SQL["evaluate_judged"], SQL["evaluate_mixed"] = folds.JUDGED, folds.MIXED
QUERIES.update(catalogue_text.QUERIES)
SQL.update(catalogue_text.SQL)
