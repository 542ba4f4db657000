"""Pieces of DuckDB SQL that several oracle queries share."""

from __future__ import annotations

from metrikon.functions.text import NEGATIONS, STOPWORDS

WS = r"[\s\p{Z}\x{85}\x1c-\x1f]"


def q(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def norm(x: str) -> str:
    return collapse(f"lower({x})")


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def ids(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(coalesce({x}, []), lambda t: {norm('t')}), lambda t: t IS NOT NULL AND t <> ''))"


def ordered_ids(x: str) -> str:
    """As ``ids``, in order of first appearance."""
    every = ids(x).removeprefix("list_distinct(").removesuffix(")")
    return f"list_filter({every}, lambda y, i: list_position({every}, y) = i)"


STOP, NEG = q(STOPWORDS), q(NEGATIONS)


def weight(x: str) -> str:
    return f"coalesce(list_sum(list_transform({x}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN 150 WHEN length(t) <= 2 THEN 75 WHEN length(t) >= 8 THEN 135 ELSE 100 END)), 0)"


def phrase(content: str, text: str) -> str:
    def hit(n: int) -> str:
        return f"len(list_filter(range(1, len({content}) - {n - 2}), lambda i: contains({text}, array_to_string({content}[i:i+{n - 1}], ' ')))) > 0"

    return f"CASE WHEN {hit(4)} THEN 0.05*3 WHEN {hit(3)} THEN 0.05*2 WHEN {hit(2)} THEN 0.05 ELSE 0 END"


def overlap_score(table: str, min_tokens: int) -> str:
    """CTEs from ``table`` (query_id, q, e, r) to ``scored`` (query_id, score)."""
    return f"""
t1 AS (SELECT query_id, {norm('e')} AS en, {norm('r')} AS rn, {toks('e')} AS et, {toks('r')} AS rt, {toks('q')} AS qt FROM {table}),
t2 AS (SELECT *, list_filter(et, lambda x: NOT list_contains({STOP}, x)) AS ec, list_filter(rt, lambda x: NOT list_contains({STOP}, x)) AS rc, list_filter(qt, lambda x: NOT list_contains({STOP}, x)) AS qc FROM t1),
t3 AS (SELECT *, list_distinct(ec) AS w, list_intersect(list_distinct(ec), list_distinct(rc)) AS sh FROM t2),
scored AS (SELECT query_id, CASE WHEN en = rn THEN 1.0
    WHEN list_has_any(et, {NEG}) <> list_has_any(rt, {NEG}) THEN 0.0
    WHEN en <> '' AND rn <> '' AND (contains(en, rn) OR contains(rn, en)) THEN 1.0
    WHEN len(sh) < {min_tokens} THEN 0.0
    ELSE greatest(0.0, least(1.0, coalesce({weight('sh')}::DOUBLE / nullif({weight('w')}, 0), 0) + ({phrase('ec', 'rn')}) + CASE WHEN list_has_any(sh, qc) THEN 0.1 ELSE 0 END)) END AS score FROM t3)"""


PAIRS = "pairs_ AS (SELECT DISTINCT query_id, coalesce(query_text, '') AS q, coalesce(expected_answer, '') AS e, coalesce(expected_context, '') AS r FROM generated_examples)"

V = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
run AS (SELECT query_id, doc, round(exact, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, doc) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS doc, {score} AS exact FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND {where}) QUALIFY rank <= 10),
gold AS (SELECT a.vec_id AS query_id, b.vec_id AS doc, 1 + b.vec_id % 4 AS grade FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
qs AS (SELECT vec_id AS query_id FROM v WHERE vec_id % 100 = 0)"""


def vectors(score: str = "list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)))", where: str = "true") -> str:
    return V.format(score=score, where=where)


RUNS = f"""g0 AS (SELECT query_id, any_value(expected_doc_ids) AS g FROM query_examples GROUP BY query_id),
rr AS (SELECT DISTINCT run_id, retriever, query_id AS qid, rank AS r0, {norm('doc_id')} AS doc FROM retrieval_results),
run AS (SELECT run_id || '|' || qid AS query_id, run_id, retriever, qid, doc, row_number() OVER (PARTITION BY run_id, qid ORDER BY r0, doc) AS rank FROM rr),
qs AS (SELECT DISTINCT query_id, qid, run_id, retriever FROM run),
gold AS (SELECT qs.query_id, unnest({ids('g0.g')}) AS doc FROM qs JOIN g0 ON g0.query_id = qs.qid)"""


def metrics(k: int) -> str:
    """CTEs from run, gold, qs to ``m``: one row a query with all binary metrics at k."""
    return f"""rel AS (SELECT r.query_id, r.rank, r.doc, CASE WHEN g.doc IS NULL THEN 0 ELSE 1 END AS rel FROM (SELECT * FROM run WHERE rank <= {k}) r LEFT JOIN (SELECT DISTINCT query_id, doc FROM gold) g ON g.query_id = r.query_id AND g.doc = r.doc),
ng AS (SELECT query_id, count(DISTINCT doc) AS n FROM gold GROUP BY query_id),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM rel),
a AS (SELECT query_id, count(*) AS got, count(DISTINCT CASE WHEN rel = 1 THEN doc END) AS d, min(CASE WHEN rel = 1 THEN rank END) AS fr, sum(rel / log2(rank + 1)) AS dcg, sum(rel * hits / rank) AS ap,
   sum(0.2 * rel * pow(0.8, rank - 1)) AS rbp, sum(rel * pow(15.0 / 16, hits - rel) / 16 / rank) AS err FROM h GROUP BY query_id),
m AS (SELECT qs.*, coalesce(ng.n, 0) AS n, coalesce(a.got, 0) AS got, CAST(coalesce(d, 0) > 0 AS INTEGER)::DOUBLE AS hit_rate, coalesce(d / n, 0) AS recall, coalesce(d, 0) / {k} AS precision_, coalesce(1 / fr, 0) AS mrr,
   CASE WHEN n > 0 AND dcg > 0 THEN least(1, dcg / list_sum(list_transform(range(1, least({k}, n) + 1), lambda i: 1 / log2(i + 1)))) ELSE 0 END AS ndcg, CASE WHEN n > 0 AND ap > 0 THEN least(1, ap / n) ELSE 0 END AS average_precision, least(1, coalesce(err, 0)) AS err, least(1, coalesce(rbp, 0)) AS rbp
   FROM qs LEFT JOIN ng USING (query_id) LEFT JOIN a USING (query_id))"""


NAMES = {"hit_rate": "hit_rate", "recall": "recall", "precision": "precision_", "mrr": "mrr", "ndcg": "ndcg", "average_precision": "average_precision", "err": "err", "rbp": "rbp"}
UUID_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: str) -> str:
    h = f"sha1(unhex('{UUID_NAMESPACE}') || encode({name}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (position(h[17:17] IN '0123456789abcdef') - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"
