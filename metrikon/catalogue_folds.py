"""DuckDB SQL beside the queries that fold over an order: packing, merging, sections, greedy assignment."""

from __future__ import annotations

from metrikon import catalogue_sql as s

DOCS = "d AS (SELECT doc_index, any_value(text) AS text FROM source_documents GROUP BY doc_index)"


def packed(pattern: str, limit: int) -> str:
    """CTEs to ``grp`` (doc_index, pos, words): consecutive parts of a text in groups of at most ``limit`` words."""
    return f"""{DOCS},
parts AS (SELECT doc_index, list_filter([{s.strip('x')} for x in regexp_split_to_array(text, '{pattern}')], lambda x: x <> '') AS l FROM d WHERE text IS NOT NULL),
sized AS (SELECT doc_index, unnest(range(1, len(l) + 1)) AS i, unnest([len({s.words('x')}) for x in l]) AS n FROM parts),
st AS (SELECT doc_index, i, n, n AS total, 0 AS pos FROM sized WHERE i = 1
  UNION ALL SELECT z.doc_index, z.i, z.n, CASE WHEN st.total + z.n <= {limit} THEN st.total + z.n ELSE z.n END, CASE WHEN st.total + z.n <= {limit} THEN st.pos ELSE st.pos + 1 END
  FROM st JOIN sized z ON z.doc_index = st.doc_index AND z.i = st.i + 1),
grp AS (SELECT doc_index, pos, sum(n) AS words FROM st GROUP BY doc_index, pos)"""


_SP = r"[\s\p{Z}\x{85}]"
PARAGRAPHS = f"WITH RECURSIVE {packed(f'{chr(92)}n{_SP}*{chr(92)}n', 450)} SELECT doc_index, CAST(pos AS INTEGER) AS pos, CAST(words AS INTEGER) AS words FROM grp"

# A sentence ends at its mark before white space; the mark stays with it, so the text is cut behind a sign put there.
_SENTENCES = packed(r"\x01", 450).replace("regexp_split_to_array(text,", rf"regexp_split_to_array(regexp_replace(text, '([.!?]){_SP}+', '\1' || chr(1), 'g'),")
SENTENCES = f"""WITH RECURSIVE {_SENTENCES},
cut AS (SELECT doc_index, pos, i, CASE WHEN words <= 700 THEN words ELSE least(450, words - i * 390) END AS words
  FROM (SELECT *, unnest(range(0, CASE WHEN words <= 700 THEN 1 ELSE CAST(ceil(words / 390.0) AS BIGINT) END)) AS i FROM grp))
SELECT doc_index, CAST(row_number() OVER (PARTITION BY doc_index ORDER BY pos, i) - 1 AS INTEGER) AS pos, CAST(words AS INTEGER) AS words FROM cut"""

MERGED = f"""WITH RECURSIVE r AS (SELECT doc_id, any_value(text) AS text, any_value(source) AS source, any_value(heading_path) AS path FROM generated_chunks WHERE text IS NOT NULL GROUP BY doc_id),
o AS (SELECT doc_id, source, path, len({s.words('text')}) AS n, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS i FROM r),
st AS (SELECT i, doc_id, source, path, n FROM o WHERE i = 1
  UNION ALL SELECT o.i, CASE WHEN joins THEN st.doc_id ELSE o.doc_id END, o.source, o.path, CASE WHEN joins THEN st.n + o.n ELSE o.n END
  FROM st JOIN o ON o.i = st.i + 1, LATERAL (SELECT coalesce(o.source = st.source AND o.path = st.path, false) AND o.n < 80 AND st.n + o.n <= 700 AS joins))
SELECT doc_id, any_value(source) AS source, CAST(max(n) AS INTEGER) AS words FROM st GROUP BY doc_id"""

_HEAD = r"^#{1,6}[\t\v\f\r\p{Zs}\x{2028}\x{2029}\x{85}]+[^\n]"
SECTIONS = rf"""WITH RECURSIVE {DOCS},
t AS (SELECT doc_index, text, regexp_split_to_array({s.strip(r"regexp_replace(text, '\r\n|[\n\v\f\r\x{85}\x{2028}\x{2029}\x1c-\x1e]', chr(10), 'g')")}, '\n') AS l FROM d WHERE text IS NOT NULL),
li AS (SELECT doc_index, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM t),
hd AS (SELECT *, regexp_matches(line, '{_HEAD}') AS head FROM li),
sec AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_index ORDER BY i) AS k FROM hd),
titles AS (SELECT doc_index, k, length(regexp_extract(line, '^(#+)', 1)) AS level, {s.strip("regexp_replace(line, '^#+', '')")} AS title FROM sec WHERE head),
paths AS (SELECT DISTINCT doc_index, CAST(0 AS HUGEINT) AS k, []::VARCHAR[] AS path FROM li
  UNION ALL SELECT p.doc_index, t.k, list_append(p.path[1:t.level - 1], t.title) FROM paths p JOIN titles t ON t.doc_index = p.doc_index AND t.k = p.k + 1),
body AS (SELECT doc_index, k, string_agg(line, chr(10) ORDER BY i) AS raw, count(*) AS lines FROM sec WHERE NOT head GROUP BY doc_index, k),
full_ AS (SELECT b.doc_index, b.k, {s.strip('raw')} AS body, path FROM body b JOIN paths USING (doc_index, k)),
out_ AS (SELECT doc_index, k, array_to_string(path, ' > ') AS path, body FROM full_ WHERE body <> ''
  UNION ALL SELECT doc_index, 0, '', {s.strip('text')} FROM t WHERE NOT EXISTS (SELECT 1 FROM body WHERE body.doc_index = t.doc_index AND (body.raw <> '' OR body.lines > 1)))
SELECT doc_index, CAST(row_number() OVER (PARTITION BY doc_index ORDER BY k) - 1 AS INTEGER) AS pos, path, md5(body) AS h FROM out_"""


def greedy(options: str) -> str:
    """CTEs from ``options`` (query_id, rank from 1 without gaps, o: sorted positions) to ``took`` (query_id, rank, taken)."""
    free = "list_filter({0}.o, lambda x: NOT list_contains(st.used, x))[1]"
    return f"""st AS (SELECT query_id, CAST(0 AS BIGINT) AS rank, []::INTEGER[] AS used, CAST(NULL AS INTEGER) AS taken FROM (SELECT DISTINCT query_id FROM {options})
  UNION ALL SELECT st.query_id, n.rank, CASE WHEN {free.format('n')} IS NULL THEN st.used ELSE list_append(st.used, {free.format('n')}) END, {free.format('n')} FROM st JOIN {options} n ON n.query_id = st.query_id AND n.rank = st.rank + 1),
took AS (SELECT query_id, rank, taken FROM st WHERE rank > 0)"""


def candidates(extra: str = "[]", keep: str = "true") -> str:
    """CTEs to ``cand`` (query_id, qid, rank, l): the distinct texts by which a result can be matched, in order."""
    return f"""lastdoc AS (SELECT {s.norm('doc_id')} AS k, arg_max(text, loaded_at) AS t FROM document_examples WHERE {s.strip('text')} <> '' GROUP BY ALL),
hit AS (SELECT DISTINCT run_id || '|' || query_id AS query_id, query_id AS qid, rank, retriever, {s.norm('doc_id')} AS k FROM retrieval_results WHERE {keep}),
raw AS (SELECT query_id, qid, rank, list_filter(list_concat([hit.k, {s.norm('lastdoc.t')}], {extra}), lambda x: x IS NOT NULL AND x <> '') AS l FROM hit LEFT JOIN lastdoc USING (k)),
cand AS (SELECT query_id, qid, rank, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM raw)"""


def judged(labels: str, where: str) -> str:
    """CTEs from ``cand`` and the label lists of the queries to ``took``: contexts judged by token overlap, then assigned."""
    return f"""lab AS (SELECT query_id AS qid, any_value(query_text) AS qt, any_value({s.ordered_ids(labels)}) AS g FROM query_examples WHERE {where} GROUP BY query_id),
asked AS (SELECT cand.query_id, cand.qid, cand.rank, cand.l, lab.qt, lab.g, row_number() OVER (PARTITION BY cand.query_id ORDER BY cand.rank) AS pos FROM cand JOIN lab USING (qid)),
one AS (SELECT DISTINCT qt, e, r FROM (SELECT qt, unnest(g) AS e, l FROM asked), LATERAL (SELECT unnest(l) AS r)),
pairs_ AS (SELECT row_number() OVER () AS query_id, coalesce(qt, '') AS q, e, r, qt FROM one),
{s.overlap_score('pairs_', 15)},
yes AS (SELECT qt, e, r FROM pairs_ JOIN scored USING (query_id) WHERE score >= 0.6),
flat AS (SELECT query_id, qt, pos, e, i, r FROM (SELECT query_id, qt, pos, unnest(g) AS e, unnest(range(0, len(g))) AS i, l FROM asked), LATERAL (SELECT unnest(l) AS r)),
match_ AS (SELECT DISTINCT query_id, pos, CAST(i AS INTEGER) AS i FROM flat JOIN yes USING (qt, e, r)),
opts AS (SELECT a.query_id, a.pos AS rank, coalesce(list_sort(list(i) FILTER (WHERE i IS NOT NULL)), []) AS o FROM asked a LEFT JOIN match_ m ON m.query_id = a.query_id AND m.pos = a.pos GROUP BY a.query_id, a.pos),
{greedy('opts')}"""


JUDGED = f"""WITH RECURSIVE {candidates()}, {judged('expected_doc_ids', 'true')},
q AS (SELECT query_id, any_value(len(g)) AS n FROM asked GROUP BY query_id),
m AS (SELECT q.query_id, n, count(taken) FILTER (WHERE rank <= 5) AS got, min(CASE WHEN taken IS NOT NULL AND rank <= 5 THEN rank END) AS fr FROM q LEFT JOIN took USING (query_id) GROUP BY q.query_id, n)
SELECT 'hit_rate@5' AS metric, round(avg(CAST(got > 0 AS INTEGER)), 6) AS score, count(*) AS query_count FROM m
UNION ALL SELECT 'recall@5', round(avg(CASE WHEN n > 0 THEN got / n ELSE 0 END), 6), count(*) FROM m UNION ALL SELECT 'mrr@5', round(avg(coalesce(1 / fr, 0)), 6), count(*) FROM m"""

_GOLD = f"len({s.ids('expected_doc_ids')}) > 0"
MIXED = f"""WITH RECURSIVE {candidates(keep='rank <= 10')}, {judged('expected_answers', f'NOT {_GOLD}')},
byid AS (SELECT query_id AS qid, any_value({s.ids('expected_doc_ids')}) AS g FROM query_examples WHERE {_GOLD} GROUP BY query_id),
h0 AS (SELECT hit.query_id, g, k, row_number() OVER (PARTITION BY hit.query_id ORDER BY rank) AS rank FROM hit JOIN byid USING (qid)),
h1 AS (SELECT query_id, rank, CASE WHEN list_contains(g, k) THEN 1 ELSE 0 END AS rel, k, len(g) AS n FROM h0),
h2 AS (SELECT took.query_id, rank, CASE WHEN taken IS NULL THEN 0 ELSE 1 END AS rel, CAST(taken AS VARCHAR) AS k, n FROM took JOIN (SELECT query_id, any_value(len(g)) AS n FROM asked GROUP BY query_id) USING (query_id)),
m AS (SELECT query_id, any_value(n) AS n, count(DISTINCT CASE WHEN rel = 1 THEN k END) AS got, sum(rel / log2(rank + 1)) AS dcg FROM (FROM h1 UNION ALL FROM h2) WHERE rank <= 10 GROUP BY query_id)
SELECT 'recall@10' AS metric, round(avg(CASE WHEN n > 0 THEN got / n ELSE 0 END), 6) AS score, count(*) AS query_count FROM m
UNION ALL SELECT 'ndcg@10', round(avg(CASE WHEN n > 0 AND dcg > 0 THEN least(1, dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1)))) ELSE 0 END), 6), count(*) FROM m"""
