"""Queries on text primitives, chunking, generation, loaders and hit normalisers, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrikon import catalogue_folds as folds
from metrikon import catalogue_sql as s
from metrikon.functions import text
from metrikon.operators import chunk, generate
from metrikon.session import read, shared_dir, staged_path
from metrikon.sources import connectors, datasets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):  # noqa: ANN001, ANN201
    QUERIES[f.__name__] = f
    return f


@query
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.norm(F.col("text"))).alias("h"))


@query
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("h")).where("h IS NOT NULL")


@query
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.word_count(F.col("text")).alias("n"))


@query
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    t = text.content_tokens(F.col("text"))
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("h"))


@query
def unique_strings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "query_examples").select("query_id", F.array_join(text.distinct_texts(F.col("expected_doc_ids")), "|").alias("ids")).distinct()


_D = "FROM documents WHERE text IS NOT NULL"
SQL["normalize_text"] = f"SELECT doc_id, md5({s.norm('text')}) AS h FROM documents"
SQL["tokenize"] = f"SELECT doc_id, CAST(len({s.toks('text')}) AS INTEGER) AS n, md5(array_to_string({s.toks('text')}, ' ')) AS h {_D}"
SQL["token_count"] = f"SELECT doc_id, CAST(len({s.words('text')}) AS INTEGER) AS n {_D}"
_CONTENT = f"list_filter({s.toks('text')}, lambda x: NOT list_contains({s.STOP}, x))"
SQL["stopword_filter"] = f"SELECT doc_id, CAST(len({_CONTENT}) AS INTEGER) AS n, md5(array_to_string({_CONTENT}, ' ')) AS h {_D}"
_UNIQUE = f"list_filter(list_transform(coalesce(expected_doc_ids, []), lambda t: {s.strip('t')}), lambda t: t IS NOT NULL AND t <> '')"
SQL["unique_strings"] = f"""WITH u AS (SELECT DISTINCT query_id, {_UNIQUE} AS l FROM query_examples)
SELECT DISTINCT query_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|'), '') AS ids FROM u"""


@query
def chunk_token_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunk.word_windows(read(spark, d, "documents"), "doc_id", "text", 60, 10).select("doc_id", "window_index", F.md5("text").alias("h"))


@query
def chunk_word_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "source_documents").select("doc_index", "text").distinct()
    return chunk.word_windows(docs, "doc_index", "text").select("doc_index", "window_index", F.md5("text").alias("h"))


@query
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    parts = chunk.overlapped(chunk.windows(F.coalesce("text", F.lit("")), 60, 0), 10)
    return read(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("pos", "chunk")).select("doc_id", "pos", F.md5("chunk").alias("h"))


def _windows_sql(table: str, key: str, size: int, step: int) -> str:
    return f"w AS (SELECT {key}, {s.words('text')} AS t FROM {table} WHERE text IS NOT NULL), x AS (SELECT {key}, unnest(range(0, len(t), {step})) AS i, t FROM w), c AS (SELECT {key}, i // {step} AS pos, array_to_string(t[i + 1:i + {size}], ' ') AS chunk, t[i + 1:i + {size}] AS words FROM x)"


SQL["chunk_token_windows"] = f"WITH {_windows_sql('documents', 'doc_id', 60, 50)} SELECT doc_id, CAST(pos AS INTEGER) AS window_index, md5(chunk) AS h FROM c"
SQL["chunk_word_windows"] = f"WITH {_windows_sql('(SELECT DISTINCT doc_index, text FROM source_documents)', 'doc_index', 500, 500)} SELECT doc_index, CAST(pos AS INTEGER) AS window_index, md5(chunk) AS h FROM c"
SQL["chunk_overlap"] = f"""WITH {_windows_sql('documents', 'doc_id', 60, 60)}, p AS (SELECT doc_id, pos, chunk, lag(array_to_string(list_reverse(list_reverse(words)[1:10]), ' ')) OVER (PARTITION BY doc_id ORDER BY pos) AS tail FROM c)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(CASE WHEN tail IS NOT NULL AND NOT starts_with(chunk, tail) THEN tail || chr(10) || chr(10) || chunk ELSE chunk END) AS h FROM p"""


@query
def chunk_ids_uuid5(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "generated_chunks").where("text IS NOT NULL AND chunk_index IS NOT NULL").select("doc_id", "source", "chunk_index", "text").distinct()
    document = F.length("text") % 97  # some number that is not the chunk's
    return rows.select("doc_id", chunk.chunk_id(F.coalesce("source", F.lit("")), document, F.col("chunk_index"), F.col("text")).alias("id"))


_NAME = "coalesce(nullif(regexp_extract(regexp_replace(coalesce(source, ''), '^[A-Za-z]:', ''), '([^/\\\\]*)[/\\\\]*$', 1), ''), 'document_' || length(text) % 97)"
SQL["chunk_ids_uuid5"] = f"WITH r AS (SELECT DISTINCT doc_id, {_NAME} || chr(10) || length(text) % 97 || chr(10) || chunk_index || chr(10) || {s.collapse('text')} AS name FROM generated_chunks WHERE text IS NOT NULL AND chunk_index IS NOT NULL) SELECT doc_id, {s.uuid5('name')} AS id FROM r"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "source_documents").select("doc_index", "text", "source", "metadata").dropDuplicates(["doc_index"])


@query
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d).where("text IS NOT NULL").select("doc_index", F.posexplode(chunk.sections(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_index", "pos", F.array_join("s.path", " > ").alias("path"), F.md5("s.body").alias("h"))


@query
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    groups = chunk.pack(chunk.pieces_of(F.col("text"), r"(?U)\n\s*\n"), 450, "\n\n")
    return _sources(spark, d).where("text IS NOT NULL").select("doc_index", F.posexplode(groups).alias("pos", "g")).select("doc_index", "pos", text.word_count(F.col("g")).alias("words"))


@query
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    parts = chunk.sentences(F.col("text"), chunk.ChunkingConfig())
    return _sources(spark, d).where("text IS NOT NULL").select("doc_index", F.posexplode(parts).alias("pos", "g")).select("doc_index", "pos", text.word_count(F.col("g")).alias("words"))


@query
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_documents(_sources(spark, d), blank="skip").select("doc_index", "chunk_index", "doc_id", "source", F.array_join("heading_path", " > ").alias("path"), text.word_count(F.col("text")).alias("words"))


@query
def merge_short_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "generated_chunks").select("doc_id", "text", "source", "heading_path").where("text IS NOT NULL").dropDuplicates(["doc_id"])
    return chunk.merge_short(rows, order=("source", "doc_id")).select("doc_id", "source", text.word_count(F.col("text")).alias("words"))


@query
def generation_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "generated_chunks").select("doc_id", "metadata", "text").where("text IS NOT NULL").dropDuplicates(["doc_id"])
    return rows.select("doc_id", F.md5(generate.prompt(F.col("doc_id"), F.col("metadata"), F.col("text"))).alias("h"))


# Fixed value: the request, with its kinds and fields written out.
_ASK = """

Write 6 questions that test whether a search system finds the passage above. Spread them over these kinds: direct_fact, paraphrase, keyword_search, specific_detail, broad_summary, out_of_context. Copy each answer word for word from the passage; a question of kind out_of_context fits the subject, is not answered by the passage and has an empty answer. Reply with nothing but a JSON array of objects with the fields "category", "query_text" and "expected_answer"."""
_META = "CASE WHEN metadata IS NULL THEN '{}' ELSE '{' || array_to_string([to_json(x.key)::VARCHAR || ':' || to_json(x.value)::VARCHAR for x in list_sort(map_entries(metadata)) if x.value IS NOT NULL], ',') || '}' END"
SQL["generation_prompts"] = f"SELECT doc_id, md5('Passage id: ' || doc_id || chr(10) || 'Metadata: ' || any_value({_META}) || chr(10) || 'Passage:' || chr(10) || any_value(text) || '{_ASK}') AS h FROM generated_chunks WHERE text IS NOT NULL GROUP BY doc_id"


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Canned model responses: each example as a fenced JSON array, its context as the chunk."""
    item = F.struct(F.coalesce("category", F.lit("")).alias("category"), F.coalesce("query_text", F.lit("")).alias("query_text"), F.coalesce("expected_answer", F.lit("")).alias("expected_answer"))
    e = read(spark, d, "generated_examples").dropDuplicates(["query_id"])
    return e.select(F.col("query_id").alias("chunk_pos"), F.col("query_id").alias("chunk_id"), F.col("expected_context").alias("chunk_text"), F.concat(F.lit("```json\n"), F.to_json(F.array(item)), F.lit("\n```")).alias("response"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = _responses(spark, d).select("chunk_pos", "chunk_id", "chunk_text", F.posexplode(generate.parse_items(F.col("response"))).alias("item_pos", "i"))
    return rows.select("chunk_pos", "chunk_id", "chunk_text", "item_pos", "i.*")


@query
def generation_parse(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("chunk_id", "category", "query_text", "expected_answer")


@query
def generation_validate(spark: SparkSession, d: str) -> DataFrame:
    return generate.valid_items(_items(spark, d)).select("chunk_id", "category", F.size("expected_doc_ids").alias("gold"))


@query
def generation_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return generate.first_of_query(generate.valid_items(_items(spark, d))).select("query_id", "chunk_id")


@query
def generated_to_dataset(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "generated_examples").dropDuplicates(["query_id"])
    return generate.query_examples(e).select("query_id", F.size("expected_doc_ids").alias("gold"), F.size("expected_answers").alias("answers"))


_G = "g AS (SELECT query_id, any_value(coalesce(category, '')) AS category, any_value(coalesce(query_text, '')) AS query_text, any_value(coalesce(expected_answer, '')) AS expected_answer, any_value(expected_context) AS expected_context, any_value(len(coalesce(expected_doc_ids, []))) AS gold FROM generated_examples GROUP BY query_id)"
_VALID = f"""{_G}, t AS (SELECT query_id, {s.strip('category')} AS c, {s.strip('query_text')} AS qt, {s.strip('expected_answer')} AS a, coalesce(expected_context, '') AS ctx FROM g),
ok AS (SELECT * FROM t WHERE qt <> '' AND ((c = 'out_of_context' AND a = '') OR (c IN ('direct_fact','paraphrase','keyword_search','specific_detail','broad_summary') AND a <> '' AND contains({s.norm('ctx')}, {s.norm('a')}))))"""
SQL["generation_parse"] = f"WITH {_G} SELECT query_id AS chunk_id, category, query_text, expected_answer FROM g"
SQL["generation_validate"] = f"WITH {_VALID} SELECT query_id AS chunk_id, c AS category, CAST(c <> 'out_of_context' AS INTEGER) AS gold FROM ok"
SQL["generation_dedupe"] = f"WITH {_VALID}, f AS (SELECT query_id FROM ok QUALIFY row_number() OVER (PARTITION BY {s.norm('qt')} ORDER BY query_id) = 1) SELECT 'q' || row_number() OVER (ORDER BY query_id) AS query_id, query_id AS chunk_id FROM f"
SQL["generated_to_dataset"] = f"WITH {_G} SELECT query_id, CAST(gold AS INTEGER) AS gold, CAST({s.strip('expected_answer')} <> '' AS INTEGER) AS answers FROM g"


SQL["chunk_paragraphs"], SQL["chunk_sentences"], SQL["merge_short_chunks"], SQL["markdown_sections"] = folds.PARAGRAPHS, folds.SENTENCES, folds.MERGED, folds.SECTIONS


def _written(spark: SparkSession, content: list[str]) -> str:
    path = f"{shared_dir(spark)}/metrikon/file-{uuid.uuid4().hex}"
    spark.createDataFrame([("\n".join(content),)], "value string").coalesce(1).write.text(path)
    return path


@query
def load_json_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A JSON dataset with current, older and unknown keys."""
    items = {
        "queries": [{"query_id": "q1", "query_text": " first ", "expected_doc_ids": ["d1", "d1", " "]}, {"id": "q2", "query": "second", "relevant_doc_ids": ["d2"], "expected_answers": ["a", "b"], "more": 1}],
        "documents": [{"doc_id": "d1", "text": "one", "metadata": {"k": 1}}, {"doc_id": "d2"}],
    }
    data = datasets.from_json(spark, _written(spark, [json.dumps(items)]))
    q = data.queries.select(F.col("query_id").alias("id"), F.col("query_text").alias("text"), F.array_join("expected_doc_ids", "|").alias("gold"), F.array_join("expected_answers", "|").alias("answers"))
    return q.unionByName(data.documents.select(F.col("doc_id").alias("id"), "text", F.lit("").alias("gold"), F.array_join(F.map_values("metadata"), "|").alias("answers")))


SQL["load_json_dataset"] = "SELECT * FROM (VALUES ('q1', 'first', 'd1', ''), ('q2', 'second', 'd2', 'a|b'), ('d1', 'one', '', '1'), ('d2', '', '', '')) t(id, text, gold, answers)"


@query
def load_csv_dataset(spark: SparkSession, d: str) -> DataFrame:
    lines = ["query_id,query_text,expected_doc_ids,expected_answers", 'a,first,"[""d1"", ""d2""]",', ',second,"d3, d3 ,d4","[""x, y""]"']
    q = datasets.from_csv(spark, _written(spark, lines)).queries
    return q.select(F.col("query_id").alias("id"), F.col("query_text").alias("text"), F.array_join("expected_doc_ids", "|").alias("gold"), F.array_join("expected_answers", "|").alias("answers"))


SQL["load_csv_dataset"] = "SELECT * FROM (VALUES ('a', 'first', 'd1|d2', ''), ('q2', 'second', 'd3|d4', 'x, y')) t(id, text, gold, answers)"


def _loadable(spark: SparkSession, d: str) -> DataFrame:
    """Query rows with an id and a text, for without them a file is an error."""
    rows = read(spark, d, "query_examples").select("query_id", "query_text", "expected_doc_ids", "expected_answers")
    return rows.where((text.strip(F.col("query_id")) != "") & (text.strip(F.col("query_text")) != ""))


def _loaded(q: DataFrame) -> DataFrame:
    return q.select(F.col("query_id").alias("id"), F.md5("query_text").alias("h"), F.array_join("expected_doc_ids", "|").alias("gold"), F.array_join("expected_answers", "|").alias("answers"))


@query
def load_json_tables(spark: SparkSession, d: str) -> DataFrame:
    """The whole tables written as a folder of JSON files of some 1,000 items each, and loaded."""
    path = staged_path(spark, "files")
    documents = read(spark, d, "document_examples").select("doc_id", "text", "metadata").where(text.strip(F.col("doc_id")) != "")
    for name, rows in (("queries", _loadable(spark, d)), ("documents", documents)):
        files = rows.count() // 1000 + 1
        part = F.pmod(F.xxhash64(*(c for c in rows.columns if c != "metadata")), F.lit(files))
        lists = rows.groupBy(part.alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias(name))
        lists.select(F.to_json(F.struct(name)).alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    data = datasets.from_json(spark, path)
    values = F.array_join(F.array_sort(F.map_values("metadata")), "|")
    return _loaded(data.queries).unionByName(data.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), F.lit("").alias("gold"), values.alias("answers")))


@query
def load_csv_tables(spark: SparkSession, d: str) -> DataFrame:
    """The whole table of queries written as CSV, its lists as JSON in their cells, and loaded."""
    path = staged_path(spark, "files")
    rows = _loadable(spark, d).withColumns({c: F.to_json(c) for c in ("expected_doc_ids", "expected_answers")})
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(path)
    return _loaded(datasets.from_csv(spark, path).queries)


def _list_sql(c: str) -> str:
    given = f"list_filter(list_transform(coalesce({c}, []), lambda t: {s.strip('t')}), lambda t: t IS NOT NULL AND t <> '')"
    return f"coalesce(array_to_string(list_filter({given}, lambda x, i: list_position({given}, x) = i), '|'), '')"


_LOADED = f"SELECT {s.strip('query_id')} AS id, md5({s.strip('query_text')}) AS h, {_list_sql('expected_doc_ids')} AS gold, {_list_sql('expected_answers')} AS answers FROM query_examples WHERE {s.strip('query_id')} <> '' AND {s.strip('query_text')} <> ''"
SQL["load_json_tables"] = f"{_LOADED} UNION ALL SELECT {s.strip('doc_id')}, md5(coalesce(text, '')), '', coalesce(array_to_string(list_sort(map_values(metadata)), '|'), '') FROM document_examples WHERE {s.strip('doc_id')} <> ''"
SQL["load_csv_tables"] = _LOADED


@query
def score_from_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "retrieval_results").select("result_id", (F.lit(0.5) - F.col("score")).alias("distance")).distinct()
    return rows.select("result_id", (F.round(connectors.distance_score(F.col("distance")), 6) + F.lit(0.0)).alias("score"))


SQL["score_from_distance"] = "SELECT DISTINCT result_id, CASE WHEN score IS NULL THEN 1.0::DOUBLE ELSE round(1 / (1 + greatest(0.5 - score, 0)), 6) END AS score FROM retrieval_results"


@query
def hit_id_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The payload's id before the point's, or the other way round, by kind of database."""
    rows = read(spark, d, "retrieval_results").select("result_id", "doc_id", "score", "run_id").dropDuplicates(["result_id"])
    payload = F.when(F.col("doc_id").isNotNull(), F.create_map(F.lit("doc_id"), F.col("doc_id")))
    rows = rows.select(F.col("run_id").alias("query_id"), F.col("result_id").alias("pos"), F.col("result_id").alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").alias("distance"), payload.alias("payload"), payload.alias("entity"))
    a = connectors.qdrant().normalize(rows).select("pos", F.col("doc_id").alias("payload_first"))
    b = connectors.milvus().normalize(rows).select("pos", F.col("doc_id").alias("hit_first"))
    return a.where("payload_first IS NOT NULL").join(b, "pos").select(F.col("pos").alias("result_id"), "payload_first", "hit_first")


@query
def score_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Certainty, else the distance's score, else the score, else 0."""
    rows = read(spark, d, "retrieval_results").select("result_id", "score", "rank").dropDuplicates(["result_id"])
    rows = rows.select(F.lit("q").alias("query_id"), F.col("result_id").alias("pos"), F.col("result_id").alias("uuid"), F.create_map().cast("map<string,string>").alias("properties"), F.when(F.col("rank") == 1, F.lit(0.9)).alias("certainty"), F.when(F.col("rank") == 2, F.lit(0.25)).alias("distance"), "score")
    return connectors.weaviate().normalize(rows).select(F.col("pos").alias("result_id"), "score")


SQL["hit_id_precedence"] = "SELECT DISTINCT result_id, coalesce(doc_id, CAST(result_id AS VARCHAR)) AS payload_first, CAST(result_id AS VARCHAR) AS hit_first FROM retrieval_results"
SQL["score_precedence"] = "SELECT DISTINCT result_id, CASE rank WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE coalesce(score, 0) END AS score FROM retrieval_results"
