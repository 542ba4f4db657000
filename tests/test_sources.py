import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from metrikon import schema
from metrikon.functions import text
from metrikon.operators import chunk, generate, references
from metrikon.sources import connectors, datasets


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_json(spark, tmp_path):
    path = write(tmp_path / "d.json", {"queries": [{"id": " q1 ", "query": "first", "relevant_doc_ids": ["a", " a", ""], "expected_doc_ids": []}, {"query_id": "q2", "query_text": "x", "expected_answers": ["y"]}], "documents": [{"doc_id": "a", "metadata": {"n": 1}}]})
    data = datasets.EvaluationDataset.from_json(spark, path)
    rows = data.queries.orderBy("query_pos").collect()
    assert [(r["query_id"], r["query_text"], r["expected_doc_ids"], r["expected_answers"]) for r in rows] == [("q1", "first", ["a"], []), ("q2", "x", [], ["y"])]
    assert [(r["doc_id"], r["text"], r["metadata"]) for r in data.documents.collect()] == [("a", "", {"n": "1"})]
    assert datasets.from_json(spark, write(tmp_path / "e.json", {})).queries.count() == 0
    for bad in ({"queries": [{"query_id": "q", "query_text": " "}]}, {"queries": [{"query_text": "t"}]}):
        with pytest.raises(Exception, match="no query_"):
            datasets.from_json(spark, write(tmp_path / "b.json", bad)).queries.collect()
    with pytest.raises(Exception, match="object"):
        datasets.from_json(spark, write(tmp_path / "m.json", {"documents": [{"doc_id": "a", "metadata": [1]}]})).documents.collect()
    with pytest.raises(schema.ValidationError):
        datasets.from_json(spark, tmp_path / "none.json")


def test_csv(spark, tmp_path):
    lines = 'query_id,query_text,expected_doc_ids,expected_answers\nq1,one,"[""a"", ""b""]",\n,two,"a, b ,a","[""x, y""]"\n'
    rows = datasets.from_csv(spark, write(tmp_path / "d.csv", lines)).queries.orderBy("query_pos").collect()
    assert [(r["query_id"], r["expected_doc_ids"], r["expected_answers"]) for r in rows] == [("q1", ["a", "b"], []), ("q2", ["a", "b"], ["x, y"])]
    for cell in ("5", '"""x"""'):
        with pytest.raises(Exception, match="JSON list"):
            datasets.from_csv(spark, write(tmp_path / "b.csv", f"query_text,expected_doc_ids\none,{cell}\n")).queries.collect()
    odd = datasets.from_csv(spark, write(tmp_path / "o.csv", 'query_text,expected_doc_ids\none,"[1, 2] x"\n')).queries.first()
    assert odd["expected_doc_ids"] == ["[1", "2] x"]
    with pytest.raises(Exception, match="row 2"):
        datasets.from_csv(spark, write(tmp_path / "n.csv", "query_text,x\none,1\n,2\n")).queries.collect()


def test_helpers(tmp_path):
    assert schema.unique_texts([" a", "a", None, "", "b"]) == ["a", "b"]
    assert schema.repeated(["a", "b", "a"]) == {"a"}
    assert schema.require_positive("5", "k") == 5 and schema.require_text(" x ", "t") == "x"
    assert schema.grades({" a ": "2", " ": 1}) == {"a": 2}
    for bad in (" ", None):
        with pytest.raises(schema.ValidationError):
            schema.require_text(bad, "t")
    assert issubclass(schema.ValidationError, ValueError)


def test_text(spark):
    values = ["  A\u00a0B\u2003c\x1cd ", "", None, "\u2028x", "İX"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(text.norm(F.col("t"))).collect()] == [None if v is None else " ".join(v.strip().lower().split()) for v in values]
    assert [r[0] for r in df.where("t is not null").select(text.word_count(F.col("t"))).collect()] == [len(v.split()) for v in values if v is not None]
    ids = spark.createDataFrame([("a\nb",), ("é",)], "t string").select("t", text.uuid5(F.col("t"))).collect()
    assert all(r[1] == str(uuid.uuid5(uuid.NAMESPACE_URL, r[0])) for r in ids)


def test_connectors(spark):
    none = {}
    hits = spark.createDataFrame([("q", 0, "u1", {"doc_id": "a"}, None, 0.25, None), ("q", 1, "u2", none, 0.91, 3.0, 0.1), ("q", 2, "u3", none, None, None, 0.4), ("q", 3, "u4", none, None, None, None)], "query_id string, pos int, uuid string, properties map<string,string>, certainty double, distance double, score double")
    got = [(r["doc_id"], r["score"], r["rank"]) for r in connectors.hits_run(connectors.weaviate().normalize(hits)).orderBy("rank").collect()]
    assert got == [("a", 0.8, 1), ("u2", 0.91, 2), ("u3", 0.4, 3), ("u4", 0.0, 4)]
    flat = spark.createDataFrame([("q", 0, "i0", 0.0, {"doc_id": "d0"}), ("q", 1, "i1", 1.0, none), ("q", 2, "i2", None, none), ("q", 3, "i3", -2.0, none)], "query_id string, pos int, id string, distance double, entity map<string,string>")
    assert [r["score"] for r in connectors.chroma().normalize(flat).orderBy("pos").collect()] == [1.0, 0.5, 0.0, 1.0]
    assert [r["doc_id"] for r in connectors.milvus().normalize(flat).orderBy("pos").collect()] == ["i0", "i1", "i2", "i3"]
    q = flat.withColumnRenamed("entity", "payload").withColumn("score", F.col("distance"))
    assert [r["doc_id"] for r in connectors.qdrant().normalize(q).orderBy("pos").collect()] == ["d0", "i1", "i2", "i3"]
    es = q.select("query_id", "pos", F.lit(None).cast("string").alias("_id"), F.col("score").alias("_score"), F.col("payload").alias("_source"))
    with pytest.raises(Exception, match="no id"):
        connectors.elasticsearch().normalize(es).collect()
    docs = spark.createDataFrame([("q", 0, "t", {"id": "x", "_score": "0.5"}), ("q", 1, "t", none)], "query_id string, pos int, page_content string, metadata map<string,string>")
    assert [(r["doc_id"], r["score"]) for r in connectors.langchain().normalize(docs, F.col("metadata")).orderBy("pos").collect()] == [("x", 0.5), ("doc_1", 0.0)]
    hay = spark.createDataFrame([("q", 0, "h", 0.0, "c", {"score": "0.3"}), ("q", 1, None, 0.7, "c", {"doc_id": "m"})], "query_id string, pos int, id string, score double, content string, meta map<string,string>")
    run = connectors.hits_run(connectors.haystack().normalize(hay, F.col("meta")))
    assert [(r["doc_id"], r["score"]) for r in run.orderBy("rank").collect()] == [("h", 0.3), ("m", 0.7)]
    assert connectors.framework_documents(run).count() == 2


def sections(spark, t):
    df = spark.createDataFrame([(t,)], "t string")
    return [(s["path"], s["body"]) for s in df.select(chunk.sections(F.col("t"))).first()[0]]


def test_sections(spark):
    assert sections(spark, "intro\n# A\none\n\n### C\ntwo\r\n## B\nthree") == [([], "intro"), (["A"], "one"), (["A", "C"], "two"), (["A", "B"], "three")]
    assert sections(spark, "### A\nx\n## B\ny") == [(["A"], "x"), (["A", "B"], "y")]
    assert sections(spark, "# A\n## B") == [([], "# A\n## B")]
    assert sections(spark, "#no heading\n#") == [([], "#no heading\n#")]


def test_packing(spark):
    config = chunk.ChunkingConfig(2, 4, 6, 2, 2)
    run = lambda c: spark.range(1).select(c).first()[0]
    assert run(chunk.windows(F.lit("a b c d e f g"), 4, 2)) == ["a b c d", "c d e f", "e f g", "g"]
    assert run(chunk.pack(F.array(*map(F.lit, ["a b", "c", "d e f g h", "i"])), 4, "|")) == ["a b|c", "d e f g h", "i"]
    assert run(chunk.overlapped(F.array(*map(F.lit, ["a b c", "d e", "d e f"])), 2)) == ["a b c", "b c\n\nd e", "d e f"]
    assert run(chunk.sentences(F.lit("a b. c d. e f g h i j k."), config)) == ["a b. c d.", "e f g h", "g h i j", "i j k.", "k."]
    assert run(chunk.section_chunks(F.lit("a b c d e f"), config)) == ["a b c d e f"]
    assert run(chunk.section_chunks(F.lit("a b\n\nc d\n \ne f g"), config)) == ["a b\n\nc d", "c d\n\ne f g"]
    for bad in ((5, 4, 6, 0, 1), (1, 7, 6, 0, 1), (1, 4, 6, 6, 1), (0, 4, 6, 1, 1), (1, 4, 6, -1, 1)):
        with pytest.raises(schema.ValidationError):
            chunk.ChunkingConfig(*bad)


def test_chunk_documents(spark):
    rows = [(0, "# T\n" + "alpha beta gamma. " * 20, "docs/a.md", {"owner": "x"}), (1, " ", "b", None), (2, "tiny", " ", None), (3, None, "c", None), (4, "# T\nshort tail", "docs/a.md", {"doc_id": "mine"})]
    df = spark.createDataFrame(rows, "doc_index int, text string, source string, metadata map<string,string>")
    got = chunk.chunk_rows(df, blank="skip").orderBy("doc_index").collect()
    assert [(r["doc_index"], r["source"], r["heading_path"]) for r in got] == [(0, "docs/a.md", ["T"]), (2, "document_2", []), (4, "docs/a.md", ["T"])]
    name = "a.md\n0\n0\n" + " ".join(got[0]["text"].split())
    assert got[0]["doc_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, name)) and got[0]["metadata"]["owner"] == "x"
    assert got[2]["metadata"]["doc_id"] == got[2]["doc_id"]
    names = spark.createDataFrame([("C:\\x\\f.txt",), ("/a/b/",), ("a\\b/c\\d",), ("plain",), ("C:\\",)], "s string").select(chunk.source_name(F.col("s"))).collect()
    assert [r[0] for r in names] == ["f.txt", "b", "c\\d", "plain", ""]


def fold(rows, low, high):
    out = []
    for s, p, t in rows:
        n = len(t.split())
        if out and n < low and out[-1][:2] == (s, p) and len(out[-1][2].split()) + n <= high:
            out[-1] = (s, p, out[-1][2] + "\n\n" + t)
        else:
            out.append((s, p, t))
    return [x[2] for x in out]


def test_merge_short(spark):
    config = chunk.ChunkingConfig(2, 4, 6, 1, 3)
    cases = [("a", "x", "w " * n) for n in (5, 1, 1, 2, 4, 1)] + [("b", "x", "u"), ("b", "y", "v"), ("b", "y", "v v"), ("a", "x", "t"), ("a", "x", "t t"), ("a", "x", "s s s s s s"), ("a", "x", "r")]
    cases = [(s, p, t.strip()) for s, p, t in cases]
    df = spark.createDataFrame([(i, 0, t, s, [p]) for i, (s, p, t) in enumerate(cases)], "doc_index int, chunk_index int, text string, source string, heading_path array<string>").repartition(3)
    got = [r["text"] for r in chunk.merge_short(df, config).orderBy("doc_index").collect()]
    assert got == fold(cases, 3, 6)
    assert chunk.merge_short(df.where("false"), config).count() == 0


def test_generation(spark):
    reply = lambda *items: "```json\n" + json.dumps([dict(zip(("category", "query_text", "expected_answer"), i, strict=True)) for i in items]) + "\n```"
    good = reply(("direct_fact", "What is  it?", "RED  lamp"), ("out_of_context", "Why?", ""), ("out_of_context", "How?", "x"), ("broad_summary", "Which?", "not there"), ("gossip", "Who?", "red lamp"), ("paraphrase", " ", "red lamp"))
    rows = [(1, "c1", "the red lamp", good), (2, "c2", "a red\nlamp", reply(("paraphrase", "what IS it?", "red lamp"), ("keyword_search", "lamp", "a red"))), (3, "c3", "x", "  ")]
    df = spark.createDataFrame(rows, "chunk_pos long, chunk_id string, chunk_text string, response string")
    got = [(r["query_id"], r["query_text"], r["category"], r["expected_doc_ids"]) for r in generate.examples_of(df).orderBy("query_id").collect()]
    assert got == [("q1", "What is  it?", "direct_fact", ["c1"]), ("q2", "Why?", "out_of_context", []), ("q3", "lamp", "keyword_search", ["c2"])]
    for bad in ('{"a": 1}', "nonsense", "[1] x"):
        with pytest.raises(Exception, match="JSON array"):
            spark.createDataFrame([(1, "c", "t", bad)], df.schema).select(generate.parse_items(F.col("response"))).collect()
    sources = spark.createDataFrame([(0, "a red lamp stands here", "s", None)], "doc_index int, text string, source string, metadata map<string,string>")
    examples, chunks = generate.DatasetGenerator(lambda p: reply(("direct_fact", "what?", "red lamp")) if "red lamp" in p else "[]", examples_per_chunk=2).generate(sources)
    assert examples.count() == 1 and chunks.count() == 1
    q = generate.query_examples(examples).first()
    assert q["expected_answers"] == ["red lamp"] and len(q["expected_doc_ids"]) == 1


T0 = dt.datetime(2025, 3, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def brute_orphans(refs, targets):
    spans = {}
    for i, a, d in targets:
        k = i.strip().lower() if i else ""
        if k:
            spans.setdefault(k, []).append((a, d))
    out = set()
    for t, r, i, at in refs:
        k = i.strip().lower() if i else ""
        if not k:
            continue
        s = spans.get(k)
        began = s and at is not None and any(a is None or a <= at for a, _ in s)
        there = s and at is not None and any((a is None or a <= at) and (d is None or at < d) for a, d in s)
        if s and at is None:
            began = there = any(a is None for a, _ in s)
            there = any(a is None and d is None for a, d in s)
        if not there:
            out.add((t, r, k, "missing" if not s else "deleted" if began else "later", at.strftime("%Y-%m") if at else None))
    return out


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_orphans(spark, share):
    targets = [("A", day(0), day(10)), ("a ", day(20), None), ("b", day(5), None), ("hot", day(3), day(4)), (None, day(0), None), ("hot", day(3), day(4))]
    refs = [("t", str(i), x, day(n)) for i, (x, n) in enumerate([("a", 0), ("a", 10), ("\u00a0A\u2003", 9), ("a", 20), ("b", 4), ("b", 5), ("zz", 1), (None, 1), ("  ", 1), ("b", None), ("zz", None)])]
    refs += [("t", f"h{i}", "HOT", day(i % 6)) for i in range(60)] + [("t", "0", "a", day(0))]
    r = spark.createDataFrame([(*x, "clash") for x in refs], "ref_table string, ref_id string, doc_id string, at timestamp_ntz, key string")
    t = spark.createDataFrame([(*x, "clash") for x in targets], "doc_id string, added_at timestamp_ntz, deleted_at timestamp_ntz, spans string")
    got = {tuple(x) for x in references.orphan_references(r, t, heavy_share=share).collect()}
    assert got == brute_orphans(refs, targets)
    assert references.orphan_references(r.where("false"), t).count() == 0
    assert {x["reason"] for x in references.orphan_references(r, t.where("false")).collect()} == {"missing"}
    assert references.orphan_counts(references.orphan_references(r, t)).agg(F.sum("orphans")).first()[0] == len(got)
