"""Errors, shapes and calls a user of lists and files relies on."""

import asyncio
import json
import pickle
import sys
import types

import pytest

from metrikon.functions import metrics as m
from metrikon.operators import chunk, generate, judges, providers, retrieve
from metrikon.plans.evaluate import EvaluationResults
from metrikon.schema import MissingDependencyError, ValidationError
from metrikon.sources import datasets, stores


def test_results_have_their_keys(tmp_path):
    r = EvaluationResults({" recall@5 ": 0.5}, 3, "now")
    assert r.to_dict() == {"metrics": {"recall@5": 0.5}, "query_count": 3, "generated_at": "now"}
    r.to_json(tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text())["metrics"] == {"recall@5": 0.5}
    with pytest.raises(ValidationError, match="metric name"):
        EvaluationResults({" ": 0.5}, 3)


@pytest.mark.parametrize("text, message", [("[]", "root"), ("3", "root"), ('{"queries": 5}', "queries must be a list"), ('{"queries": null}', "queries must be a list"), ('{"documents": {"a": 1}}', "documents must be a list")])
def test_malformed_files_are_errors(spark, tmp_path, text, message):
    path = tmp_path / "d.json"
    path.write_text(text)
    data = datasets.from_json(spark, path)
    with pytest.raises(Exception, match=message):
        data.queries.collect() + data.documents.collect()


def test_missing_lists_are_empty(spark, tmp_path):
    (tmp_path / "d.json").write_text("{}")
    data = datasets.from_json(spark, tmp_path / "d.json")
    assert data.queries.collect() == [] and data.documents.collect() == []


def test_blank_sources_are_errors(spark):
    schema = "doc_index int, text string, source string, metadata map<string,string>"
    for text, source in ((" ", "a"), (None, "a"), ("text", " ")):
        df = spark.createDataFrame([(0, text, source, None)], schema)
        with pytest.raises(Exception, match="must not be blank"):
            chunk.chunk_rows(df).collect()
        assert chunk.chunk_rows(df, blank="skip").count() == (1 if text == "text" else 0)
    named = chunk.chunk_rows(spark.createDataFrame([(3, "text", None, None)], schema)).first()
    assert named["source"] == "document_3"
    with pytest.raises(ValidationError):
        chunk.chunk_rows(df, blank="other")


def test_metrics_of_lists(spark, caplog):
    assert m.Recall(2).score_query(["a", "b", "c"], {"a", "c"}) == 0.5
    assert m.MRR(3).score_query(["x", "a"], ["a"]) == 0.5 and m.HitRate(1).score_query([], []) == 0.0
    with caplog.at_level("INFO", logger="metrikon.functions.metrics"):
        assert m.HitRate(2).score([["a"], [], ["b", "c"]], [["a"], ["a"], []]) == pytest.approx(1 / 3)
    r = [x for x in caplog.records if getattr(x, "metric", None) == "hit_rate@2"][-1]
    assert (r.queries, r.avg_retrieved_count, r.empty_retrieved_queries, r.empty_expected_queries) == (3, 1.0, 1, 1)
    assert m.HitRate(2).score([], []) == 0.0
    with pytest.raises(ValidationError):
        m.HitRate(2).score([["a"]], [])


def test_judges_of_contexts_at_hand(spark):
    yes = judges.JudgmentContext("q", "the cat sat", "the cat sat")
    no = judges.JudgmentContext("q", "the cat sat", "stock prices fell")
    judge = judges.TokenOverlapJudge()
    assert judge.judge(yes) and not judge.judge(no) and judge.batch_judge([no, yes, no]) == [False, True, False] and judge.batch_judge([]) == []
    assert asyncio.run(judge.ajudge(yes)) and asyncio.run(judge.abatch_judge([yes, no])) == [True, False]
    assert judges.LLMJudge(lambda prompt: "YES" if "found: the cat" in prompt else "no").batch_judge([yes, no]) == [True, False]


def fake_openai(seen):
    def create(**request):
        seen.append(request)
        return types.SimpleNamespace(choices=[types.SimpleNamespace(message=types.SimpleNamespace(content=" YES "))])

    async def acreate(**request):
        return create(**request)

    client = lambda f: lambda api_key, max_retries: types.SimpleNamespace(chat=types.SimpleNamespace(completions=types.SimpleNamespace(create=f)))
    return types.SimpleNamespace(OpenAI=client(create), AsyncOpenAI=client(acreate))


def test_providers(monkeypatch):
    for name in ("openai", "anthropic", "google.genai"):
        monkeypatch.setitem(sys.modules, name, None)
    with pytest.raises(MissingDependencyError):
        providers.make_provider("openai", api_key="k")
    seen = []
    monkeypatch.setitem(sys.modules, "openai", fake_openai(seen))
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        providers.make_provider("OpenAI ")
    monkeypatch.setenv("OPENAI_API_KEY", "from-env")
    p = providers.make_provider("openai", temperature=0.3)
    assert (p.api_key, p.model) == ("from-env", providers.PROVIDERS["openai"][1])
    assert p.complete("hi") == "YES" and asyncio.run(p.acomplete("ho")) == "YES"
    assert [x["messages"][0]["content"] for x in seen] == ["hi", "ho"] and seen[0]["temperature"] == 0.3
    assert "client" not in pickle.loads(pickle.dumps(p)).__dict__
    assert judges.LLMJudge.from_provider("openai", model="m").name == "llm(openai:m)"
    assert generate.DatasetGenerator.from_provider("openai", examples_per_chunk=2).examples_per_chunk == 2
    with pytest.raises(ValueError, match="unknown provider"):
        providers.make_provider("nobody")


def test_google_and_anthropic(monkeypatch):
    reply = types.SimpleNamespace
    g = types.SimpleNamespace(Client=lambda api_key: reply(models=reply(generate_content=lambda model, contents, config: reply(text=f" {contents} {config['max_output_tokens']}"))))
    a = types.SimpleNamespace(Anthropic=lambda api_key, max_retries: reply(messages=reply(create=lambda **r: reply(content=[reply(text=f"{r['max_tokens']} ")]))))
    monkeypatch.setitem(sys.modules, "google.genai", g)
    monkeypatch.setitem(sys.modules, "google", types.SimpleNamespace(genai=g))
    monkeypatch.setitem(sys.modules, "anthropic", a)
    assert providers.make_provider("gemini", api_key="k", max_tokens=7).complete("x") == "x 7"
    assert providers.make_provider("anthropic", api_key="k", max_tokens=9).complete("x") == "9"


def test_llamaindex(monkeypatch):
    node = lambda **kw: types.SimpleNamespace(**kw)
    with pytest.raises(MissingDependencyError):
        stores.llamaindex_retriever(lambda t, k: [])
    monkeypatch.setitem(sys.modules, "llama_index", types.SimpleNamespace())
    monkeypatch.setitem(sys.modules, "llama_index.core", types.SimpleNamespace())
    monkeypatch.setitem(sys.modules, "llama_index.core.retrievers", types.SimpleNamespace(BaseRetriever=object))
    monkeypatch.setitem(sys.modules, "llama_index.core.schema", types.SimpleNamespace(TextNode=node, NodeWithScore=node))
    r = stores.llamaindex_retriever(lambda t, k: [("a", 0.5, {"document": f"{t} {k}", "x": 1}), ("b", 0.25, None), ("c", 0.1, {})], k=2)
    first, second = r._retrieve(types.SimpleNamespace(query_str=" what "))
    assert (first.score, first.node.text, first.node.id_, first.node.metadata) == (0.5, "what 2", "a", {"x": 1, "doc_id": "a", "score": 0.5})
    assert second.node.text == "" and asyncio.run(r._aretrieve(types.SimpleNamespace(query_str="w")))[1].node.id_ == "b"
    with pytest.raises(ValidationError):
        r._retrieve(types.SimpleNamespace(query_str=" "))


def test_generated_dataset_as_dict(spark):
    examples = spark.createDataFrame([("q1", "Where?", "direct_fact", "here", "It is here.", ["c1"]), ("q2", "Why?", "out_of_context", "", "", [])], "query_id string, query_text string, category string, expected_answer string, expected_context string, expected_doc_ids array<string>")
    chunks = spark.createDataFrame([("c1", "It is here.", {"a": "b"})], "doc_id string, text string, metadata map<string,string>")
    d = generate.dataset_dict(examples, chunks)
    assert d["documents"] == [{"doc_id": "c1", "text": "It is here.", "metadata": {"a": "b"}}]
    assert d["queries"][0] == {"query_id": "q1", "query_text": "Where?", "expected_answers": ["here"], "category": "direct_fact", "expected_context": "It is here.", "expected_doc_ids": ["c1"]}
    assert d["queries"][1]["expected_answers"] == []


@pytest.mark.parametrize("cells, block", [(1, 2), (50, 3), (4_000_000, 2048)])
def test_lexical_against_brute_force(spark, cells, block):
    import random

    r = random.Random(cells)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 12)))) for i in range(80)] + [(90, None), (91, "")]
    asked = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 6)))) for i in range(7)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, query_text string")
    got = sorted((x["query_id"], x["rank"], x["doc_id"], x["score"]) for x in retrieve.lexical_topk(df, q, 5, block=block, cells=cells).collect())
    want = []
    for i, text in asked:
        t = set(text.split())
        shares = sorted((-len(t & set((d or "").split())) / len(t), j) for j, d in docs if t & set((d or "").split())) if t else []
        want += [(i, n, j, round(-s, 6)) for n, (s, j) in enumerate(shares[:5], 1)]
    assert got == sorted(want)
