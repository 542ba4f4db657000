import sys
import types

import pytest
from pyspark import cloudpickle

from metrikon.functions import metrics as m
from metrikon.plans.evaluate import Evaluator
from metrikon.schema import MissingDependencyError
from metrikon.sources import stores

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't have the tests' folder


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q1", " lamp ", ["a"], []), ("q2", "post", ["zz"], [])], "query_id string, query_text string, expected_doc_ids array<string>, expected_answers array<string>")


def encode(text):
    return [float(len(text)), 1.0]


def hits(run):
    return [(r["rank"], r["doc_id"], r["score"], r["metadata"]) for r in run.where("query_id = 'q1'").orderBy("rank").collect()]


def test_qdrant(queries):
    def connect():
        def query_points(collection_name, query, limit, query_filter):
            assert (collection_name, query, query_filter) == ("c", [4.0, 1.0], {"f": 1})
            return types.SimpleNamespace(points=[types.SimpleNamespace(id=7, score=0.5, payload={"doc_id": "a", "n": {"x": 1}}), {"id": 8, "score": 0.4}][:limit])

        return types.SimpleNamespace(query_points=query_points)

    store = stores.qdrant_store("c", encode, connect, query_filter={"f": 1})
    assert hits(store(queries, 2)) == [(1, "a", 0.5, {"doc_id": "a", "n": '{"x": 1}'}), (2, "8", 0.4, {})]
    assert Evaluator(store, [m.HitRate(1), m.MRR(2)]).evaluate(queries).summary() == {"hit_rate@1": 0.5, "mrr@2": 0.5}
    old = stores.qdrant_store("c", encode, lambda: types.SimpleNamespace(search=lambda collection_name, query_vector, limit: [{"id": None, "score": 1.0}]))
    with pytest.raises(Exception, match="no id"):
        old(queries, 1).collect()


def test_chroma(queries):
    def connect():
        def query(n_results, include, **by):
            assert by == {"query_texts": ["lamp"]} or by == {"query_texts": ["post"]}
            return {"ids": [["a", "b", "c"]], "metadatas": [[{"document": "kept"}, None]], "distances": [[0.0, 1.0]], "documents": [["x", "y", None]]}

        return types.SimpleNamespace(get_collection=lambda name: types.SimpleNamespace(query=query))

    got = hits(stores.chroma_store("c", connect)(queries, 3))
    assert got == [(1, "a", 1.0, {"document": "kept"}), (2, "b", 0.5, {"document": "y"}), (3, "c", 0.0, {})]


def test_elasticsearch(queries):
    def connect():
        def search(index, knn, size, _source):
            assert knn["num_candidates"] == 20 and knn["field"] == "v" and size == 2
            return {"hits": {"hits": [{"_id": "i", "_score": 2.0, "_source": {"doc_id": "a"}, "fields": {"t": [1]}}, {"_id": "j", "_score": 1.5}]}}

        return types.SimpleNamespace(search=search)

    assert hits(stores.elasticsearch_store("i", "v", encode, connect)(queries, 2)) == [(1, "a", 2.0, {"doc_id": "a", "fields": '{"t": [1]}'}), (2, "j", 1.5, {})]


def test_weaviate(queries):
    def connect():
        def near_vector(near_vector, limit):
            o = types.SimpleNamespace
            return o(objects=[o(uuid="u", properties={"doc_id": "a"}, metadata=o(distance=0.25)), o(uuid="w", properties={}, metadata={"certainty": 0.91, "distance": 3.0}), o(uuid="y", properties=None, metadata=None)])

        return types.SimpleNamespace(query=types.SimpleNamespace(near_vector=near_vector))

    assert [x[:3] for x in hits(stores.weaviate_store("c", encode, connect)(queries, 3))] == [(1, "a", 0.8), (2, "w", 0.91), (3, "y", 0.0)]


def test_milvus(queries):
    connect = lambda: types.SimpleNamespace(search=lambda collection_name, data, limit, partition_names: [[{"id": 5, "distance": 0.7, "entity": {"doc_id": "x"}}, {"distance": 0.6, "entity": {"doc_id": "a"}}]])
    assert [x[:3] for x in hits(stores.milvus_store("c", encode, connect, partition_names=["p"])(queries, 2))] == [(1, "5", 0.7), (2, "a", 0.6)]


def test_frameworks(queries):
    docs = [{"page_content": "text", "metadata": {"doc_id": "a", "score": 0.5}}, {"page_content": "more", "metadata": {}}]
    assert [x[:3] for x in hits(stores.framework_retriever(lambda t, k: docs)(queries, 2))] == [(1, "a", 0.5), (2, "doc_1", 0.0)]
    hay = [types.SimpleNamespace(id="h", score=None, content="c", meta={"score": 0.25})]
    assert hits(stores.framework_retriever(lambda t, k: hay, "haystack")(queries, 2)) == [(1, "h", 0.25, {"score": "0.25", "document": "c"})]


def test_errors(spark, queries):
    with pytest.raises(Exception, match="empty vector"):
        stores.milvus_store("c", lambda t: [], lambda: object())(queries, 1).collect()
    with pytest.raises(Exception, match="blank"):
        blank = spark.createDataFrame([("q", " ")], "query_id string, query_text string")
        stores.milvus_store("c", encode, lambda: object())(blank, 1).collect()
    with pytest.raises(MissingDependencyError):
        stores.needs("no_such_package_here")
