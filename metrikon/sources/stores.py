"""Vector databases as retrievers: executors ask, the plan reads the answers.

A store is a way to connect (run once in each Python worker), a way to ask, and the normaliser of its hits.
The raw hits of every query become rows, and ids, scores and ranks are Column expressions over them, so all
stores share one path from hits to a run. Any client object with the database's usual method will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrikon.schema import MissingDependencyError, ValidationError, require_positive, require_text
from metrikon.sources import connectors

Encode = Callable[[str], Iterable[float]]
RAW = "query_id string, pos int, id string, score double, distance double, certainty double, payload map<string,string>"


def part(item: Any, key: str, default: Any = None) -> Any:
    """A field of a hit, be it a mapping or an object."""
    return item.get(key, default) if isinstance(item, Mapping) else getattr(item, key, default)


def as_texts(values: Any) -> dict[str, str]:
    """A payload as texts: nested values as JSON, nulls left out."""
    if not isinstance(values, Mapping):
        return {}
    return {str(k): v if isinstance(v, str) else json.dumps(v, default=str, sort_keys=True) for k, v in values.items() if v is not None}


def needs(module: str) -> Any:
    """Import an optional package or say what is missing."""
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise MissingDependencyError(f"the package {module} is not installed") from e


@dataclass(frozen=True)
class VectorStore:
    """``ask(client, text, vector, k)`` gives raw hits as dicts with some of the fields of RAW."""

    connect: Callable[[], Any]
    ask: Callable[[Any, str, list[float] | None, int], list[dict[str, Any]]]
    normalizer: connectors.HitNormalizer
    encode: Encode | None = None
    options: Mapping[str, Any] = field(default_factory=dict)

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        """RAW rows of all queries; a blank question or an empty vector is an error."""
        k = require_positive(k, "k")
        connect, ask, encode = self.connect, self.ask, self.encode

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = None
            names = [c.split()[0] for c in RAW.split(", ")]
            for b in batches:
                client = client if client is not None else connect()
                rows = []
                for query_id, text in zip(b["query_id"], b["query_text"], strict=True):
                    text = require_text(text, "query")
                    vector = None if encode is None else [float(x) for x in encode(text)]
                    if vector == []:
                        raise ValidationError("the encoder gave an empty vector")
                    for pos, hit in enumerate(ask(client, text, vector, k)):
                        rows.append({"query_id": query_id, "pos": pos, "id": None, "score": None, "distance": None, "certainty": None, "payload": {}} | hit)
                yield pd.DataFrame(rows, columns=names)

        return queries.select("query_id", "query_text").mapInPandas(run, RAW)

    def __call__(self, queries: DataFrame, k: int) -> DataFrame:
        """A run (query_id, rank, doc_id, score, metadata): what the evaluator expects of a retriever."""
        return connectors.hits_run(self.normalizer.normalize(self.hits(queries, k), F.col("payload")), k)


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def _number(value: Any) -> float | None:
    return None if value is None else float(value)


def qdrant_store(collection: str, encode: Encode, connect: Callable[[], Any] | None = None, *, url: str = "http://localhost:6333", id_field: str = "doc_id", query_filter: Any = None, search_params: Any = None) -> VectorStore:
    """Points by ``query_points``, or ``search`` of older clients."""
    extra = {k: v for k, v in (("query_filter", query_filter), ("search_params", search_params)) if v is not None}
    collection = require_text(collection, "collection")

    def ask(client: Any, _: str, vector: list[float] | None, k: int) -> list[dict[str, Any]]:
        if hasattr(client, "query_points"):
            found = client.query_points(collection_name=collection, query=vector, limit=k, **extra)
            found = part(found, "points", found)
        else:
            found = client.search(collection_name=collection, query_vector=vector, limit=k, **extra)
        return [{"id": _text(part(p, "id")), "score": float(part(p, "score", 0.0)), "payload": as_texts(part(p, "payload"))} for p in found]

    return VectorStore(connect or (lambda: needs("qdrant_client").QdrantClient(url=url)), ask, connectors.qdrant(id_field), encode)


def chroma_store(collection: str, connect: Callable[[], Any] | None = None, *, encode: Encode | None = None, distance_to_score: Callable[[Column], Column] = connectors.distance_score) -> VectorStore:
    """A collection asked by text, or by vector with an encoder; documents join the metadata."""
    collection = require_text(collection, "collection")

    def ask(client: Any, text: str, vector: list[float] | None, k: int) -> list[dict[str, Any]]:
        found = client if hasattr(client, "query") else client.get_collection(name=collection)
        by = {"query_texts": [text]} if vector is None else {"query_embeddings": [vector]}
        answer = found.query(n_results=k, include=["metadatas", "distances", "documents"], **by)
        ids, metas, distances, documents = ((answer.get(c) or [[]])[0] or [] for c in ("ids", "metadatas", "distances", "documents"))
        at = lambda a, i: a[i] if i < len(a) else None
        return [{"id": str(x), "distance": _number(at(distances, i)), "payload": as_texts({"document": at(documents, i)}) | as_texts(at(metas, i))} for i, x in enumerate(ids)]

    return VectorStore(connect or (lambda: needs("chromadb").Client()), ask, connectors.chroma(distance_to_score), encode)


def elasticsearch_store(index: str, vector_field: str, encode: Encode, connect: Callable[[], Any] | None = None, *, id_field: str = "doc_id", filter: Any = None, num_candidates: int | None = None, source: Any = True, fields: list[str] | None = None) -> VectorStore:  # noqa: A002
    """kNN search, ten candidates a result unless ``num_candidates`` says otherwise."""
    index, vector_field = require_text(index, "index"), require_text(vector_field, "vector_field")

    def ask(client: Any, _: str, vector: list[float] | None, k: int) -> list[dict[str, Any]]:
        knn = {"field": vector_field, "query_vector": vector, "k": k, "num_candidates": num_candidates or 10 * k} | ({} if filter is None else {"filter": filter})
        answer = client.search(index=index, knn=knn, size=k, _source=source, **({"fields": list(fields)} if fields else {}))
        found = part(part(answer, "hits", {}), "hits", []) or []
        return [{"id": _text(part(h, "_id")), "score": float(part(h, "_score", 0.0)), "payload": as_texts({"fields": part(h, "fields") or None}) | as_texts(part(h, "_source"))} for h in found]

    n = connectors.HitNormalizer("elasticsearch", lambda: F.coalesce(connectors.field(F.col("payload"), id_field), F.col("id")), lambda: F.coalesce("score", F.lit(0.0)))
    return VectorStore(connect or (lambda: needs("elasticsearch").Elasticsearch()), ask, n, encode)


def weaviate_store(collection: str, encode: Encode, connect: Callable[[], Any] | None = None, *, id_field: str = "doc_id", query_filter: Any = None, return_properties: Any = None, return_metadata: Any = None, distance_to_score: Callable[[Column], Column] = connectors.distance_score, near_vector_kwargs: Mapping[str, Any] | None = None) -> VectorStore:
    """Objects by ``query.near_vector`` of a collection, or of a client that has it."""
    extra = {k: v for k, v in (("filters", query_filter), ("return_properties", return_properties), ("return_metadata", return_metadata)) if v is not None} | dict(near_vector_kwargs or {})
    collection = require_text(collection, "collection")

    def ask(client: Any, _: str, vector: list[float] | None, k: int) -> list[dict[str, Any]]:
        found = client if hasattr(client, "query") else client.collections.get(collection)
        answer = found.query.near_vector(near_vector=vector, limit=k, **extra)
        out = []
        for o in part(answer, "objects", answer):
            meta = part(o, "metadata", {})
            raw_id = part(o, "uuid")
            out.append({"id": _text(part(o, "id") if raw_id is None else raw_id), "payload": as_texts(part(o, "properties"))} | {c: _number(part(meta, c)) for c in ("certainty", "distance", "score")})
        return out

    score = lambda: F.coalesce("certainty", F.when(F.col("distance").isNotNull(), distance_to_score(F.col("distance"))), "score", F.lit(0.0))
    n = connectors.HitNormalizer("weaviate", lambda: F.coalesce(connectors.field(F.col("payload"), id_field), F.col("id")), score)
    return VectorStore(connect or (lambda: needs("weaviate").connect_to_local()), ask, n, encode)


def milvus_store(collection: str, encode: Encode, connect: Callable[[], Any] | None = None, *, uri: str = "http://localhost:19530", token: str | None = None, id_field: str = "doc_id", search_filter: str = "", output_fields: list[str] | None = None, search_params: Any = None, anns_field: str | None = None, partition_names: list[str] | None = None, distance_to_score: Callable[[Column], Column] | None = None) -> VectorStore:
    """Hits by ``search``; the hit's own id goes before the entity's, the distance is the score."""
    options = {"filter": search_filter or None, "output_fields": output_fields, "search_params": search_params, "anns_field": anns_field, "partition_names": partition_names}
    extra = {k: v for k, v in options.items() if v is not None}
    collection = require_text(collection, "collection")

    def ask(client: Any, _: str, vector: list[float] | None, k: int) -> list[dict[str, Any]]:
        answer = client.search(collection_name=collection, data=[vector], limit=k, **extra)
        answer = list(answer) if isinstance(answer, list) else []
        found = answer[0] if answer and isinstance(answer[0], list) else answer
        return [{"id": _text(part(h, "id")), "distance": _number(part(h, "distance", part(h, "score", 0.0))), "payload": as_texts(part(h, "entity"))} for h in found]

    change = distance_to_score or (lambda d: d)
    n = connectors.HitNormalizer("milvus", lambda: F.coalesce("id", connectors.field(F.col("payload"), id_field)), lambda: F.coalesce(change(F.col("distance")), F.lit(0.0)))
    connect = connect or (lambda: needs("pymilvus").MilvusClient(uri=uri, **({"token": token} if token else {})))
    return VectorStore(connect, ask, n, encode)


def framework_retriever(invoke: Callable[[str, int], Iterable[Any]], kind: str = "langchain", text_field: str = "document") -> Callable[[DataFrame, int], DataFrame]:
    """A retriever of a framework as one of ours: ``invoke(text, k)`` gives its documents.

    kind ``langchain`` reads page_content and metadata, ``haystack`` id, score, content and meta.
    """
    if kind not in ("langchain", "haystack"):
        raise ValidationError("kind must be langchain or haystack")
    content, meta = ("page_content", "metadata") if kind == "langchain" else ("content", "meta")

    def ask(_: Any, text: str, __: Any, k: int) -> list[dict[str, Any]]:
        out = []
        for d in list(invoke(text, k))[:k]:
            body = part(d, content)
            own = {"id": _text(part(d, "id")), "score": _number(part(d, "score"))} if kind == "haystack" else {}
            out.append(own | {"payload": as_texts(part(d, meta)) | ({text_field: str(body)} if body is not None else {})})
        return out

    base = connectors.langchain() if kind == "langchain" else connectors.haystack()

    class _Store(VectorStore):
        def __call__(self, queries: DataFrame, k: int) -> DataFrame:
            rows = self.hits(queries, k).withColumn("meta", F.col("payload")).withColumn("metadata", F.col("payload"))
            return connectors.hits_run(base.normalize(rows, F.col("payload")), k)

    return _Store(lambda: True, ask, base)


def llamaindex_retriever(retrieve: Callable[[str, int], Iterable[tuple[str, float, Mapping[str, Any]]]], k: int = 4, text_field: str = "document") -> Any:
    """A retriever for LlamaIndex over ``retrieve(text, k)``, which gives (doc_id, score, metadata) in rank order.

    The node's text is the metadata's ``text_field``; id and score go into the metadata unless it has them.
    """
    base, schema = needs("llama_index.core.retrievers").BaseRetriever, needs("llama_index.core.schema")
    k, text_field = require_positive(k, "k"), require_text(text_field, "text_field")

    def nodes(question: Any) -> list[Any]:
        out = []
        for doc_id, score, metadata in list(retrieve(require_text(part(question, "query_str"), "query"), k))[:k]:
            rest = {"doc_id": doc_id, "score": score} | dict(metadata or {})
            text = str(rest.pop(text_field, ""))
            out.append(schema.NodeWithScore(node=schema.TextNode(text=text, id_=doc_id, metadata=rest), score=score))
        return out

    class _Retriever(base):
        def _retrieve(self, query_bundle: Any) -> list[Any]:
            return nodes(query_bundle)

        async def _aretrieve(self, query_bundle: Any) -> list[Any]:
            return nodes(query_bundle)

    return _Retriever()
