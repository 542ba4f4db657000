"""Result normalisers of vector databases and retrieval frameworks: raw hits to (doc_id, score, metadata).

Each is a set of Column expressions over the hit's fields; precedence of ids and scores is that of the
database named. ``hits_run`` numbers the hits of a query by their position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrikon.functions.text import falsy_or


def distance_score(distance: Column) -> Column:
    """1 / (1 + d) for a distance, negative ones counted as 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(distance.cast("double"), F.lit(0.0)))


def field(metadata: Column, key: str) -> Column:
    return F.try_element_at(metadata, F.lit(key))


def required(doc_id: Column) -> Column:
    """The id; a hit without one is an error."""
    return F.when(doc_id.isNotNull(), doc_id).otherwise(F.raise_error(F.lit("a hit has no id")).cast("string"))


@dataclass(frozen=True)
class HitNormalizer:
    """doc_id and score expressions of one kind of hit."""

    name: str
    doc_id: Callable[[], Column]
    score: Callable[[], Column]

    def normalize(self, hits: DataFrame, metadata: Column | None = None) -> DataFrame:
        extra = metadata if metadata is not None else F.create_map().cast("map<string,string>")
        return hits.select("query_id", "pos", required(self.doc_id()).alias("doc_id"), self.score().alias("score"), extra.alias("metadata"))


def qdrant(id_field: str = "doc_id") -> HitNormalizer:
    """Hits (id, score, payload): the payload's id before the point's, the raw score."""
    return HitNormalizer("qdrant", lambda: F.coalesce(field(F.col("payload"), id_field), F.col("id").cast("string")), lambda: F.col("score").cast("double"))


def chroma(distance_to_score: Callable[[Column], Column] = distance_score) -> HitNormalizer:
    """Hits (id, distance): the id, and a score from the distance, 0 without one."""
    return HitNormalizer("chroma", lambda: F.col("id").cast("string"), lambda: F.when(F.col("distance").isNull(), 0.0).otherwise(distance_to_score(F.col("distance"))))


def elasticsearch(id_field: str = "doc_id") -> HitNormalizer:
    """Hits (_id, _score, _source): the source's id before the hit's, the raw score, 0 without one."""
    return HitNormalizer("elasticsearch", lambda: F.coalesce(field(F.col("_source"), id_field), F.col("_id").cast("string")), lambda: F.coalesce(F.col("_score").cast("double"), F.lit(0.0)))


def weaviate(id_field: str = "doc_id", distance_to_score: Callable[[Column], Column] = distance_score) -> HitNormalizer:
    """Hits (uuid, properties, certainty, distance, score): certainty, else the distance's score, else the score, else 0."""

    def score() -> Column:
        d = F.col("distance")
        return F.coalesce(F.col("certainty").cast("double"), F.when(d.isNotNull(), distance_to_score(d)), F.col("score").cast("double"), F.lit(0.0))

    return HitNormalizer("weaviate", lambda: F.coalesce(field(F.col("properties"), id_field), F.col("uuid").cast("string")), score)


def milvus(id_field: str = "doc_id", distance_to_score: Callable[[Column], Column] | None = None) -> HitNormalizer:
    """Hits (id, distance, entity): the hit's id before the entity's; the distance is the score as it stands."""
    change = distance_to_score or (lambda d: d.cast("double"))
    return HitNormalizer("milvus", lambda: F.coalesce(F.col("id").cast("string"), field(F.col("entity"), id_field)), lambda: F.coalesce(change(F.col("distance")), F.lit(0.0)))


def langchain() -> HitNormalizer:
    """Documents (page_content, metadata): metadata doc_id, else id, else doc_{position}; metadata score, else _score, else 0."""
    m = lambda k: field(F.col("metadata"), k)
    doc_id = lambda: F.coalesce(falsy_or(m("doc_id"), m("id")), F.concat(F.lit("doc_"), F.col("pos").cast("string")))
    return HitNormalizer("langchain", doc_id, lambda: F.coalesce(m("score"), m("_score"), F.lit("0")).cast("double"))


def haystack() -> HitNormalizer:
    """Documents (id, score, content, meta): the document's id, else meta doc_id, id, doc_{position}; its score, else meta score, else 0."""
    m = lambda k: field(F.col("meta"), k)
    doc_id = lambda: F.coalesce(falsy_or(F.col("id"), m("doc_id"), m("id")), F.concat(F.lit("doc_"), F.col("pos").cast("string")))
    return HitNormalizer("haystack", doc_id, lambda: F.coalesce(F.nullif(F.col("score").cast("double"), F.lit(0.0)), m("score").cast("double"), F.lit(0.0)))


def framework_documents(run: DataFrame, text_key: str = "document") -> DataFrame:
    """A run as framework documents: (query_id, rank, page_content, metadata), id and score put into the metadata if absent."""
    text = F.coalesce(field(F.col("metadata"), text_key), F.lit(""))
    rest = F.map_filter("metadata", lambda k, _: k != text_key)
    own = F.create_map(F.lit("doc_id"), F.col("doc_id"), F.lit("score"), F.col("score").cast("string"))
    own = F.map_filter(own, lambda k, _: ~F.map_contains_key(rest, k))
    return run.select("query_id", "rank", text.alias("page_content"), F.map_concat(rest, own).alias("metadata"))


def hits_run(normalized: DataFrame, k: int | None = None) -> DataFrame:
    """RUN rows from normalised hits: rank by position from 1."""
    w = Window.partitionBy("query_id").orderBy("pos")
    run = normalized.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "doc_id", "score", "metadata")
    return run if k is None else run.where(F.col("rank") <= k)
