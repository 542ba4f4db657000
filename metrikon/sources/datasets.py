"""Evaluation datasets from JSON and CSV files, as QUERIES and DOCUMENTS frames."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrikon.functions.text import distinct_texts, falsy_or, strip
from metrikon.log import get_logger
from metrikon.schema import ValidationError

log = get_logger(__name__)


@dataclass(frozen=True)
class EvaluationDataset:
    """Queries and documents; either may be empty."""

    queries: DataFrame
    documents: DataFrame

    @classmethod
    def from_json(cls, spark: SparkSession, path: str | os.PathLike) -> EvaluationDataset:
        return from_json(spark, path)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str | os.PathLike) -> EvaluationDataset:
        return from_csv(spark, path)


def _existing(spark: SparkSession, path: str | os.PathLike) -> str:
    """The path, checked in the file system it names."""
    text = os.fspath(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text if "://" in text else os.path.abspath(text))
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise ValidationError(f"no such file: {text}")
    return p.toString()


def _fail(message: str, *more: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *more)).cast("string")


def _text(item: Column, *keys: str) -> Column:
    """First non-empty of the keys, stripped."""
    return F.coalesce(*(F.nullif(strip(F.try_variant_get(item, f"$.{k}", "string")), F.lit("")) for k in keys))


def _list(item: Column, *keys: str) -> Column:
    """First non-empty list of the keys, its texts stripped, each once."""
    found = [F.try_variant_get(item, f"$.{k}", "array<string>") for k in keys]
    return distinct_texts(F.coalesce(*(F.when(F.size(a) > 0, a) for a in found)))


def parse_query(item: Column, pos: Column) -> list[Column]:
    """QUERIES columns of one JSON item; older key names are read, unknown ones ignored, a missing id or text is an error."""
    query_id, text = _text(item, "query_id", "id"), _text(item, "query_text", "query")
    where = F.concat(F.lit(" of query "), (pos + 1).cast("string"))
    return [
        F.coalesce(query_id, _fail("no query_id", where)).alias("query_id"),
        F.coalesce(text, _fail("no query_text", where)).alias("query_text"),
        _list(item, "expected_doc_ids", "relevant_doc_ids").alias("expected_doc_ids"),
        _list(item, "expected_answers").alias("expected_answers"),
        pos.cast("long").alias("query_pos"),
    ]


def _array(root: Column, key: str) -> Column:
    """The list of this key, an empty one if there is no such key; a value of another kind is an error."""
    value = F.try_variant_get(root, f"$.{key}", "variant")
    listed = F.try_variant_get(root, f"$.{key}", "array<variant>")
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(value.isNull(), F.array().cast("array<variant>")).when(is_list, listed).otherwise(F.raise_error(F.lit(f"{key} must be a list")).cast("array<variant>"))


def from_json(spark: SparkSession, path: str | os.PathLike) -> EvaluationDataset:
    """One JSON object with the lists ``queries`` and ``documents``, both empty by default."""
    raw = spark.read.text(_existing(spark, path), wholetext=True)
    root = raw.select(F.parse_json("value").alias("v"))
    known = root.select(F.when(F.coalesce(F.schema_of_variant("v"), F.lit("")).startswith("OBJECT"), F.col("v")).otherwise(F.raise_error(F.lit("the root of the JSON must be an object")).cast("variant")).alias("v"))
    lists = known.select(*(_array(F.col("v"), c).alias(c) for c in ("queries", "documents")))
    pos = F.col("pos")
    q = lists.select(F.posexplode("queries").alias("pos", "item")).select(*parse_query(F.col("item"), pos))
    d = lists.select(F.posexplode("documents").alias("pos", "item"))
    item = F.col("item")
    meta = F.try_variant_get(item, "$.metadata", "map<string,string>")
    given = F.coalesce(F.schema_of_variant(F.try_variant_get(item, "$.metadata", "variant")), F.lit("VOID"))
    bad = ~(given.startswith("OBJECT") | (given == "VOID"))
    d = d.select(
        F.coalesce(_text(item, "doc_id"), _fail("no doc_id of document ", (pos + 1).cast("string"))).alias("doc_id"),
        F.coalesce(F.try_variant_get(item, "$.text", "string"), F.lit("")).alias("text"),
        F.when(bad, F.raise_error(F.lit("metadata must be an object")).cast("map<string,string>")).otherwise(F.coalesce(meta, F.create_map().cast("map<string,string>"))).alias("metadata"),
        pos.cast("long").alias("doc_pos"),
    )
    log.info("dataset opened", extra={"path": os.fspath(path), "format": "json"})
    return EvaluationDataset(q, d)


def list_cell(c: Column) -> Column:
    """A list in a CSV cell: a JSON list, else parts between commas; JSON of another kind is an error.

    A list must end with its bracket, for the parser would let further text pass.
    """
    cell = strip(F.coalesce(c, F.lit("")))
    v = F.try_parse_json(cell)
    kind = F.schema_of_variant(v)
    closed = cell.startswith("[") & cell.endswith("]")
    as_list = F.coalesce(kind.startswith("ARRAY"), F.lit(False)) & closed
    other = v.isNotNull() & ~F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    listed = F.try_variant_get(v, "$", "array<string>")
    return distinct_texts(F.when(cell == "", F.array().cast("array<string>")).when(as_list, listed).when(other, F.raise_error(F.lit("a list cell must hold a JSON list")).cast("array<string>")).otherwise(F.split(cell, ",")))


def from_csv(spark: SparkSession, path: str | os.PathLike) -> EvaluationDataset:
    """A CSV file with a header; a missing id becomes q{row}, a blank question is an error. It has no documents.

    Rows are numbered in file order, which takes the file in one partition: it is a hand-made list of queries.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(_existing(spark, path)).coalesce(1)
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    cols = [has(c).alias(c) for c in ("query_id", "id", "query_text", "query", "expected_doc_ids", "relevant_doc_ids", "expected_answers")]
    rows = raw.select(*cols, F.monotonically_increasing_id().alias("query_pos"))
    number = (F.col("query_pos") + 1).cast("string")
    gold = F.when(falsy_or(strip(F.col("expected_doc_ids"))).isNotNull(), list_cell(F.col("expected_doc_ids"))).otherwise(list_cell(F.col("relevant_doc_ids")))
    q = rows.select(
        F.coalesce(falsy_or(strip(F.col("query_id")), strip(F.col("id"))), F.concat(F.lit("q"), number)).alias("query_id"),
        F.coalesce(falsy_or(strip(F.col("query_text")), strip(F.col("query"))), _fail("no query_text in row ", number)).alias("query_text"),
        gold.alias("expected_doc_ids"),
        list_cell(F.col("expected_answers")).alias("expected_answers"),
        "query_pos",
    )
    none = spark.createDataFrame([], "doc_id string, text string, metadata map<string,string>, doc_pos long")
    log.info("dataset opened", extra={"path": os.fspath(path), "format": "csv"})
    return EvaluationDataset(q, none)
