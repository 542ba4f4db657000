"""Readers of the built-in formats with a fixed schema, and writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from metrikon.schema import ValidationError

FORMATS = ("parquet", "orc", "json", "csv")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """A table of one of FORMATS; with a schema nothing is inferred."""
    if kind not in FORMATS:
        raise ValidationError(f"format must be one of {FORMATS}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("header", True).format(kind).load(path) if kind == "csv" else reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    if kind not in FORMATS:
        raise ValidationError(f"format must be one of {FORMATS}")
    writer = df.write.mode("overwrite").format(kind)
    (writer.option("header", True) if kind == "csv" else writer).partitionBy(*partition_by).save(path)
