"""Joins of many rows with a table whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_safe_join(rows: DataFrame, table: DataFrame, on: list[str], by: str, how: str = "inner", broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """``rows`` joined with the staged ``table``, each key of which may stand in a third of ``rows``.

    Up to ``broadcast_rows`` rows the table is broadcast; beyond, it is repeated for each of ``salts`` salts, and the
    rows of a key are spread over them by a hash of the column ``by``.
    """
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(table), on, how)
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(spread, [*on, "salt"], how).drop("salt")
