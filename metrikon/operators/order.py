"""Global order without a single task: positions and running sums over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrikon.session import staged


def numbered(df: DataFrame, order: list[str], name: str, step: str | None = None) -> DataFrame:
    """``df`` with ``name``: the position (from 1) in the order of ``order``, or the running sum of column ``step``.

    Rows are range-partitioned and written once, so that partitions stay as they are; one offset a partition
    comes to the driver. Order columns must tell all rows apart for the positions to be the same in every run.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    amount = F.lit(1).cast("long") if step is None else F.col(step).cast("long")
    sums = {r["_part"]: r["s"] for r in ranged.groupBy("_part").agg(F.sum(amount).alias("s")).collect()}
    offsets, before = [], 0
    for part in sorted(sums):
        offsets.append((part, before))
        before += sums[part]
    table = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(F.broadcast(table), "_part").withColumn(name, F.col("_before") + F.sum(amount).over(w)).drop("_part", "_before")
