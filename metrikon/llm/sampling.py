"""Samples with target shares of categories, from mergeable per-category reservoirs.

Each eligible id gets a uniform 64-bit priority from a hash of the id and the seed. The reservoir of a category
is kept as cells by the leading bits of the priority, each with its count and its ids in order of priority: cells
add up over partitions in any order, and the ids with the smallest priorities are a uniform sample of any size up
to the category's. The rows are read once to fill the cells; a quota may be as large as its category, so a cell
keeps all its ids, and there are so many cells that one of them stays small. After the final counts a quota is trimmed
from the cells: all below the one it ends in and the first ids of that cell, so no category, however large, is sorted
in one task. A category from which the trim takes less than its target needs is exhausted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from metrikon.session import staged

# The categories that may be sampled.
CATEGORIES = ("direct_fact", "paraphrase", "keyword_search", "specific_detail", "broad_summary", "out_of_context")


def category_key(c: Column) -> Column:
    """Trimmed, lower-cased, runs of spaces or hyphens as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]+", "_")


def reservoirs(rows: DataFrame, id_col: str, category_col: str, categories: tuple[str, ...] = CATEGORIES, seed: int = 7, cell_bits: int = 12) -> DataFrame:
    """(id, category, priority, cell): one row an eligible distinct id. An id under two categories keeps the smaller."""
    keyed = rows.select(F.col(id_col).alias("id"), category_key(F.col(category_col)).alias("category")).where(F.col("id").isNotNull() & F.col("category").isin(*categories))
    one = keyed.groupBy("id").agg(F.min("category").alias("category"))
    one = one.withColumn("priority", F.xxhash64("id", F.lit(seed)))
    return one.withColumn("cell", F.shiftrightunsigned("priority", 64 - cell_bits).cast("int"))


def merged_cells(one: DataFrame) -> DataFrame:
    """(category, cell, count, ids): the reservoirs of ``reservoirs`` merged by cell, ids as (priority, id) in this order."""
    return one.groupBy("category", "cell").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("priority", "id"))).alias("ids"))


def cell_bits_for(rows: DataFrame, per_cell: int = 10_000) -> int:
    """Leading bits of the priority such that a cell holds about ``per_cell`` ids even if one category holds all rows."""
    return min(30, max(4, math.ceil(math.log2(max(1, rows.count()) / per_cell + 1))))


def staged_reservoirs(rows: DataFrame, id_col: str, category_col: str, seed: int, cell_bits: int | None) -> DataFrame:
    bits = cell_bits_for(rows) if cell_bits is None else cell_bits
    return staged(merged_cells(reservoirs(rows, id_col, category_col, seed=seed, cell_bits=bits)), "reservoirs")


#: Targets are a hand-made table and are broadcast up to this many; more of them are joined.
MOST_TARGETS = 10_000


def quotas(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """Targets with plan size, rows needed, rows available and the feasible quota; integer division throughout.

    A target needs max(min_rows, size * target_permille div 1000) rows; null numbers count as 0. A plan whose
    needs exceed its size keeps them: minima go before the size. Repeated targets count once.
    """
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    t = targets.select("plan_id", "category", zero("target_permille").alias("target_permille"), zero("min_rows").alias("min_rows"), zero("sample_permille").alias("sample_permille")).distinct()
    t = t.withColumn("n", F.lit(total).cast("long")).withColumn("size", F.expr("n * sample_permille div 1000"))
    t = t.join(F.broadcast(counts), "category", "left").withColumn("available", F.coalesce("count", F.lit(0)))
    t = t.withColumn("needed", F.greatest("min_rows", F.expr("size * target_permille div 1000")))
    return t.select("plan_id", "category", "size", "needed", "available", F.least("needed", "available").alias("quota"))


def trimmed(targets: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quotas, ends): the targets with their quotas, and how many ids each plan takes of each cell of a category."""
    per_cell = cells.select("category", "cell", "count")
    q = quotas(targets, per_cell.groupBy("category").agg(F.sum("count").alias("count")))
    few = targets.limit(MOST_TARGETS + 1).count() <= MOST_TARGETS
    wanted = q.where("quota > 0").select("plan_id", "category", "quota")
    # Where in the order of cells does each quota end?
    before = F.sum("count").over(Window.partitionBy("plan_id", "category").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    ends = per_cell.join(F.broadcast(wanted) if few else wanted, "category").withColumn("before", F.coalesce(before, F.lit(0)))
    return q, ends.where("before < quota").withColumn("take", F.least(F.col("count"), F.col("quota") - F.col("before"))).select("plan_id", "category", "cell", "take")


def exhausted(targets: DataFrame, rows: DataFrame, id_col: str = "query_id", category_col: str = "category", seed: int = 7, cell_bits: int | None = None) -> DataFrame:
    """(plan_id, category, needed, available) of the targets of which the trim of the reservoirs leaves less than needed.

    ``available`` is what the trim takes, all of an exhausted category; nulls, repeated rows and empty tables as in ``sample``.
    """
    q, ends = trimmed(targets, staged_reservoirs(rows, id_col, category_col, seed, cell_bits))
    taken = ends.groupBy("plan_id", "category").agg(F.sum("take").alias("taken"))
    met = q.alias("q").join(taken.alias("t"), F.col("q.plan_id").eqNullSafe(F.col("t.plan_id")) & F.col("q.category").eqNullSafe(F.col("t.category")), "left")
    out = met.select("q.plan_id", "q.category", "needed", F.coalesce("taken", F.lit(0)).alias("available"))
    return out.where("available < needed")


def sample(targets: DataFrame, rows: DataFrame, id_col: str = "query_id", category_col: str = "category", seed: int = 7, cell_bits: int | None = None) -> DataFrame:
    """(plan_id, id, category): for each plan a uniform sample of its feasible quota in every category.

    Null ids and categories outside the eligible ones take no part; a repeated id is one row; an empty table
    gives an empty sample; columns with other names are ignored. Ties in priority go by id.
    """
    cells = staged_reservoirs(rows, id_col, category_col, seed, cell_bits)
    _, ends = trimmed(targets, cells)
    taken = cells.select("category", "cell", "ids").join(ends, ["category", "cell"])
    return taken.select("plan_id", F.explode(F.slice("ids", 1, F.col("take").cast("int"))).alias("s"), "category").select("plan_id", "s.id", "category")
