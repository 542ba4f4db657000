"""References to records that do not exist at the time of the reference.

References are pre-aggregated per key and period to their number and the span of their times; a hot key is then a
handful of rows. The aggregates, not the references, meet the presence of their keys: by an anti-join those of keys that
no record has, by a join those that may lie outside of it, and all others are done with. Only the references of the
keys and periods that are left are looked at one by one: those of heavy ones against a broadcast list after a check of
its size, all others in a shuffled join. Both orphan sets are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrikon.session import staged

EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def reference_key(c: Column) -> Column:
    """Lower-cased id without outer white space of any kind; null and blank ids give null."""
    return F.nullif(F.lower(F.regexp_replace(c.cast("string"), EDGE, "")), F.lit(""))


def presence(targets: DataFrame, id_col: str, added_col: str, deleted_col: str) -> DataFrame:
    """(key, spans): the distinct spans [added, deleted) of each key; their number is that of its re-additions.

    A null start counts as present from the beginning, a null end as never deleted.
    """
    rows = targets.select(reference_key(F.col(id_col)).alias("key"), F.struct(F.col(added_col).alias("a"), F.col(deleted_col).alias("d")).alias("s")).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.collect_set("s").alias("spans"))


def _reason(refs: DataFrame) -> DataFrame:
    """Rows of refs (with ``spans``, null where the key is unknown) that are orphans, with their reason."""
    at = F.col("at")
    began = F.exists("spans", lambda s: s["a"].isNull() | (s["a"] <= at))
    there = F.exists("spans", lambda s: (s["a"].isNull() | (s["a"] <= at)) & (s["d"].isNull() | (at < s["d"])))
    reason = F.when(F.col("spans").isNull(), "missing").when(F.coalesce(there, F.lit(False)), None).when(F.coalesce(began, F.lit(False)), "deleted").otherwise("later")
    return refs.withColumn("reason", reason).where("reason IS NOT NULL").drop("spans")


def orphan_references(
    refs: DataFrame, targets: DataFrame, id_col: str = "doc_id", added_col: str = "added_at", deleted_col: str = "deleted_at", heavy_share: float = 0.002, broadcast_rows: int = 100_000, salts: int = 16
) -> DataFrame:
    """Orphans of ``refs`` (ref_table, ref_id, doc_id, at) against ``targets``: distinct (ref_table, ref_id, doc_id, reason, period).

    reason: ``missing`` (no row has the id), ``deleted`` (added by then but not present), ``later`` (added
    afterwards only). Null and blank ids are no references. A null time lies in no span: such a reference is
    ``missing`` or, if the id exists, ``later``, with a null period. Rows delivered twice count once. Columns
    beyond those named are ignored; an empty table of targets makes every reference ``missing``.
    """
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit(""))
    rows = refs.select("ref_table", F.col("ref_id").cast("string").alias("ref_id"), reference_key(F.col("doc_id")).alias("key"), "at", month.alias("month")).where("key IS NOT NULL")
    sums = staged(rows.groupBy("key", "month").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")), "references")
    spans = presence(targets, id_col, added_col, deleted_col)
    # Present throughout: some span holds both the first and the last time of the period.
    inside = F.exists("spans", lambda s: (s["a"].isNull() | (s["a"] <= F.col("first"))) & (s["d"].isNull() | (F.col("last") < s["d"])))
    unknown = sums.join(spans, "key", "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    outside = sums.join(spans, "key").where(~F.coalesce(inside, F.lit(False)))
    columns = ["key", "month", "n", "spans"]
    open_ = staged(unknown.select(columns).unionByName(outside.select(columns)), "open-references")

    total = sums.agg(F.sum("n")).first()[0] or 0
    heavy = open_.where(F.col("n") > heavy_share * total).drop("n")
    rest = open_.where(F.col("n") <= heavy_share * total).drop("n")
    # At most 1 / heavy_share rows; their references stay out of the shuffle, be they orphans or not.
    hot = F.broadcast(sums.where(F.col("n") > heavy_share * total).select("key", "month"))
    small = heavy.agg(F.sum(F.coalesce(F.size("spans"), F.lit(1)))).first()[0] or 0
    if small <= broadcast_rows:
        found = rows.join(F.broadcast(heavy), ["key", "month"])
    else:
        spread = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(salts)).cast("int")).join(spread, ["key", "month", "salt"]).drop("salt")
    orphans = _reason(found).unionByName(_reason(rows.join(hot, ["key", "month"], "left_anti").join(rest, ["key", "month"])))
    return orphans.select("ref_table", "ref_id", F.col("key").alias("doc_id"), "reason", F.nullif("month", F.lit("")).alias("period")).distinct()


def dataset_references(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(ref_table, ref_id, doc_id, at) of gold lists and of hits, repeated ids of a list included."""
    gold = queries.select(F.lit("query_examples").alias("ref_table"), F.col("query_id").alias("ref_id"), F.explode("expected_doc_ids").alias("doc_id"), F.col("created_at").alias("at"))
    hits = results.select(F.lit("retrieval_results").alias("ref_table"), F.col("result_id").cast("string").alias("ref_id"), "doc_id", F.col("retrieved_at").alias("at"))
    return gold.unionByName(hits)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per referring table, period and reason: (ref_table, period, reason, orphans)."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("orphans"))
