"""Consistency of the derived tables, and evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health(memories: DataFrame, units: DataFrame, vectors: DataFrame, index_ids: DataFrame) -> DataFrame:
    """(metric, n): counts that should be zero, and the totals they stand against."""
    shown = memories.where(F.col("status").isin("new", "similar")).select(F.concat(F.lit("dst_"), F.col("content_hash")).alias("src_id")).distinct()
    distilled = units.where("role = 'distilled'")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    parts = [
        n(units, "units"),
        n(distilled.join(shown, "src_id", "left_anti"), "stale_projections"),
        n(shown.join(distilled.select("src_id"), "src_id", "left_anti"), "pending_projections"),
        n(vectors.join(units.select("unit_id"), "unit_id", "left_anti"), "orphan_vectors"),
        n(units.join(vectors.select("unit_id").distinct(), "unit_id", "left_anti"), "missing_vectors"),
        n(units.join(index_ids.select("unit_id").distinct(), "unit_id", "left_anti"), "missing_index_rows"),
        n(units.where("updated_at IS NULL"), "null_updated_at"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retrieval_metrics(cases: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """recall_at_k, mrr, conv_recall, precision over ``cases`` (case_id, expect_any, gold) and ``hits`` (case_id, rank, text, conversation_id).

    A hit counts if its text holds any of the expected keywords.
    """
    h = hits.where(F.col("rank") <= k).join(F.broadcast(cases), "case_id")
    good = F.exists("expect_any", lambda w: F.contains(F.col("text"), w))
    per = h.groupBy("case_id").agg(F.min(F.when(good, F.col("rank"))).alias("first"), F.count_distinct(F.when(F.array_contains("gold", F.col("conversation_id")), F.col("conversation_id"))).alias("found"), F.count_if(F.array_contains("gold", F.col("conversation_id"))).alias("in_gold"), F.count(F.lit(1)).alias("n"))
    j = cases.join(per, "case_id", "left")
    has = F.size("gold") > 0
    return j.agg(
        F.round(F.avg(F.col("first").isNotNull().cast("int")), 3).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 3).alias("mrr"),
        F.round(F.avg(F.when(has, F.coalesce("found", F.lit(0)) / F.size("gold"))), 3).alias("conv_recall"),
        F.round(F.avg(F.when(has, F.coalesce("in_gold", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)))), 3).alias("precision"),
    )
