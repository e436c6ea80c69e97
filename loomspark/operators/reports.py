"""Overviews, facets and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overview(events: DataFrame) -> DataFrame:
    """One row: events, conversations, sources, time range, mean and largest conversation. Two-level aggregation."""
    per = events.groupBy("source", "conversation_id").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("lo"), F.max("time").alias("hi"))
    return per.agg(
        F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_conversations"), F.count_distinct("source").alias("n_sources"),
        F.min("lo").alias("first_time"), F.max("hi").alias("last_time"), F.round(F.avg("n"), 1).alias("avg_events"), F.max("n").alias("max_events"),
    )


def counts(df: DataFrame, key: Column, name: str = "key", top: int | None = None) -> DataFrame:
    """Rows by a key that is not blank, most frequent first."""
    out = df.select(key.alias(name)).where(F.col(name).isNotNull() & (F.trim(name) != "")).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), name).limit(top)


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0, values)


def daily_distinct(df: DataFrame, day: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(day.alias("day")).agg(F.count_distinct(*keys).alias("n"))


def mode_first_seen(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of a group; of equally frequent ones the first seen."""
    n = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return n.groupBy(*group).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value), F.max("n").alias("n"))


def rollup_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner), by outer, and of all; ``level`` is 0, 1 or 3."""
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for several columns in one pass, by grouping sets."""
    ids = [F.col(c) for c in columns]
    out = df.groupingSets([[c] for c in ids], *ids).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        facet, value = F.when(F.col(f"_g_{c}") == 0, c).otherwise(facet), F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return out.select(facet.alias("facet"), value.alias("value"), "n")


def having(df: DataFrame, group: list[str], least: int) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def percentile_by_index(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Order statistics at index ``int(share * n)``; ranks come from a window, no group is collected."""
    w = Window.partitionBy(*group)
    ranked = df.select(*group, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    at = lambda s: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * s) + 1, F.col(value)))
    return ranked.groupBy(*group).agg(*[at(s).alias(k) for k, s in shares.items()], F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))


def latest_by(df: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(*[F.max_by(c, order).alias(c) for c in columns])
