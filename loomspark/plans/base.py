"""How queries are registered, and the driver's tables in the terms of the data model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of a module, with the SQL that each is checked against."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turns_as_events(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` as source events: a time step of a minute a turn, an hour a conversation."""
    c = table(spark, sf, "conversations")
    return c.select(
        F.lit("conv").alias("source"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
        (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("time"),
        (F.col("role") == "system").alias("is_system"),
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("src_id"),
    )


#: The same as a common table expression.
EV = """ev AS (SELECT 'conv' AS source, CAST(conv_id AS VARCHAR) AS conversation_id, turn AS seq, role, text AS content,
  1704067200 + conv_id * 3600 + turn * 60 AS time, role = 'system' AS is_system, 'c' || conv_id || '-' || turn AS src_id FROM conversations)"""


def docs_as_memories(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as memories of conversations (a source and a language each)."""
    d = table(spark, sf, "documents")
    kinds = F.array(*[F.lit(x) for x in ("decision", "fact", "preference", "lesson")])
    states = F.array(*[F.lit(x) for x in ("new", "new", "similar", "duplicate", "merged")])
    return d.select(
        F.col("doc_id").alias("id"),
        "source",
        F.col("lang").alias("conversation_id"),
        F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("type"),
        F.get(states, (F.col("doc_id") % 5).cast("int")).alias("status"),
        F.col("text").alias("content"),
        F.md5("text").alias("fingerprint"),
        (F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
    )


MEM = """mem AS (SELECT doc_id AS id, source, lang AS conversation_id, (['decision','fact','preference','lesson'])[doc_id % 4 + 1] AS type,
  (['new','new','similar','duplicate','merged'])[doc_id % 5 + 1] AS status, text AS content, md5(text) AS fingerprint, 1704067200 + doc_id * 60 AS created_at FROM documents)"""
