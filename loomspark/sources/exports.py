"""Sinks: JSON lines and Markdown by conversation, and the portable export of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_jsonl(events: DataFrame, path: str) -> None:
    """One folder a conversation, nulls left out, events in order."""
    ordered = events.repartition("source", "conversation_id").sortWithinPartitions("source", "conversation_id", "seq")
    ordered.write.mode("overwrite").partitionBy("source", "conversation_id").option("ignoreNullFields", "true").json(path)


def read_audit(spark: SparkSession, path: str, schema: str, last: int, time: str = "ts") -> DataFrame:
    """The last entries of a log of JSON lines, newest first; lines that are no JSON are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL").drop("_bad").orderBy(F.desc(time)).limit(last)


def event_markdown() -> Column:
    body = F.coalesce("content", "tool_output", F.lit(""))
    return F.concat(F.lit("**"), F.col("role"), F.lit("**\n\n"), body)


def conversation_markdown(events: DataFrame, titles: DataFrame) -> DataFrame:
    """(source, conversation_id, value): a conversation as one Markdown text."""
    parts = F.array_sort(F.collect_list(F.struct("seq", event_markdown().alias("md"))))
    body = events.groupBy("source", "conversation_id").agg(F.array_join(F.transform(parts, lambda x: x["md"]), "\n\n").alias("body"))
    return body.join(titles, ["source", "conversation_id"], "left").select("source", "conversation_id", F.concat(F.lit("# "), F.coalesce("title", "conversation_id"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("value"))


def export_markdown(events: DataFrame, titles: DataFrame, path: str) -> None:
    conversation_markdown(events, titles).write.mode("overwrite").partitionBy("source", "conversation_id").text(path)


def export_memories(memories: DataFrame, titles: DataFrame, path: str) -> DataFrame:
    """Write memories with titles as JSON lines; returns the manifest: counts by type and status."""
    out = memories.join(titles, ["source", "conversation_id"], "left")
    out.write.mode("overwrite").json(f"{path}/memories")
    manifest = memories.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("content", 256))), ""), 256).alias("sha256"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest
