"""Readers of agent transcripts: JSON lines, compressed JSON lines and SQLite databases, as one event table.

Files are listed and read by Spark (``text`` or ``binaryFile``); what one file holds is parsed in the task that read it.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

EVENT = "source string, conversation_id string, seq bigint, role string, content string, tool_name string, tool_input string, tool_output string, reasoning string, time double, src_id string, parent_id string"
#: Line types that carry no event. Fixed values.
SKIPPED = frozenset(("summary", "file-history-snapshot", "queue-operation", "progress"))


def seconds(value: object) -> float | None:
    """Epoch seconds of a number in s, ms, µs or ns, or of an ISO time."""
    if isinstance(value, str):
        try:
            value = float(value)
        except ValueError:
            stamp = pd.to_datetime(value, errors="coerce", utc=True)
            return None if pd.isna(stamp) else stamp.timestamp()
    if not isinstance(value, int | float):
        return None
    return next((value / s for s in (1.0, 1e3, 1e6, 1e9) if 1e8 <= value / s <= 4.2e9), None)


def message_text(content: object) -> str:
    """Text of a message: a string, a block, or a list of these."""
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    if isinstance(content, dict):
        return next((message_text(content[k]) for k in ("text", "content", "parts") if content.get(k) is not None), "")
    return "\n".join(x for x in map(message_text, content) if x) if isinstance(content, list) else str(content)


def block_events(record: dict) -> Iterator[dict]:
    """The events of one line: text, reasoning, tool calls and tool results of its message."""
    if record.get("type") in SKIPPED:
        return
    message = record.get("message") if isinstance(record.get("message"), dict) else record
    role = str(message.get("role") or record.get("type") or "")
    base = {"role": role, "time": seconds(record.get("timestamp") or record.get("time") or message.get("time")), "src_id": record.get("uuid") or record.get("id"), "parent_id": record.get("parentUuid") or record.get("parent_id")}
    content = message.get("content", message.get("parts", message.get("text")))
    blocks = content if isinstance(content, list) else [content]
    for b in blocks:
        kind = b.get("type", "text") if isinstance(b, dict) else "text"
        if kind in ("thinking", "reasoning"):
            yield base | {"role": "reasoning", "reasoning": message_text(b.get("thinking") or b.get("text"))}
        elif kind in ("tool_use", "tool_call", "functionCall"):
            yield base | {"role": "tool", "tool_name": b.get("name"), "tool_input": json.dumps(b.get("input", b.get("args")), ensure_ascii=False)}
        elif kind in ("tool_result", "functionResponse"):
            yield base | {"role": "tool", "tool_output": message_text(b.get("content", b.get("output")))}
        elif said := message_text(b):
            yield base | {"content": said}


def _rows(path: str, records: Iterator[dict], source: str) -> pd.DataFrame:
    name = os.path.basename(path)
    session = name.split(".")[0]
    out = []
    for r in records:
        for e in block_events(r):
            out.append({"source": source, "conversation_id": str(r.get("sessionId") or r.get("session_id") or session), **e})
    df = pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")], dtype=object)
    df["seq"] = range(len(df))
    return df


def role_of(role: str | None) -> str:
    """The role as ``normalize_role`` gives it."""
    return T.ROLES.get((role or "").strip().lower(), "assistant")


def json_record(line: str) -> dict | None:
    """The object that a line holds; None where it is no JSON object."""
    try:
        value = json.loads(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def json_records(text: str) -> Iterator[dict]:
    for line in text.split("\n"):
        if (record := json_record(line)) is not None:
            yield record


def sqlite_records(data: bytes) -> Iterator[dict]:
    """Messages of a database with tables session, message (data: JSON) and part (data: JSON), in order."""
    with tempfile.NamedTemporaryFile(suffix=".db") as f:  # a copy that lives as long as it is read, in this task
        f.write(data)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            rows = db.execute("SELECT m.session_id, m.id, m.data, p.data FROM message m JOIN part p ON p.message_id = m.id ORDER BY m.session_id, m.id, p.id").fetchall()
        finally:
            db.close()
    for session, mid, m, p in rows:
        message, part = json.loads(m), json.loads(p)
        when = (message.get("time") or {}).get("created") if isinstance(message.get("time"), dict) else message.get("time")
        yield {"session_id": session, "id": mid, "time": when, "message": {"role": message.get("role"), "content": [part]}}


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def _read(spark: SparkSession, path: str, glob: str, source: str, parse: Callable[[bytes], Iterator[dict]], only: list[str] | None = None) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                yield _rows(p, parse(bytes(data)), source)

    out = _files(spark, path, glob).select("path", "content").mapInPandas(run, EVENT)
    if only is not None:
        out = out.where(F.col("conversation_id").isin(*only))
    return out.withColumn("role", T.normalize_role(F.col("role"))).withColumn("is_system", (F.col("role") == "user") & T.is_system_note(F.col("content")))


def read_jsonl(spark: SparkSession, path: str, source: str, only: list[str] | None = None) -> DataFrame:
    return _read(spark, path, "*.jsonl", source, lambda b: json_records(b.decode("utf-8", "replace")), only)


def read_jsonl_zstd(spark: SparkSession, path: str, source: str, only: list[str] | None = None) -> DataFrame:
    def parse(data: bytes) -> Iterator[dict]:
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as stream:
            yield from json_records(stream.read().decode("utf-8", "replace"))

    return _read(spark, path, "*.zst*", source, parse, only)


def read_sqlite(spark: SparkSession, path: str, source: str, only: list[str] | None = None) -> DataFrame:
    return _read(spark, path, "*.db", source, sqlite_records, only)


READERS = {"jsonl": read_jsonl, "jsonl_zstd": read_jsonl_zstd, "sqlite": read_sqlite}


def load(spark: SparkSession, kind: str, path: str, source: str, only: list[str] | None = None) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown kind of transcript: {kind}; known: {', '.join(READERS)}")
    return READERS[kind](spark, path, source, only)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(conversation_id, updated_at, length) without reading contents."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^/]*)?$", 1)
    return _files(spark, path, glob).select(name.alias("conversation_id"), F.col("modificationTime").cast("double").alias("updated_at"), "length")


def freshness(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return listing(spark, path, glob).agg(F.max("updated_at").alias("updated_at"))


def root_turns(events: DataFrame, rounds: int = 32) -> DataFrame:
    """``events`` plus turn_key: the user message that an event's chain of parents leads to.

    Pointers are doubled each round, so chains of 2**rounds links are followed; a broken chain ends where it breaks.
    """
    from .state import cut

    key = ["source", "conversation_id"]
    user = (F.col("role") == "user") & F.col("content").isNotNull()
    up = cut(events.where("src_id IS NOT NULL").groupBy(*key, "src_id").agg(F.max(F.when(user, F.col("src_id")).otherwise(F.col("parent_id"))).alias("up"), F.bool_or(user).alias("done")), "parents")
    for _ in range(rounds):
        a = up.alias("a").join(up.select(*key, F.col("src_id").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2")), [*key, "up"], "left")
        nxt = cut(a.select(*key, "src_id", F.when(F.col("done") | F.col("up2").isNull(), F.col("up")).otherwise(F.col("up2")).alias("up"), (F.col("done") | F.coalesce("done2", F.lit(True))).alias("done")), "parents")
        if up.where("NOT done").isEmpty():
            break
        up = nxt
    return events.join(up.select(*key, "src_id", F.col("up").alias("turn_key")), [*key, "src_id"], "left")


def sessions(events: DataFrame) -> DataFrame:
    """Conversation rows of events: counts, times, roles as a set and in order, title from the first user text."""
    first = F.min_by("content", "seq")
    return events.groupBy("source", "conversation_id").agg(F.count(F.lit(1)).alias("event_count"), F.min("time").alias("created_at"), F.max("time").alias("updated_at"), F.array_sort(F.collect_set("role")).alias("roles"), T.clip(first, 60).alias("title"))


def with_global_order(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("source", "conversation_id").orderBy(F.col("time").asc_nulls_last(), "seq")
    return events.withColumn("seq", F.row_number().over(w).cast("bigint"))
