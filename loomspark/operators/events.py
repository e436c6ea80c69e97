"""Events: eligibility, turns, numbering, exclusions and incremental state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.state import cut


def eligible(events: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Events whose text is worth indexing."""
    return events.where(F.col("role").isin(*roles) & ~T.is_blank(F.col("content")) & ~F.coalesce(F.col("is_system"), F.lit(False)))


def turn_anchor(events: DataFrame, key: tuple[str, ...] = ("source", "conversation_id"), order: str = "seq", root: Column | None = None, out: str = "turn_key") -> DataFrame:
    """``events`` plus the id of the last user event so far."""
    own = (F.col("role") == "user") & ~F.coalesce(F.col("is_system"), F.lit(False)) if root is None else root
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(out, F.last(F.when(own, F.col("src_id")), ignorenulls=True).over(w))


def renumber(events: DataFrame, key: tuple[str, ...] = ("source", "conversation_id"), time: str = "time", position: str = "seq", out: str = "new_seq") -> DataFrame:
    """``events`` plus 1..n by time, unknown times last, else in the given order."""
    w = Window.partitionBy(*key).orderBy(F.col(time).asc_nulls_last(), F.col(position))
    return events.withColumn(out, F.row_number().over(w))


def without_excluded(events: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop excluded conversations and turns. An exclusion with an empty turn key is of the whole conversation.

    Two anti joins instead of one with OR, which would be a nested loop. An event without turn key is only dropped with
    its whole conversation.
    """
    key = ["source", "conversation_id"]
    whole = exclusions.where(F.coalesce("turn_key", F.lit("")) == "").select(*key).distinct()
    turns = exclusions.where(F.col("turn_key") != "").select(*key, "turn_key").distinct()
    return events.join(whole, key, "left_anti").join(turns, [*key, "turn_key"], "left_anti")


def without_tombstones(rows: DataFrame, tombstones: DataFrame, key: tuple[str, ...] = ("source", "conversation_id")) -> DataFrame:
    return rows.join(tombstones.select(*key).distinct(), list(key), "left_anti")


def turn_view(events: DataFrame, turn: str = "turn_key") -> DataFrame:
    """One row a turn: the user's and the agent's text in order, first appearance, size."""
    key = F.coalesce(F.col(turn), F.concat(F.lit("seq:"), F.col("seq")))
    said = F.array_sort(F.collect_list(F.struct("seq", "role", "content")))
    text = lambda pick: F.array_join(F.transform(F.filter("said", pick), lambda x: x["content"]), "\n")
    out = events.groupBy("source", "conversation_id", key.alias(turn)).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_events"), said.alias("said"))
    return out.select("source", "conversation_id", turn, "first_seq", "n_events", text(lambda x: x["role"] == "user").alias("user_text"), text(lambda x: x["role"] != "user").alias("agent_text"))


def upsert_status(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("source", "conversation_id"), force: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """(key..., status): added, updated, unchanged, or kept where the new listing lacks the session."""
    k = list(key)
    a = old.select(*k, F.col("updated_at").alias("u0"), F.col("event_count").alias("n0"), F.lit(True).alias("o"))
    b = new.select(*k, F.col("updated_at").alias("u1"), F.col("event_count").alias("n1"), F.lit(True).alias("n"))
    changed = F.lit(force) | (F.abs(F.col("u1") - F.col("u0")) >= tolerance) | (F.col("n0") != F.col("n1"))
    return a.join(b, k, "full_outer").select(*k, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "kept").when(changed, "updated").otherwise("unchanged").alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("source", "conversation_id"), sticky: dict[str, str] | None = None) -> DataFrame:
    """New rows win over old ones with their key; a ``sticky`` column keeps its old value where its flag is set."""
    k = list(key)
    for column, flag in (sticky or {}).items():
        held = old.where(F.col(flag)).select(*k, F.col(column).alias("_held"))
        new = new.join(held, k, "left").withColumn(column, F.coalesce("_held", column)).withColumn(flag, F.col("_held").isNotNull()).drop("_held")
    return old.join(new.select(*k), k, "left_anti").unionByName(new, allowMissingColumns=True)


def delta_merge(new: DataFrame, carried: DataFrame, key: tuple[str, ...] = ("source", "conversation_id")) -> DataFrame:
    """New delta entries and those carried over that no new one replaces."""
    k = list(key)
    return new.unionByName(carried.join(new.select(*k), k, "left_anti"))


def allocate_uid(rows: DataFrame, existing: DataFrame, tombstones: DataFrame, key: tuple[str, ...] = ("source", "conversation_id")) -> DataFrame:
    """Session numbers above all that were ever given, in the order of the key, which doesn't repeat."""
    top = existing.select("session_uid").unionByName(tombstones.select("session_uid")).agg(F.coalesce(F.max("session_uid"), F.lit(0))).first()[0]
    numbered = number_rows(rows.withColumn("_key", F.struct(*key)), "_key", "_n").drop("_key")
    return numbered.withColumn("session_uid", F.col("_n") + F.lit(top + 1)).drop("_n")


def number_rows(rows: DataFrame, order: str, out: str = "nth") -> DataFrame:
    """``rows`` plus 0, 1, 2... in the order of a column without repeats, numbered in ranges and not in one task."""
    part = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "numbered")  # ranges are drawn once
    n = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    start = n.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return part.withColumn("_at", place).join(F.broadcast(start), "_part").withColumn(out, (F.col("_start") + F.col("_at") - 1).cast("bigint")).drop("_part", "_at", "_start")


def pair_calls(log: DataFrame, call_id: str = "call_id", phase: str = "phase", time: str = "ts") -> DataFrame:
    """Calls with their results; a call without result is pending."""
    calls = log.where(F.col(phase) == "call").select(call_id, F.col(time).alias("called_at"))
    results = log.where(F.col(phase) == "result").groupBy(call_id).agg(F.min(time).alias("done_at"))
    return calls.join(results, call_id, "left").withColumn("pending", F.col("done_at").isNull())


def shared_turns(events: DataFrame, turn: str = "turn_key") -> DataFrame:
    """Turn keys that occur in more than one conversation: (turn, source, conversation_id, n_others).

    Grouped by turn instead of joined with itself, which would make all pairs of a group.
    """
    places = events.where(F.col(turn).isNotNull()).select(turn, "source", "conversation_id").distinct()
    n = places.groupBy(turn).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return places.join(n, turn).select(turn, "source", "conversation_id", (F.col("_n") - 1).alias("n_others"))
