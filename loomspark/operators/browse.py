"""Lists, reports and counters: what a reader pages through."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import search as S

KEY = ("source", "conversation_id")
CONFIDENCE, STATUS = ("high", "medium", "low"), ("new", "similar", "merged", "duplicate")
ACTIVE = ("new", "similar")


def among(column: str, values: Iterable | None) -> Column:
    """Membership in a caller's list; no list, or an empty one, admits all."""
    values = list(values or ())
    return F.col(column).isin(*values) if values else F.lit(True)


def rank_of(column: str, order: tuple[str, ...]) -> Column:
    """Position of a value in a fixed order; anything else comes after."""
    out = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == value, i).otherwise(out)
    return out


def page_of(rows: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page (from 1) in a total order. Spark keeps ``page * size`` rows a task and sorts no more."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def exclusion_state(exclusions: DataFrame) -> DataFrame:
    """(source, conversation_id, whole, n_turns) from exclusions with a turn key that is '' for a whole conversation."""
    whole = F.coalesce("turn_key", F.lit("")) == ""
    return exclusions.groupBy(*KEY).agg(F.bool_or(whole).alias("whole"), F.count_if(~whole).alias("n_turns"))


def conversations(sessions: DataFrame, exclusions: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Sessions (source, id, title, cwd, ...) with workspace and exclusion badge; a missing model comes from ``models``."""
    state = exclusion_state(exclusions).withColumnRenamed("conversation_id", "id")
    out = sessions.join(state, ["source", "id"], "left").withColumn("workspace", T.workspace_of(F.col("cwd")))
    out = out.withColumns({"whole": F.coalesce("whole", F.lit(False)), "n_turns": F.coalesce("n_turns", F.lit(0))})
    if models is not None:
        found = models.select("source", "id", F.col("model").alias("seen_model"))
        out = out.join(found, ["source", "id"], "left").withColumn("model", F.coalesce(F.nullif("model", F.lit("")), "seen_model", F.lit(""))).drop("seen_model")
    return out


def filter_conversations(listed: DataFrame, sources=None, workspaces=None, created: tuple[float | None, float | None] = (None, None), text: str | None = None, hits: DataFrame | None = None) -> DataFrame:
    """By source, workspace, creation time, and text: in title or folder, or among ``hits`` (ids found in events)."""
    out = listed.where(among("source", sources) & among("workspace", workspaces))
    low, high = created
    if low is not None or high is not None:
        out = out.where(F.col("created_at").between(0 if low is None else low, float("inf") if high is None else high))
    if text:
        own = T.contains_folded(F.col("title"), F.lit(text)) | F.coalesce(T.contains_folded(F.col("cwd"), F.lit(text)), F.lit(False))
        if hits is not None:
            out = out.join(hits.select("id", F.lit(True).alias("in_events")).distinct(), "id", "left")
            own |= F.coalesce("in_events", F.lit(False))
        out = out.where(own).drop("in_events")
    return out


def list_order(key: str, descending: bool, *tie: str) -> list[Column]:
    """Unknown values count as largest: last when ascending, first when descending."""
    return [F.col(key).desc_nulls_first() if descending else F.col(key).asc_nulls_last(), *map(F.col, tie)]


def memory_report(memories: DataFrame, units: DataFrame, values: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distilled memories and those saved by hand, with unit, value and conversation title.

    A memory's unit is the one whose ``src_id`` is 'dst_' and its hash. A unit of source ``memory`` stands for itself,
    unless a memory names it by the slice key 'mcp:' and its trace id.
    """
    title = sessions.select("source", F.col("id").alias("conversation_id"), F.col("title").alias("conversation_title"))
    value = values.select("unit_id", "value", "manual_value")
    anchor = units.select(F.col("id").alias("unit_id"), "src_id")
    own = memories.withColumn("src_id", F.concat(F.lit("dst_"), "content_hash")).join(anchor, "src_id", "left").withColumn("origin", F.lit("distilled"))
    by_hand = units.where("source = 'memory'").withColumn("slice_key", F.concat(F.lit("mcp:"), F.expr("substr(legacy_id, 5)"))).join(memories.select("slice_key"), "slice_key", "left_anti")
    by_hand = by_hand.select(F.lit("manual").alias("origin"), "id", "source", "conversation_id", F.lit("manual").alias("type"), F.col("text").alias("content"), F.lit("new").alias("status"), F.col("time").alias("created_at"), F.col("id").alias("unit_id"))
    columns = ["origin", "id", "source", "conversation_id", "type", "topic", "content", "confidence", "status", "created_at", "unit_id"]
    return own.select(*columns).unionByName(by_hand, allowMissingColumns=True).join(value, "unit_id", "left").join(title, list(KEY), "left")


def filter_report(report: DataFrame, sources=None, types=None, status: str | Iterable | None = None, confidences=None, conversation: str | None = None, sessions: DataFrame | None = None, text: str | None = None) -> DataFrame:
    """``status`` is 'active' (new or similar), 'all' or a list; ``sessions`` keeps those of its conversations only."""
    wanted = ACTIVE if status == "active" else None if status in (None, "all") else [status] if isinstance(status, str) else status
    out = report.where(among("source", sources) & among("type", types) & among("status", wanted) & among("confidence", confidences))
    if conversation:
        out = out.where(F.col("conversation_id") == conversation)
    if sessions is not None:
        out = out.join(sessions.select(*KEY).distinct(), list(KEY), "left_semi")
    if text:
        found = [F.coalesce(T.contains_folded(F.col(c), F.lit(text)), F.lit(False)) for c in ("content", "topic")]
        out = out.where(found[0] | found[1])
    return out


def report_order(key: str = "time", descending: bool = True) -> list[Column]:
    """Confidence and status by meaning, memories without a value last, origin and id on a tie."""
    value = F.coalesce("manual_value", "value")
    by = {"time": F.col("created_at"), "value": value, "type": F.col("type"), "source": F.col("source"), "confidence": rank_of("confidence", CONFIDENCE), "status": rank_of("status", STATUS), "conversation": F.coalesce("conversation_title", "conversation_id")}
    main = by.get(key, by["time"])
    return [*([value.isNull()] if key == "value" else []), main.desc_nulls_last() if descending else main.asc_nulls_first(), F.col("origin"), F.col("id")]


def search_events(events: DataFrame, sessions: DataFrame, phrase: str, fields: tuple[str, ...], source: str | None = None, role: str | None = None) -> DataFrame:
    """Events that hold the phrase in any field, with title and folder of their session."""
    hit = F.lit(False)
    for f in fields:
        hit |= F.coalesce(T.contains_folded(F.col(f), F.lit(phrase)), F.lit(False))
    found = events.where(hit & among("source", [source] if source else None) & among("role", [role] if role else None))
    return found.join(sessions.select("source", F.col("id").alias("conversation_id"), "title", "cwd", "updated_at"), list(KEY))


def after(rows: DataFrame, keys: tuple[str, ...], last: tuple) -> DataFrame:
    """Rows behind a place in the order of ``keys``: the next batch of a scan."""
    return rows.where(F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, last, strict=True)]))


def whole_turns(events: DataFrame, asked: DataFrame, turn: str = "turn_key") -> DataFrame:
    """All events of the turns that hold an asked event (source, conversation_id, seq)."""
    key = [*KEY, turn]
    turns = events.join(asked.select(*KEY, "seq"), [*KEY, "seq"], "left_semi").select(*key).distinct()
    return events.join(turns, key, "left_semi")


def keep_last(rows: DataFrame, key: str, position: str, cap: int) -> DataFrame:
    """Each key at its first position; of those the last ``cap``, in order (a queue that drops its oldest)."""
    first = rows.groupBy(key).agg(F.min(position).alias(position))
    return first.orderBy(F.desc(position), F.desc(key)).limit(cap)


def failures(log: DataFrame) -> DataFrame:
    """(stage, target, kind, at) of targets whose latest entry is a failure; an entry without a kind resolves."""
    last = log.groupBy("stage", "target").agg(F.max(F.struct("at", "id", "kind")).alias("x"))
    return last.select("stage", "target", "x.kind", "x.at").where("kind IS NOT NULL")


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each model; prices (model, price_in, price_out) are per million tokens."""
    total = usage.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return total.join(prices, "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("price_in", "price_out")


def should_push(category: Column, level: Column, categories: dict[str, bool], levels: dict[str, bool]) -> Column:
    """A category's switch decides where it is on; else the level's."""
    on = lambda c, switches: c.isin(*[k for k, v in switches.items() if v]) if any(switches.values()) else F.lit(False)
    return F.coalesce(on(category, categories), F.lit(False)) | F.coalesce(on(level, levels), F.lit(False))


def needle_counts(units: DataFrame, needles: DataFrame, text: str = "text") -> DataFrame:
    """(needle, n): how many texts contain each needle, whatever the case.

    Needles are a stated set, looked for in blocks: texts are lower-cased once a block and neither multiplied nor shuffled;
    only (needle, count) rows are.
    """
    own = needles.select("needle").distinct().withColumn("low", F.lower("needle"))
    asked = sorted({r["low"] for r in own.where("needle <> ''").select("low").collect()})
    texts = units.select(F.lit(0).cast("bigint").alias("unit_id"), F.col(text).alias("text"))
    found = None
    for part in [asked[i : i + S.LITERALS] for i in range(0, len(asked), S.LITERALS)] or [[]]:
        one = S.needles_in(texts, part, ("text",)).groupBy(F.col("needle").alias("low")).agg(F.count(F.lit(1)).alias("n"))
        found = one if found is None else found.unionByName(one)
    return own.join(found, "low", "left").select("needle", F.coalesce("n", F.lit(0)).alias("n"))


def hit_view(hits: DataFrame, units: DataFrame, page_chars: int = 600) -> DataFrame:
    """Hits with kind, origin and text; a page's text is cut at ``page_chars``."""
    kind = T.kind_of(F.col("src_id"))
    text = F.when(kind == "wiki", T.clip(F.col("text"), page_chars)).otherwise(F.col("text"))
    return hits.join(units, "unit_id").select("query_id", "unit_id", "rank", kind.alias("kind"), T.origin_of(F.col("source")).alias("origin"), text.alias("text"))


def injected_context(hits: DataFrame, top: int = 3, chars: int = 160) -> DataFrame:
    """(query_id, context): the first snippets of each query, a line each."""
    few = hits.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", T.clip(F.col("text"), chars).alias("t")))).alias("x"))
    return few.select("query_id", F.array_join(F.transform("x", lambda r: F.concat(F.lit("- "), r["t"])), "\n").alias("context"))


def resolve_refs(refs: DataFrame, units: DataFrame) -> DataFrame:
    """``refs`` (ref) plus unit_id: by legacy id, then src id, then 'unit:<n>', then plain digits; null if none fits."""
    legacy = units.where("legacy_id IS NOT NULL").groupBy(F.col("legacy_id").alias("ref")).agg(F.min("id").alias("by_legacy"))
    src = units.where("src_id IS NOT NULL").groupBy(F.col("src_id").alias("ref")).agg(F.min("id").alias("by_src"))
    number = F.expr("try_cast(coalesce(nullif(regexp_extract(ref, '^unit:(\\\\d+)$', 1), ''), nullif(regexp_extract(ref, '^(\\\\d+)$', 1), '')) AS bigint)")
    there = units.select(F.col("id").alias("number"), F.col("id").alias("by_number"))
    out = refs.withColumn("number", number).join(legacy, "ref", "left").join(src, "ref", "left").join(there, "number", "left")
    return out.select("ref", F.coalesce("by_legacy", "by_src", "by_number").alias("unit_id"))


def origin_time(memories: DataFrame, events: DataFrame) -> DataFrame:
    """(id, at): the first time of a memory's turn, else the time that it was made."""
    first = events.where("turn_key IS NOT NULL").groupBy(*KEY, "turn_key").agg(F.min("time").alias("first"))
    return memories.join(first, [*KEY, "turn_key"], "left").select("id", F.coalesce("first", "created_at").alias("at"))


def unscored(traces: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """The newest traces without a score."""
    return traces.join(scores.select("trace_id"), "trace_id", "left_anti").orderBy(F.desc("at"), F.desc("trace_id")).limit(limit)


def seen_models(events: DataFrame) -> DataFrame:
    """(source, id, model): the model that most events of a conversation name, the first seen on a tie."""
    n = events.where("model IS NOT NULL AND model <> ''").groupBy(*KEY, "model").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("n"), "first")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", F.col("conversation_id").alias("id"), "model")
