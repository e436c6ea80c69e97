"""State changes as tables: each function takes the tables as they are and returns them as they become.

A state table is written as a new version (``sources.state``); nothing here updates in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import events as E
from .memory import BASE_DIRECT, BASE_DISTILLED, write_outcome

KEY = ["source", "conversation_id"]
ARCHIVED = ("merged", "duplicate")


def replace_source(sessions: DataFrame, incoming: DataFrame, deleted: DataFrame, source: str) -> DataFrame:
    """Sessions after all of ``source`` are replaced by ``incoming`` (id, title, ...).

    Deleted sessions don't come back; a session keeps its uid, and a title that its user has set. New uids lie above all
    that were ever given, deleted ones included.
    """
    own = sessions.where(F.col("source") == source).select("id", F.col("session_uid").alias("old_uid"), F.when(F.col("title_custom"), F.col("title")).alias("old_title"))
    rows = incoming.withColumn("source", F.lit(source)).join(deleted.where(F.col("source") == source).select("id"), "id", "left_anti").join(own, "id", "left")
    kept = rows.where("old_uid IS NOT NULL").withColumn("session_uid", F.col("old_uid"))
    new = E.allocate_uid(rows.where("old_uid IS NULL").drop("session_uid"), sessions, deleted, ("source", "id"))
    out = kept.unionByName(new, allowMissingColumns=True).withColumn("title_custom", F.col("old_title").isNotNull()).withColumn("title", F.coalesce("old_title", "title"))
    return sessions.where(F.col("source") != source).unionByName(out.drop("old_uid", "old_title"), allowMissingColumns=True)


def delete_conversations(sessions: DataFrame, events: DataFrame, deleted: DataFrame, gone: DataFrame, at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, events, deleted) after the sessions ``gone`` (source, id) are deleted; each leaves a row in ``deleted`` with its uid."""
    key = ["source", "id"]
    hit = sessions.join(gone.select(*key).distinct(), key, "left_semi").select(*key, "session_uid", "title", F.lit(at).cast("bigint").alias("deleted_at"))
    tomb = deleted.join(hit.select(*key), key, "left_anti").unionByName(hit, allowMissingColumns=True)
    pairs = gone.select("source", F.col("id").alias("conversation_id")).distinct()
    return sessions.join(gone.select(*key), key, "left_anti"), events.join(pairs, KEY, "left_anti"), tomb


def rename(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles (source, id, title) set by users; they are marked so that an ingestion keeps them."""
    new = titles.select("source", "id", F.trim("title").alias("new_title"))
    out = sessions.join(new, ["source", "id"], "left").withColumn("title_custom", F.col("title_custom") | F.col("new_title").isNotNull())
    return out.withColumn("title", F.coalesce("new_title", "title")).drop("new_title")


def exclude(exclusions: DataFrame, added: DataFrame) -> DataFrame:
    """Exclusions (source, conversation_id, turn_key, ...) with more; one of a whole conversation clears those of its turns."""
    every = exclusions.unionByName(added.join(exclusions.select(*KEY, "turn_key"), [*KEY, "turn_key"], "left_anti").dropDuplicates([*KEY, "turn_key"]), allowMissingColumns=True)
    whole = added.where("turn_key = ''").select(*KEY).distinct().withColumn("cleared", F.lit(True))
    return every.join(whole, KEY, "left").where("turn_key = '' OR cleared IS NULL").drop("cleared")


def include(exclusions: DataFrame, removed: DataFrame) -> DataFrame:
    """Exclusions with some taken back; the whole conversation's takes all of it along."""
    rest = exclusions.join(removed.where("turn_key = ''").select(*KEY), KEY, "left_anti")
    return rest.join(removed.select(*KEY, "turn_key"), [*KEY, "turn_key"], "left_anti")


def clean_system(events: DataFrame, sessions: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, sessions) without injected events; sessions that had any get their count anew. ``targets`` limits both."""
    marked = events.where("is_system")
    if targets is not None:
        marked = marked.join(targets.select(*KEY).distinct(), KEY, "left_semi")
    touched = marked.select("source", F.col("conversation_id").alias("id")).distinct()
    left = events.join(marked.select(*KEY, "seq"), [*KEY, "seq"], "left_anti")
    n = left.groupBy("source", F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    counted = touched.join(n, ["source", "id"], "left").select("source", "id", F.coalesce("n", F.lit(0)).alias("n"))
    out = sessions.join(counted, ["source", "id"], "left").withColumn("event_count", F.coalesce("n", "event_count")).drop("n")
    return left, out


def delete_units(units: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, vectors) without those of conversations or turns in ``gone`` (source, conversation_id, turn_key; '': the whole)."""
    left = E.without_excluded(units, gone)
    return left, vectors.join(left.select(F.col("id").alias("unit_id")), "unit_id", "left_semi")


def save_direct(memories: DataFrame, incoming: DataFrame, day: Column) -> DataFrame:
    """Memories with those saved by hand, put into the bucket conversation of their day.

    One content is saved once a source, in whatever bucket; an archived one comes back as new.
    """
    rows = incoming.withColumn("conversation_id", F.concat(F.lit("direct-"), F.date_format(day, "yyyy-MM-dd"))).withColumn("content", T.redact(F.col("content")))
    rows = rows.withColumn("content_hash", T.content_hash(F.col("content"))).where(T.has_substance(F.col("content"))).withColumn("status", F.lit("new"))
    first = Window.partitionBy("source", "content_hash").orderBy("conversation_id", "content")
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    key = ["source", "content_hash"]
    back = rows.select(*key).withColumn("again", F.lit(True))
    old = memories.join(back, key, "left").withColumn("status", F.when(F.col("again") & F.col("status").isin(*ARCHIVED), "new").otherwise(F.col("status"))).drop("again")
    return old.unionByName(rows.join(memories.select(*key), key, "left_anti"), allowMissingColumns=True)


def base_values(units: DataFrame, values: DataFrame) -> DataFrame:
    """Values with a base one for each unit that has none."""
    base = F.when(F.col("role") == "distilled", BASE_DISTILLED).otherwise(BASE_DIRECT)
    missing = units.select(F.col("id").alias("unit_id"), base.alias("value")).join(values.select("unit_id"), "unit_id", "left_anti")
    return values.unionByName(missing, allowMissingColumns=True)


def save_merged(memories: DataFrame, finals: DataFrame, sources: DataFrame) -> DataFrame:
    """Memories after a merge: ``sources`` (id) are archived, ``finals`` come in under the slice key 'merge'.

    A final whose content is there already revives that row if it is archived (by this merge, maybe).
    """
    hit = sources.select("id").distinct().withColumn("merged", F.lit(True))
    old = memories.join(hit, "id", "left").withColumn("status", F.when(F.col("merged"), "merged").otherwise(F.col("status"))).drop("merged")
    out = write_outcome(finals, old).withColumn("slice_key", F.lit("merge")).withColumn("status", F.lit("new"))
    key = [*KEY, "content_hash"]
    revived = out.where("outcome = 'revived'").select(*key).withColumn("again", F.lit(True))
    old = old.join(revived, key, "left").withColumn("slice_key", F.when(F.col("again"), "merge").otherwise(F.col("slice_key"))).withColumn("status", F.when(F.col("again"), "new").otherwise(F.col("status"))).drop("again")
    return old.unionByName(out.where("outcome = 'inserted'").drop("outcome"), allowMissingColumns=True)


def pending_guard(asked: DataFrame, pending: DataFrame) -> DataFrame:
    """``asked`` (id) plus accepted, and a reason for those that are not pending."""
    there = pending.select("id").distinct().withColumn("accepted", F.lit(True))
    out = asked.select("id").distinct().join(there, "id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return out.withColumn("reason", F.when(~F.col("accepted"), "not pending"))


def drop_pending(memories: DataFrame, pending: DataFrame, asked: DataFrame, hard: bool, at: float) -> DataFrame:
    """Memories after pending ones are dropped: taken out for good, or only marked as not for pages."""
    hit = pending_guard(asked, pending).where("accepted").select("id")
    if hard:
        return memories.join(hit, "id", "left_anti")
    return memories.join(hit.withColumn("dropped", F.lit(True)), "id", "left").withColumn("wiki_ignore_at", F.when(F.col("dropped"), F.lit(at)).otherwise(F.col("wiki_ignore_at"))).drop("dropped")


def manifest_without(manifest: DataFrame, sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Manifest (id, md5, session) without what was not compiled: failed sessions and failed memories."""
    return manifest.join(sessions.select("session"), "session", "left_anti").join(ids.select("id"), "id", "left_anti")


def record_delta(previous: DataFrame, changed: DataFrame, consumed: bool, cap: int | None = 5000) -> DataFrame:
    """(source, id, status, oversized) of the next delta.

    Entries that no stage has read are carried over, new ones win. Above ``cap`` the delta is one row that says so, and
    every stage then works on all; without a cap (None) the delta is whole at any size.
    """
    merged = E.delta_merge(changed, previous.limit(0) if consumed else previous, ("source", "id"))
    if cap is None:
        return merged.select("source", "id", "status", F.lit(False).alias("oversized"))
    n = merged.agg(F.count(F.lit(1)).alias("n"))
    sized = merged.join(F.broadcast(n)).where(F.col("n") <= cap).select("source", "id", "status", F.lit(False).alias("oversized"))
    none = F.lit(None).cast("string")
    return sized.unionByName(n.where(F.col("n") > cap).select(none.alias("source"), none.alias("id"), none.alias("status"), F.lit(True).alias("oversized")))


def merge_index(into: DataFrame, other: DataFrame, edges: DataFrame, key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(rows, edges) of two indexes in one: rows of ``other`` (id, ...) that ``into`` lacks get the next ids, edges (id, ref) follow."""
    lacking = other.join(into.select(key), key, "left_anti")
    first = lacking.groupBy(key).agg(F.min("id").alias("id"))
    top = into.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = E.number_rows(first.select("id"), "id").join(F.broadcast(top)).select("id", (F.col("top") + F.col("nth") + 1).alias("new_id"))
    rows = lacking.join(fresh, "id").withColumn("id", F.col("new_id")).drop("new_id")
    known = other.select("id", key).join(into.select(key, F.col("id").alias("there")).groupBy(key).agg(F.min("there").alias("there")), key).select("id", F.col("there").alias("new_id"))
    same = lacking.select(F.col("id").alias("old"), key).join(first.withColumnRenamed("id", "kept"), key).join(fresh.withColumnRenamed("id", "kept"), "kept").select(F.col("old").alias("id"), "new_id")
    moved = edges.join(same.unionByName(known), "id").withColumn("id", F.col("new_id")).drop("new_id")
    return into.unionByName(rows, allowMissingColumns=True), moved


def sessions_with_orphans(sessions: DataFrame, audit: DataFrame) -> DataFrame:
    """Sessions and those that only an audit log (id, at) knows; the later time of both, and the number of log rows."""
    log = audit.groupBy("id").agg(F.max("at").alias("last_at"), F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n_log"))
    out = sessions.join(log, "id", "full_outer").withColumn("orphan", F.col("updated_at").isNull())
    return out.select("id", "orphan", F.coalesce("title", F.concat(F.lit("audit "), F.col("id"))).alias("title"), F.coalesce("created_at", "first_at").alias("created_at"), F.greatest("updated_at", "last_at").alias("updated_at"), F.coalesce("n_log", F.lit(0)).alias("n_log"))


def rewrite_links(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """``pages`` (page, text) with every ``[[name|shown]]`` in its final form, plus n_links, n_ok, n_fixed, n_dropped.

    ``resolved`` is (page, target, stem) for each name in a page; a name without a stem loses its brackets and keeps its
    words. Pages are split at their links and put together again, link by link.
    """
    link = r"\[\[([^\[\]]+)\]\]"
    stems = resolved.where("stem IS NOT NULL").groupBy("page").agg(F.map_from_entries(F.collect_set(F.struct("target", "stem"))).alias("stems"))
    p = pages.join(stems, "page", "left").withColumn("stems", F.coalesce("stems", F.create_map().cast("map<string,string>")))
    p = p.withColumn("gaps", F.split("text", link, -1)).withColumn("links", F.regexp_extract_all("text", F.lit(link), F.lit(1)))

    def done(raw: Column) -> Column:
        name = F.trim(F.substring_index(raw, "|", 1))
        shown = F.when(F.contains(raw, F.lit("|")), F.coalesce(F.nullif(F.trim(F.regexp_extract(raw, r"\|(.*)$", 1)), F.lit("")), name)).otherwise(name)
        stem = F.try_element_at("stems", name)
        want = F.concat(F.lit("[["), stem, F.lit("|"), shown, F.lit("]]"))
        return F.struct(F.coalesce(want, shown).alias("out"), F.when(stem.isNull(), "dropped").when(want == F.concat(F.lit("[["), raw, F.lit("]]")), "ok").otherwise("fixed").alias("fate"))

    p = p.withColumn("done", F.transform("links", done))
    n = lambda fate: F.size(F.filter("done", lambda x: x["fate"] == fate)).alias(f"n_{fate}")
    text = F.array_join(F.zip_with("gaps", F.transform("done", lambda x: x["out"]), lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
    return p.select("page", text.alias("text"), F.size("links").alias("n_links"), n("ok"), n("fixed"), n("dropped"))


def merge_plans(plans: DataFrame, inputs: DataFrame) -> DataFrame:
    """(group, id) over all batches: a batch's local group numbers become global, uncovered inputs are groups of their own.

    ``plans`` is (batch, local, id); an id that two groups claim stays with the first.
    """
    w = Window.partitionBy("id").orderBy("batch", "local")
    own = plans.join(inputs.select("id"), "id", "left_semi").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    groups = own.select("batch", "local").distinct().withColumn("group", F.row_number().over(Window.orderBy("batch", "local")) - 1)  # a row for each group
    n = groups.agg(F.count(F.lit(1)).alias("n"))
    alone = E.number_rows(inputs.select("id").distinct().join(own.select("id"), "id", "left_anti"), "id").join(F.broadcast(n))
    return own.join(groups, ["batch", "local"]).select(F.col("group").cast("bigint").alias("group"), "id").unionByName(alone.select((F.col("n") + F.col("nth")).alias("group"), "id"))


def restore_pending(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (id) with the outcome of taking a soft drop back: restored, not dropped or unknown (also one that was
    dropped for good), and the memories' new ``wiki_ignore_at``."""
    own = memories.select("id", F.col("wiki_ignore_at").alias("was"), F.lit(True).alias("there"))
    out = asked.select("id").distinct().join(own, "id", "left")
    outcome = F.when(F.col("there").isNull(), "unknown").when(F.col("was").isNull(), "not dropped").otherwise("restored")
    return out.select("id", outcome.alias("outcome"))


def with_restored(memories: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Memories after a restore."""
    back = outcomes.where("outcome = 'restored'").select("id", F.lit(True).alias("_back"))
    return memories.join(back, "id", "left").withColumn("wiki_ignore_at", F.when(F.col("_back").isNull(), F.col("wiki_ignore_at"))).drop("_back")
