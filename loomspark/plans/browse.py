"""Lists, reports and counters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import browse as B
from ..operators import events as E
from .base import Registry, table

query = Registry()


def sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions in four sources, some without a folder, a creation time or a model."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("event_count"))
    k = F.col("conv_id")
    return c.select(
        F.concat(F.lit("s"), k % 4).alias("source"), k.cast("string").alias("id"), F.concat(F.lit("Topic "), k % 13).alias("title"), F.when(k % 11 != 0, F.concat(F.lit("/home/u/p"), k % 7)).alias("cwd"),
        F.when(k % 17 != 0, 1704067200 + k * 3600).alias("created_at"), (1704067200 + k % 50 * 86400 + F.col("event_count") * 60).alias("updated_at"), "event_count",
        F.when(k % 3 != 0, F.concat(F.lit("m"), k % 2)).alias("model"), (k + 1).alias("session_uid"), (k % 5 == 0).alias("title_custom"),
    )


SES = """ses AS (SELECT 's' || (conv_id % 4) AS source, CAST(conv_id AS VARCHAR) AS id, 'Topic ' || (conv_id % 13) AS title, CASE WHEN conv_id % 11 <> 0 THEN '/home/u/p' || (conv_id % 7) END AS cwd,
  CASE WHEN conv_id % 17 <> 0 THEN 1704067200 + conv_id * 3600 END AS created_at, 1704067200 + conv_id % 50 * 86400 + count(*) * 60 AS updated_at, count(*) AS event_count,
  CASE WHEN conv_id % 3 <> 0 THEN 'm' || (conv_id % 2) END AS model, conv_id + 1 AS session_uid, conv_id % 5 = 0 AS title_custom FROM conversations GROUP BY conv_id)"""


def events(s, d):
    """The sessions' events with turn keys."""
    c, k, n = table(s, d, "conversations"), F.col("conv_id"), F.col("turn")
    e = c.select(
        F.concat(F.lit("s"), k % 4).alias("source"), k.cast("string").alias("conversation_id"), n.alias("seq"), "role", F.col("text").alias("content"), F.when(n % 5 == 0, F.concat(F.lit("$ ls "), F.col("text"))).alias("shell_cmd"),
        (1704067200 + k * 3600 + n * 60).alias("time"), (F.col("role") == "system").alias("is_system"), F.concat(F.lit("c"), k, F.lit("-"), n).alias("src_id"), F.when((F.col("role") == "assistant") & (n % 4 != 1), F.concat(F.lit("m"), (k + n) % 3)).alias("model"),
    )
    return E.turn_anchor(e)


EVS = """evs AS (SELECT *, last_value(CASE WHEN role = 'user' THEN src_id END IGNORE NULLS) OVER (PARTITION BY source, conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_key FROM
  (SELECT 's' || (conv_id % 4) AS source, CAST(conv_id AS VARCHAR) AS conversation_id, turn AS seq, role, text AS content, CASE WHEN turn % 5 = 0 THEN '$ ls ' || text END AS shell_cmd, 1704067200 + conv_id * 3600 + turn * 60 AS time,
  role = 'system' AS is_system, 'c' || conv_id || '-' || turn AS src_id, CASE WHEN role = 'assistant' AND turn % 4 <> 1 THEN 'm' || ((conv_id + turn) % 3) END AS model FROM conversations))"""


def exclusions(s, d):
    e = events(s, d)
    no = F.col("conversation_id").cast("bigint") % 10
    whole = e.where(no == 3).select("source", "conversation_id", F.lit("").alias("turn_key")).distinct()
    return whole.unionByName(e.where(no.isin(3, 4) & (F.col("role") == "user")).select("source", "conversation_id", F.col("src_id").alias("turn_key")))


EXC = """exc AS (SELECT DISTINCT source, conversation_id, '' AS turn_key FROM evs WHERE CAST(conversation_id AS BIGINT) % 10 = 3 UNION ALL SELECT source, conversation_id, src_id FROM evs WHERE CAST(conversation_id AS BIGINT) % 10 IN (3, 4) AND role = 'user')"""


def units(s, d):
    """Documents as units: of messages, memories (distilled and by hand) and pages."""
    k = F.col("doc_id")
    src = F.when(k % 4 == 1, F.concat(F.lit("dst_"), F.substring(F.sha2("text", 256), 1, 16))).when(k % 4 == 2, F.concat(F.lit("mcp_"), k)).when(k % 4 == 3, F.concat(F.lit("wiki_"), k)).otherwise(F.concat(F.lit("msg"), k))
    return table(s, d, "documents").select(
        k.alias("id"), src.alias("src_id"), F.when(k % 4 == 2, F.concat(F.lit("mcp_t"), k)).alias("legacy_id"), F.when(k % 4 == 2, "memory").when(k % 12 == 3, "feed").otherwise(F.col("source")).alias("source"), (k % 100).cast("string").alias("conversation_id"),
        F.when(k % 4 == 1, "distilled").otherwise("user").alias("role"), "text", (1704067200 + k % 97 * 60).alias("time"),
    )


UNI = """uni AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 1 THEN 'dst_' || substr(sha256(text), 1, 16) WHEN 2 THEN 'mcp_' || doc_id WHEN 3 THEN 'wiki_' || doc_id ELSE 'msg' || doc_id END AS src_id, CASE WHEN doc_id % 4 = 2 THEN 'mcp_t' || doc_id END AS legacy_id,
  CASE WHEN doc_id % 4 = 2 THEN 'memory' WHEN doc_id % 12 = 3 THEN 'feed' ELSE source END AS source, CAST(doc_id % 100 AS VARCHAR) AS conversation_id, CASE WHEN doc_id % 4 = 1 THEN 'distilled' ELSE 'user' END AS role, text, 1704067200 + doc_id % 97 * 60 AS time FROM documents)"""


def memories(s, d):
    """Every third document as a memory; some were saved by hand before."""
    k = F.col("doc_id")
    pick = lambda options, by: F.get(F.array(*[F.lit(x) for x in options]), (by % len(options)).cast("int"))
    return table(s, d, "documents").where(k % 3 != 0).select(
        k.alias("id"), F.concat(F.lit("s"), k % 100 % 4).alias("source"), (k % 100).cast("string").alias("conversation_id"), pick(("decision", "fact", "lesson"), k).alias("type"), F.when(k % 5 != 0, F.col("lang")).alias("topic"), F.col("text").alias("content"),
        pick(("high", "medium", "low", "odd"), k).alias("confidence"), pick(("new", "similar", "merged", "new", "duplicate"), k).alias("status"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"), F.when(k % 2 == 0, F.concat(F.lit("mcp:t"), k)).otherwise("whole").alias("slice_key"),
        F.concat(F.lit("c"), k % 100, F.lit("-"), k % 6).alias("turn_key"), (1704067200 + k % 31 * 3600).alias("created_at"),
    )


MMS = """mms AS (SELECT doc_id AS id, 's' || (doc_id % 100 % 4) AS source, CAST(doc_id % 100 AS VARCHAR) AS conversation_id, (['decision','fact','lesson'])[doc_id % 3 + 1] AS type, CASE WHEN doc_id % 5 <> 0 THEN lang END AS topic, text AS content, (['high','medium','low','odd'])[doc_id % 4 + 1] AS confidence,
  (['new','similar','merged','new','duplicate'])[doc_id % 5 + 1] AS status, substr(sha256(text), 1, 16) AS content_hash, CASE WHEN doc_id % 2 = 0 THEN 'mcp:t' || doc_id ELSE 'whole' END AS slice_key, 'c' || (doc_id % 100) || '-' || (doc_id % 6) AS turn_key, 1704067200 + doc_id % 31 * 3600 AS created_at FROM documents WHERE doc_id % 3 <> 0)"""


def values(s, d):
    return table(s, d, "labels").select(F.col("doc_id").alias("unit_id"), (F.col("quality") * 0.5).alias("value"), F.when(F.col("doc_id") % 7 == 0, 0.9).alias("manual_value"))


VAL = "val AS (SELECT doc_id AS unit_id, quality * 0.5 AS value, CASE WHEN doc_id % 7 = 0 THEN 0.9 END AS manual_value FROM labels)"
_STATE = "sta AS (SELECT source, conversation_id, bool_or(turn_key = '') AS whole, count(*) FILTER (turn_key <> '') AS n_turns FROM exc GROUP BY ALL)"


@query(f"WITH {EVS}, {EXC}, {_STATE} SELECT * FROM sta")
def exclusion_summary(s, d):
    return B.exclusion_state(exclusions(s, d))


@query(f"""WITH {SES}, {EVS}, {EXC}, {_STATE}, mo AS (SELECT source, conversation_id AS id, model FROM (SELECT source, conversation_id, model, count(*) AS n, min(seq) AS f FROM evs WHERE model IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source, conversation_id ORDER BY n DESC, f) = 1),
l AS (SELECT ses.source, ses.id, title, coalesce(nullif(regexp_extract(cwd, '([^/]+)$', 1), ''), '(unknown)') AS workspace, created_at, updated_at, coalesce(ses.model, mo.model, '') AS model, coalesce(whole, false) AS whole, coalesce(n_turns, 0) AS n_turns
FROM ses LEFT JOIN sta ON sta.source = ses.source AND sta.conversation_id = ses.id LEFT JOIN mo ON mo.source = ses.source AND mo.id = ses.id)
SELECT * FROM l WHERE source IN ('s1', 's2', 's3') AND workspace <> 'p3' AND workspace IN ('p0', 'p1', 'p2', 'p4', '(unknown)') ORDER BY created_at DESC NULLS FIRST, id LIMIT 20 OFFSET 10""")
def conversation_page(s, d):
    """A page of the conversation list: source and workspace filters, exclusion badges, missing models filled in."""
    e = events(s, d)
    listed = B.conversations(sessions(s, d), exclusions(s, d), B.seen_models(e))
    some = B.filter_conversations(listed, ["s1", "s2", "s3"], ["p0", "p1", "p2", "p4", "(unknown)"])
    return B.page_of(some, B.list_order("created_at", True, "id"), 2, 10).unionByName(B.page_of(some, B.list_order("created_at", True, "id"), 3, 10)).select("source", "id", "title", "workspace", "created_at", "updated_at", "model", "whole", "n_turns")


@query(f"""WITH {SES}, {EVS} SELECT source, id, title, cwd FROM ses WHERE created_at BETWEEN 1704067200 + 36000 AND 1704067200 + 36000000 AND (contains(lower(title), 'topic 1') OR contains(lower(coalesce(cwd, '')), 'topic 1') OR id IN (SELECT conversation_id FROM evs WHERE contains(lower(content), 'the thing')))""")
def conversation_search(s, d):
    hits = events(s, d).where(T.contains_folded(F.col("content"), "the thing")).select(F.col("conversation_id").alias("id"))
    listed = B.conversations(sessions(s, d), exclusions(s, d))
    return B.filter_conversations(listed, created=(1704067200 + 36000, 1704067200 + 36000000), text="topic 1", hits=hits).select("source", "id", "title", "cwd")


_REPORT = f"""{SES}, {UNI}, {MMS}, {VAL}, rep AS (SELECT 'distilled' AS origin, m.id, m.source, m.conversation_id, m.type, m.topic, m.content, m.confidence, m.status, m.created_at, u.id AS unit_id FROM mms m LEFT JOIN uni u ON u.src_id = 'dst_' || m.content_hash
  UNION ALL SELECT 'manual', id, source, conversation_id, 'manual', NULL, text, NULL, 'new', time, id FROM uni WHERE source = 'memory' AND NOT EXISTS (SELECT 1 FROM mms dm WHERE dm.slice_key = 'mcp:' || substr(uni.legacy_id, 5))),
  r AS (SELECT rep.*, v.value, v.manual_value, c.title AS conversation_title FROM rep LEFT JOIN val v ON v.unit_id = rep.unit_id LEFT JOIN ses c ON c.source = rep.source AND c.id = rep.conversation_id)"""


def _report(s, d):
    return B.memory_report(memories(s, d), units(s, d), values(s, d), sessions(s, d))


@query(f"WITH {_REPORT} SELECT origin, id, unit_id, value, manual_value, conversation_title, md5(content) AS content FROM r")
def report_union(s, d):
    """All memories, distilled and by hand, with unit, value and title."""
    return _report(s, d).select("origin", "id", "unit_id", "value", "manual_value", "conversation_title", F.md5("content").alias("content"))


@query(f"""WITH {_REPORT} SELECT origin, id, unit_id, coalesce(manual_value, value) AS v FROM r WHERE status IN ('new', 'similar') AND type IN ('decision', 'lesson', 'manual') AND (contains(lower(content), 'de') OR contains(lower(topic), 'de'))
ORDER BY (value IS NULL AND manual_value IS NULL), coalesce(manual_value, value) DESC, origin, id, unit_id LIMIT 40 OFFSET 40""")
def report_by_value(s, d):
    some = B.filter_report(_report(s, d), types=["decision", "lesson", "manual"], status="active", text="de")
    return B.page_of(some, [*B.report_order("value"), F.col("unit_id")], 2, 40).select("origin", "id", "unit_id", F.coalesce("manual_value", "value").alias("v"))


@query(f"""WITH {_REPORT} SELECT origin, id, unit_id, confidence, status FROM r WHERE confidence IN ('high', 'low', 'odd') AND source || '/' || conversation_id IN (SELECT source || '/' || id FROM ses WHERE session_uid BETWEEN 1 AND 60)
ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END DESC, origin, id, unit_id LIMIT 30""")
def report_by_confidence(s, d):
    own = sessions(s, d).where("session_uid BETWEEN 1 AND 60").select("source", F.col("id").alias("conversation_id"))
    some = B.filter_report(_report(s, d), confidences=["high", "low", "odd"], sessions=own)
    return B.page_of(some, [*B.report_order("confidence"), F.col("unit_id")], 1, 30).select("origin", "id", "unit_id", "confidence", "status")


@query(f"WITH {_REPORT} SELECT 'type' AS facet, type AS value, count(*) AS n FROM r GROUP BY type UNION ALL SELECT 'status', status, count(*) FROM r GROUP BY status UNION ALL SELECT 'source', source, count(*) FROM r GROUP BY source")
def report_facets(s, d):
    from ..operators import reports as R

    return R.facets(_report(s, d), ["type", "status", "source"])


@query(f"WITH {SES} SELECT DISTINCT coalesce(nullif(regexp_extract(cwd, '([^/]+)$', 1), ''), '(unknown)') AS workspace FROM ses")
def workspaces(s, d):
    return sessions(s, d).select(T.workspace_of(F.col("cwd")).alias("workspace")).distinct()


@query(f"WITH {SES}, {EVS} SELECT 'conversations' AS metric, count(*) AS n FROM ses UNION ALL SELECT 'events', count(*) FROM evs UNION ALL SELECT 'source ' || source, count(*) FROM ses GROUP BY source UNION ALL SELECT 'role ' || role, count(*) FROM evs GROUP BY role")
def store_stats(s, d):
    c, e = sessions(s, d), events(s, d)
    n = F.count(F.lit(1)).alias("n")
    by = lambda df, col: df.groupBy(F.concat(F.lit(f"{col} "), F.col(col)).alias("metric")).agg(n)
    return c.agg(n).select(F.lit("conversations").alias("metric"), "n").unionByName(e.agg(n).select(F.lit("events").alias("metric"), "n")).unionByName(by(c, "source")).unionByName(by(e, "role"))


@query(f"WITH {UNI} SELECT count(DISTINCT source || '/' || conversation_id) AS n_conversations, count(*) AS n_units, count(*) FILTER (starts_with(src_id, 'dst_') OR starts_with(src_id, 'mcp_')) AS n_memories, round(count(v.vec_id) / count(*), 4) AS coverage FROM uni LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = uni.id")
def engine_overview(s, d):
    have = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("v")).distinct()
    u = units(s, d).join(have, "id", "left")
    return u.agg(F.count_distinct(F.concat_ws("/", "source", "conversation_id")).alias("n_conversations"), F.count(F.lit(1)).alias("n_units"), F.count_if(T.kind_of(F.col("src_id")) == "memory").alias("n_memories"), F.round(F.count("v") / F.count(F.lit(1)), 4).alias("coverage"))


@query(f"WITH {MMS} SELECT count(*) AS n, count(*) FILTER (status IN ('new', 'similar')) AS n_active, count(DISTINCT source || '/' || conversation_id) AS n_conversations, count(DISTINCT content_hash) AS n_contents, max(created_at) AS last_at FROM mms")
def memory_stats(s, d):
    return memories(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*B.ACTIVE)).alias("n_active"), F.count_distinct(F.concat_ws("/", "source", "conversation_id")).alias("n_conversations"), F.count_distinct("content_hash").alias("n_contents"), F.max("created_at").alias("last_at"))


_LOG = "log AS (SELECT event_id AS id, event_type AS stage, user_id % 40 AS target, epoch(ts) AS made_at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'kind' || (event_id % 3) END AS kind FROM events)"


def _log(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), (F.col("user_id") % 40).alias("target"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("kind"), F.col("event_id") % 3)).alias("kind"))


@query(f"WITH {_LOG} SELECT stage, target, kind FROM log QUALIFY row_number() OVER (PARTITION BY stage, target ORDER BY made_at DESC, id DESC) = 1 AND kind IS NOT NULL")
def open_failures(s, d):
    return B.failures(_log(s, d)).select("stage", "target", "kind")


@query(f"WITH {_LOG}, f AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY stage, target ORDER BY made_at DESC, id DESC) = 1 AND kind IS NOT NULL) SELECT kind, count(*) AS n FROM f GROUP BY kind ORDER BY n DESC, kind")
def failure_summary(s, d):
    return B.failures(_log(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


@query("""WITH u AS (SELECT l_returnflag AS model, CAST(l_quantity AS BIGINT) AS i, l_linenumber AS o FROM lineitem), p(model, a, b) AS (VALUES ('A', 3.0, 15.0), ('R', 1.0, 5.0))
SELECT u.model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round(coalesce(sum(i) * max(a) / 1e6 + sum(o) * max(b) / 1e6, 0.0), 9) AS cost FROM u LEFT JOIN p ON p.model = u.model GROUP BY u.model""")
def token_cost(s, d):
    u = table(s, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("bigint").alias("tokens_in"), F.col("l_linenumber").cast("bigint").alias("tokens_out"))
    p = s.createDataFrame([("A", 3.0, 15.0), ("R", 1.0, 5.0)], "model string, price_in double, price_out double")
    return B.usage_cost(u, p).withColumn("cost", F.round("cost", 9))


_NOTE = "note AS (SELECT event_id AS id, event_type AS category, (['info','warn','error'])[event_id % 3 + 1] AS level, ts AS made_at, event_id % 5 < 2 OR user_id = 7 AS read FROM events)"


def _notices(s, d):
    e, k = table(s, d, "events"), F.col("event_id")
    read = (k % 5 < 2) | (F.col("user_id") == 7)  # user 7 has marked all as read
    return e.select(k.alias("id"), F.col("event_type").alias("category"), F.get(F.array(F.lit("info"), F.lit("warn"), F.lit("error")), (k % 3).cast("int")).alias("level"), F.col("ts").alias("at"), read.alias("read"))


@query(f"WITH {_NOTE} SELECT id, category, level FROM note WHERE level IN ('warn', 'error') AND category IN ('click', 'error', 'purchase') AND NOT read ORDER BY made_at DESC, id DESC LIMIT 25")
def notice_page(s, d):
    some = _notices(s, d).where(B.among("level", ["warn", "error"]) & B.among("category", ["click", "error", "purchase"]) & ~F.col("read"))
    return B.page_of(some, [F.desc("at"), F.desc("id")], 1, 25).select("id", "category", "level")


@query(f"WITH {_NOTE} SELECT count(*) FILTER (NOT read) AS n_unread, count(*) FILTER (NOT read AND (category IN ('purchase') OR level IN ('error'))) AS n_pushed FROM note")
def unread_count(s, d):
    push = B.should_push(F.col("category"), F.col("level"), {"purchase": True, "click": False}, {"error": True, "warn": False})
    return _notices(s, d).agg(F.count_if(~F.col("read")).alias("n_unread"), F.count_if(~F.col("read") & push).alias("n_pushed"))


_PAGE = "pg AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS domain, CASE WHEN page_id % 3 = 0 THEN 'external' ELSE 'native' END AS origin, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"


def _pages(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("domain"), F.when(F.col("page_id") % 3 == 0, "external").otherwise("native").alias("origin"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(f"WITH {_PAGE} SELECT page_id, domain, title FROM pg WHERE origin = 'external' AND contains(lower(title), 'th')")
def page_list(s, d):
    return _pages(s, d).where(B.among("origin", ["external"]) & T.contains_folded(F.col("title"), "th")).select("page_id", "domain", "title")


@query(f"WITH {_PAGE} SELECT domain, origin, count(*) AS n FROM pg GROUP BY ALL")
def page_counts(s, d):
    return _pages(s, d).groupBy("domain", "origin").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVS}, {EXC}, x AS (SELECT e.*, EXISTS (SELECT 1 FROM exc WHERE exc.source = e.source AND exc.conversation_id = e.conversation_id AND exc.turn_key IN ('', coalesce(e.turn_key, ''))) AS out FROM evs e) SELECT source, conversation_id, count(*) AS n, count(*) FILTER (out) AS n_excluded FROM x GROUP BY ALL")
def index_counts(s, d):
    e, x = events(s, d), exclusions(s, d)
    n = F.count(F.lit(1))
    left = E.without_excluded(e, x).groupBy("source", "conversation_id").agg(n.alias("m"))
    return e.groupBy("source", "conversation_id").agg(n.alias("n")).join(left, ["source", "conversation_id"], "left").select("source", "conversation_id", "n", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n_excluded"))


_NEEDLE = "nd AS (SELECT DISTINCT split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS needle FROM benchmark)"


@query(f"WITH {_NEEDLE} SELECT needle, count(d.doc_id) AS n FROM nd LEFT JOIN documents d ON contains(lower(d.text), lower(needle)) GROUP BY needle")
def grounding_counts(s, d):
    """How many documents ground the first two words of each benchmark item."""
    nd = table(s, d, "benchmark").select(F.substring_index("text", " ", 2).alias("needle"))
    return B.needle_counts(table(s, d, "documents"), nd)


@query("WITH k(case_id, word) AS (VALUES (1, 'the thing'), (1, 'und die'), (2, 'de la')) SELECT DISTINCT case_id, source AS conversation_id FROM documents JOIN k ON contains(lower(text), word)")
def gold_conversations(s, d):
    """Conversations in which a keyword of a case occurs."""
    cases = {1: ("the thing", "und die"), 2: ("de la",)}
    low = F.lower("text")
    hit = F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in (*ws, ws[0])]), k) for k, ws in cases.items()]))
    return table(s, d, "documents").select(F.explode(hit).alias("case_id"), F.col("source").alias("conversation_id")).distinct()


@query(f"WITH {EVS}, {SES} SELECT e.source, e.conversation_id, e.seq, s.title FROM evs e JOIN ses s ON s.source = e.source AND s.id = e.conversation_id WHERE (contains(lower(content), 'de la') OR contains(lower(coalesce(shell_cmd, '')), '$ ls the')) AND role = 'assistant'")
def keyword_events(s, d):
    """Keyword search over an event's fields, with the metadata of its session."""
    e, c = events(s, d), sessions(s, d)
    both = B.search_events(e, c, "de la", ("content",), role="assistant").unionByName(B.search_events(e, c, "$ ls the", ("shell_cmd",), role="assistant"))
    return both.select("source", "conversation_id", "seq", "title").distinct()


@query(f"WITH {UNI} SELECT id, time FROM uni ORDER BY time DESC, id DESC LIMIT 30")
def recent_units(s, d):
    return B.page_of(units(s, d), [F.desc("time"), F.desc("id")], 1, 30).select("id", "time")


@query(f"WITH {UNI} SELECT id, time FROM uni WHERE id NOT IN (SELECT doc_id FROM labels) ORDER BY time DESC, id DESC LIMIT 30")
def newest_unscored(s, d):
    traces = units(s, d).select(F.col("id").alias("trace_id"), F.col("time").alias("at"))
    return B.unscored(traces, table(s, d, "labels").select(F.col("doc_id").alias("trace_id")), 30).select(F.col("trace_id").alias("id"), F.col("at").alias("time"))


@query(f"WITH {EVS} SELECT source, conversation_id, seq FROM evs WHERE (source, conversation_id, seq) > ('s2', '150', 2) ORDER BY source, conversation_id, seq LIMIT 100")
def keyset_batch(s, d):
    keys = ("source", "conversation_id", "seq")
    return B.page_of(B.after(events(s, d), keys, ("s2", "150", 2)), [F.col(k) for k in keys], 1, 100).select(*keys)


@query(f"WITH {EVS} SELECT seq, role, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '…' ELSE content END AS content FROM evs WHERE conversation_id = '8' ORDER BY seq LIMIT 3 OFFSET 1")
def event_page(s, d):
    own = events(s, d).where("conversation_id = '8'")
    return own.orderBy("seq").offset(1).limit(3).select("seq", "role", T.clip(F.col("content"), 200).alias("content"))


@query(f"WITH {EVS}, a AS (SELECT source, conversation_id, turn_key FROM evs WHERE seq = 3 AND turn_key IS NOT NULL) SELECT e.source, e.conversation_id, e.seq FROM evs e SEMI JOIN a USING (source, conversation_id, turn_key)")
def whole_turns(s, d):
    e = events(s, d)
    return B.whole_turns(e, e.where("seq = 3")).select("source", "conversation_id", "seq")


@query("WITH f AS (SELECT user_id AS key, min(event_id) AS position FROM events GROUP BY 1) SELECT key, position FROM f ORDER BY position DESC, key DESC LIMIT 50")
def score_queue(s, d):
    """A queue of ids, each once, that holds the last 50."""
    e = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("position"))
    return B.keep_last(e, "key", "position", 50)


@query(f"WITH {SES}, {UNI} SELECT (SELECT max(id) FROM uni) AS top_unit, (SELECT max(x) FROM (SELECT max(session_uid) AS x FROM ses UNION ALL SELECT 100000 + max(conv_id) FROM conversations WHERE conv_id % 9 = 0)) AS top_uid")
def top_numbers(s, d):
    live = sessions(s, d).agg(F.max("session_uid").alias("x"))
    gone = table(s, d, "conversations").where("conv_id % 9 = 0").agg((F.max("conv_id") + 100000).alias("x"))
    return units(s, d).agg(F.max("id").alias("top_unit")).join(F.broadcast(live.unionByName(gone).agg(F.max("x").alias("top_uid"))))


@query(f"WITH {UNI} SELECT unit_id, kind, origin, text FROM (SELECT id AS unit_id, CASE WHEN starts_with(src_id, 'wiki_') THEN 'wiki' WHEN starts_with(src_id, 'dst_') OR starts_with(src_id, 'mcp_') THEN 'memory' ELSE 'message' END AS kind, CASE WHEN source = 'feed' THEN 'external' ELSE 'native' END AS origin, CASE WHEN starts_with(src_id, 'wiki_') AND length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END AS text FROM uni WHERE id % 50 = 0 OR id % 50 = 3)")
def hit_view(s, d):
    """Hits as a reader gets them: kind, origin, capped text."""
    u = units(s, d).withColumnRenamed("id", "unit_id")
    hits = u.where("unit_id % 50 IN (0, 3)").select(F.lit(0).cast("bigint").alias("query_id"), "unit_id", F.col("unit_id").alias("rank"))
    return B.hit_view(hits, u).select("unit_id", "kind", "origin", "text")


@query(f"WITH {UNI}, h AS (SELECT id % 20 AS query_id, text, row_number() OVER (PARTITION BY id % 20 ORDER BY id) AS rank FROM uni) SELECT query_id, string_agg('- ' || CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '…' ELSE text END, chr(10) ORDER BY rank) AS context FROM h WHERE rank <= 3 GROUP BY query_id")
def injected_context(s, d):
    from pyspark.sql import Window

    u = units(s, d).select((F.col("id") % 20).alias("query_id"), "text", F.row_number().over(Window.partitionBy(F.col("id") % 20).orderBy("id")).alias("rank"))
    return B.injected_context(u)


@query(f"""WITH {UNI}, f AS (SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN 'mcp_t' || doc_id WHEN 1 THEN 'msg' || doc_id WHEN 2 THEN 'unit:' || (doc_id * 2) WHEN 3 THEN CAST(doc_id AS VARCHAR) ELSE 'unit:x' END AS ref FROM documents)
SELECT ref, coalesce((SELECT min(id) FROM uni WHERE legacy_id = ref), (SELECT min(id) FROM uni WHERE src_id = ref), (SELECT id FROM uni WHERE id = TRY_CAST(coalesce(nullif(regexp_extract(ref, '^unit:(\\d+)$', 1), ''), nullif(regexp_extract(ref, '^(\\d+)$', 1), '')) AS BIGINT))) AS unit_id FROM f""")
def ref_resolution(s, d):
    k = F.col("doc_id")
    ref = F.when(k % 5 == 0, F.concat(F.lit("mcp_t"), k)).when(k % 5 == 1, F.concat(F.lit("msg"), k)).when(k % 5 == 2, F.concat(F.lit("unit:"), k * 2)).when(k % 5 == 3, k.cast("string")).otherwise("unit:x")
    return B.resolve_refs(table(s, d, "documents").select(ref.alias("ref")).distinct(), units(s, d))


@query(f"WITH {EVS}, {MMS}, t AS (SELECT source, conversation_id, turn_key, min(time) AS first FROM evs WHERE turn_key IS NOT NULL GROUP BY ALL) SELECT id, coalesce(first, created_at) AS at FROM mms LEFT JOIN t USING (source, conversation_id, turn_key)")
def origin_time(s, d):
    return B.origin_time(memories(s, d), events(s, d))


@query(f"WITH {UNI} SELECT id, source FROM uni WHERE CASE WHEN source = 'feed' THEN 'external' ELSE 'native' END = 'external'")
def external_units(s, d):
    return units(s, d).where(T.origin_of(F.col("source")) == "external").select("id", "source")


QUERIES, ORACLE = query.queries, query.oracle
