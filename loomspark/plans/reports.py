"""Overviews, facets, windows and joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import events as E
from ..operators import reports as R
from .base import EV, MEM, Registry, docs_as_memories, table, turns_as_events

query = Registry()


@query(f"""WITH {EV}, p AS (SELECT source, conversation_id, count(*) AS n, min(time) AS lo, max(time) AS hi FROM ev GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_conversations, count(DISTINCT source) AS n_sources, min(lo) AS first_time, max(hi) AS last_time, round(avg(n), 1) AS avg_events, max(n) AS max_events FROM p""")
def meta_overview(s: SparkSession, d: str) -> DataFrame:
    return R.overview(turns_as_events(s, d))


@query(f"WITH {EV} SELECT role, count(*) AS n FROM ev GROUP BY role")
def role_counts(s, d):
    return R.counts(turns_as_events(s, d), F.col("role"), "role")


@query("SELECT source, count(*) AS n FROM documents WHERE trim(source) <> '' GROUP BY source ORDER BY n DESC, source LIMIT 20")
def source_top(s, d):
    return R.counts(table(s, d, "documents"), F.col("source"), "source", 20)


@query("SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def daily_active(s, d):
    return R.daily_distinct(table(s, d, "events"), F.to_date("ts"), ["user_id"])


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def source_role_pivot(s, d):
    return R.crosstab(table(s, d, "documents"), "source", "lang", ["en", "de", "fr", "es"])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def conv_mode(s, d):
    return R.mode_first_seen(table(s, d, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT lang, source, count(*) AS n, CAST(grouping(lang, source) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (lang, source)")
def folder_rollup(s, d):
    return R.rollup_counts(table(s, d, "documents"), "lang", "source")


@query(f"""WITH {MEM} SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(status) = 0 THEN 'status' ELSE 'source' END AS facet,
coalesce(CASE WHEN grouping(type) = 0 THEN type END, CASE WHEN grouping(status) = 0 THEN status END, CASE WHEN grouping(source) = 0 THEN source END) AS value, count(*) AS n
FROM mem GROUP BY GROUPING SETS ((type), (status), (source))""")
def facets_grouping_sets(s, d):
    return R.facets(docs_as_memories(s, d), ["type", "status", "source"])


@query(f"WITH {EV} SELECT source, count(*) AS n, count(DISTINCT conversation_id) AS n_conversations FROM ev WHERE is_system GROUP BY source")
def system_event_counts(s, d):
    return turns_as_events(s, d).where("is_system").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conversation_id").alias("n_conversations"))


@query(f"""WITH {EV} SELECT source, conversation_id, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) AS n FROM ev
WHERE role IN ('user', 'assistant') AND trim(content) <> '' AND NOT is_system GROUP BY ALL ORDER BY chars DESC, conversation_id LIMIT 50""")
def distillable_conversations(s, d):
    e = E.eligible(turns_as_events(s, d))
    return e.groupBy("source", "conversation_id").agg(F.sum(F.length("content")).alias("chars"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("chars"), "conversation_id").limit(50)


@query(f"WITH {MEM} SELECT source, conversation_id, count(*) AS n FROM mem WHERE status IN ('new', 'similar') GROUP BY ALL HAVING count(*) >= 3")
def sessions_having(s, d):
    return R.having(docs_as_memories(s, d).where(F.col("status").isin("new", "similar")), ["source", "conversation_id"], 3)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, max(CASE WHEN r = floor(c * 0.5) + 1 THEN value END) AS p50, max(CASE WHEN r = floor(c * 0.95) + 1 THEN value END) AS p95, max(value) AS max, count(*) AS n FROM r GROUP BY event_type""")
def latency_percentile(s, d):
    return R.percentile_by_index(table(s, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_feedback(s, d):
    return R.latest_by(table(s, d, "events"), ["user_id"], "event_id", ["event_type", "value"])


_ANCHOR = f"""{EV}, an AS (SELECT *, last_value(CASE WHEN role = 'user' AND NOT is_system THEN src_id END IGNORE NULLS) OVER (PARTITION BY source, conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_key FROM ev)"""


@query(f"WITH {_ANCHOR} SELECT source, conversation_id, seq, turn_key FROM an")
def turn_anchor(s, d):
    return E.turn_anchor(turns_as_events(s, d)).select("source", "conversation_id", "seq", "turn_key")


@query(f"""WITH {_ANCHOR} SELECT source, conversation_id, coalesce(turn_key, 'seq:' || seq) AS turn_key, min(seq) AS first_seq, count(*) AS n_events,
coalesce(string_agg(CASE WHEN role = 'user' THEN content END, chr(10) ORDER BY seq), '') AS user_text, coalesce(string_agg(CASE WHEN role <> 'user' THEN content END, chr(10) ORDER BY seq), '') AS agent_text FROM an GROUP BY ALL""")
def turn_view(s, d):
    return E.turn_view(E.turn_anchor(turns_as_events(s, d)))


_PHRASE = "the"


@query(f"""WITH {_ANCHOR}, t AS (SELECT conversation_id, coalesce(turn_key, 'seq:' || seq) AS turn_key, min(seq) AS first_seq, lower(string_agg(content, ' ' ORDER BY seq)) AS x FROM an WHERE NOT is_system GROUP BY ALL)
SELECT conversation_id, turn_key, first_seq, CAST((length(x) - length(replace(x, '{_PHRASE}', ''))) / {len(_PHRASE)} AS BIGINT) AS hits FROM t WHERE contains(x, '{_PHRASE}') ORDER BY hits DESC, conversation_id, first_seq LIMIT 50""")
def turn_search(s, d):
    """Turns that mention a phrase, most mentions first."""
    e = E.turn_anchor(E.eligible(turns_as_events(s, d)))
    key = F.coalesce("turn_key", F.concat(F.lit("seq:"), F.col("seq")))
    n = F.sum((F.length("content") - F.length(F.replace(F.lower("content"), F.lit(_PHRASE), F.lit("")))) / len(_PHRASE)).cast("bigint")
    return e.groupBy("conversation_id", key.alias("turn_key")).agg(F.min("seq").alias("first_seq"), n.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "conversation_id", "first_seq").limit(50)


@query(f"WITH {EV} SELECT source, conversation_id, seq, row_number() OVER (PARTITION BY source, conversation_id ORDER BY CASE WHEN seq % 3 = 0 THEN NULL ELSE time END NULLS LAST, seq) AS new_seq FROM ev")
def seq_renumber(s, d):
    e = turns_as_events(s, d).withColumn("t", F.when(F.col("seq") % 3 != 0, F.col("time")))
    return E.renumber(e, time="t").select("source", "conversation_id", "seq", F.col("new_seq").cast("bigint").alias("new_seq"))


_EXCLUDED = """ex AS (SELECT 'conv' AS source, CAST(conv_id AS VARCHAR) AS conversation_id, '' AS turn_key FROM conversations WHERE conv_id % 10 = 3 AND turn = 0
  UNION ALL SELECT 'conv', CAST(conv_id AS VARCHAR), 'c' || conv_id || '-' || turn FROM conversations WHERE conv_id % 10 = 4 AND role = 'user' AND turn = 0)"""


@query(f"WITH {_ANCHOR}, {_EXCLUDED} SELECT an.source, an.conversation_id, an.seq FROM an WHERE NOT EXISTS (SELECT 1 FROM ex x WHERE x.source = an.source AND x.conversation_id = an.conversation_id AND (x.turn_key = '' OR x.turn_key = coalesce(an.turn_key, '')))")
def exclusion_anti(s, d):
    e = E.turn_anchor(turns_as_events(s, d))
    no = F.col("conversation_id").cast("bigint") % 10
    whole = e.where((no == 3) & (F.col("seq") == 0)).select("source", "conversation_id", F.lit("").alias("turn_key"))
    turn = e.where((no == 4) & (F.col("role") == "user") & (F.col("seq") == 0)).select("source", "conversation_id", F.col("src_id").alias("turn_key"))
    return E.without_excluded(e, whole.unionByName(turn)).select("source", "conversation_id", "seq")


@query(f"WITH {EV} SELECT source, conversation_id, seq FROM ev WHERE CAST(conversation_id AS BIGINT) % 7 <> 0")
def tombstone_anti(s, d):
    e = turns_as_events(s, d)
    gone = e.where(F.col("conversation_id").cast("bigint") % 7 == 0).select("source", "conversation_id").distinct()
    return E.without_tombstones(e, gone).select("source", "conversation_id", "seq")


@query("SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL")
def missing_vectors(s, d):
    have = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(s, d, "documents").select("doc_id").join(have, "doc_id", "left_anti")


@query("SELECT count(*) AS n_units, count(e.vec_id) AS n_vectors, round(count(e.vec_id) / count(*), 4) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON d.doc_id = e.vec_id")
def coverage(s, d):
    have = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v")).distinct()
    j = table(s, d, "documents").select("doc_id").join(have, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_units"), F.count("v").alias("n_vectors"), F.round(F.count("v") / F.count(F.lit(1)), 4).alias("coverage"))


@query(f"""WITH {MEM}, u AS (SELECT DISTINCT fingerprint FROM mem WHERE status = 'new'), j AS (SELECT m.id, m.fingerprint, u.fingerprint AS hit, l.quality FROM mem m LEFT JOIN u ON u.fingerprint = m.fingerprint LEFT JOIN labels l ON l.doc_id = m.id)
SELECT id, hit IS NOT NULL AS projected, quality FROM j""")
def report_join(s, d):
    m = docs_as_memories(s, d)
    u = m.where("status = 'new'").select("fingerprint", F.lit(True).alias("hit")).distinct()
    labels = table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return m.select("id", "fingerprint").join(u, "fingerprint", "left").join(labels, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("projected"), "quality")


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n0, sum(o_totalprice) AS u0 FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, count(*) AS n1, sum(o_totalprice) AS u1 FROM orders WHERE o_custkey % 11 <> 0 GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'kept' WHEN abs(u1 - u0) >= 1e-6 OR n0 <> n1 THEN 'updated' ELSE 'unchanged' END AS status FROM o FULL JOIN n ON o.k = n.k""")
def upsert_status(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_totalprice")
    agg = lambda x: x.groupBy("k").agg(F.count(F.lit(1)).alias("event_count"), F.sum("o_totalprice").alias("updated_at"))
    return E.upsert_status(agg(o.where("o_orderdate < '1997-01-01'")), agg(o.where("k % 11 <> 0")), ("k",))


@query("""WITH n AS (SELECT user_id, 'updated' AS status FROM events GROUP BY user_id HAVING user_id % 3 = 0), o AS (SELECT user_id, 'added' AS status FROM events GROUP BY user_id HAVING user_id % 2 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)""")
def delta_merge(s, d):
    u = table(s, d, "events").select("user_id").distinct()
    new = u.where("user_id % 3 = 0").withColumn("status", F.lit("updated"))
    old = u.where("user_id % 2 = 0").withColumn("status", F.lit("added"))
    return E.delta_merge(new, old, ("user_id",))


@query("""WITH c AS (SELECT event_id // 2 AS call_id, ts FROM events WHERE event_id % 2 = 0), r AS (SELECT event_id // 2 AS call_id, min(ts) AS done_at FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' GROUP BY 1)
SELECT c.call_id, c.ts AS called_at, r.done_at, r.done_at IS NULL AS pending FROM c LEFT JOIN r ON r.call_id = c.call_id""")
def call_pairing(s, d):
    e = table(s, d, "events").select(F.expr("event_id div 2").alias("call_id"), "ts", F.when(F.col("event_id") % 2 == 0, "call").when(F.col("event_type") != "error", "result").alias("phase"))
    return E.pair_calls(e)


@query("""WITH p AS (SELECT DISTINCT l_partkey AS turn_key, CAST(l_suppkey AS VARCHAR) AS conversation_id FROM lineitem), n AS (SELECT turn_key, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT p.turn_key, 'li' AS source, p.conversation_id, n.n - 1 AS n_others FROM p JOIN n ON n.turn_key = p.turn_key""")
def shared_turns(s, d):
    e = table(s, d, "lineitem").select(F.col("l_partkey").alias("turn_key"), F.lit("li").alias("source"), F.col("l_suppkey").cast("string").alias("conversation_id"))
    return E.shared_turns(e)


_NOW = 1706745600.0


@query(f"""WITH v AS (SELECT event_id, CASE WHEN event_type = 'error' THEN -0.5 ELSE least(value / 100.0, 1.0) END AS value, {_NOW} - epoch(ts) AS age, event_type = 'purchase' AS locked FROM events)
SELECT event_id, round(0.5 + least(0.3 * CASE WHEN locked THEN value ELSE value * pow(0.5, age / 86400.0 / 30.0) END, 0.3), 6) AS rel FROM v WHERE value > 0""")
def value_decay(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", -0.5).otherwise(F.least(F.col("value") / 100.0, F.lit(1.0))).alias("value"), (F.lit(_NOW) - F.col("ts").cast("timestamp").cast("double")).alias("age"), (F.col("event_type") == "purchase").alias("locked"))
    return e.select("event_id", F.round(V.boost(F.lit(0.5), F.col("value"), F.col("age"), F.col("locked")), 6).alias("rel")).where("rel IS NOT NULL")


@query(f"""WITH {MEM}, n AS (SELECT id, md5(content) AS h1 FROM mem WHERE id % 7 <> 0), o AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'x' ELSE md5(content) END AS h0 FROM mem WHERE id % 3 <> 0)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN h0 <> h1 THEN 'changed' ELSE 'same' END AS change FROM n FULL JOIN o ON n.id = o.id""")
def manifest_diff(s, d):
    from ..operators import pages as P

    m = docs_as_memories(s, d)
    now = m.where("id % 7 <> 0").select("id", F.col("fingerprint").alias("md5"))
    old = m.where("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("fingerprint")).alias("md5"))
    return P.diff(old, now)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q1_pricing(s, d):
    li = table(s, d, "lineitem").where("l_shipdate <= '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""")
def q5_region_revenue(s, d):
    t = lambda n: table(s, d, n)
    o = t("orders").where("o_orderdate >= '1995-01-01' AND o_orderdate < '1997-01-01'").select("o_orderkey", "o_custkey")
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name")
    j = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_totalprice, rn AS rank FROM r WHERE rn <= 3""")
def keep_newest(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 3")


QUERIES, ORACLE = query.queries, query.oracle
