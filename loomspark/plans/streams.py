"""Event-time windows and stateful suppression over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import notices as N
from ..streaming import windows as W
from .base import Registry, table

query = Registry()


def _events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_tumbling(s, d):
    return _plain(W.tumbling(_events(s, d), "1 hour", ["event_type"])).withColumn("total", F.round("total", 4))


@query("""WITH o AS (SELECT unnest([0, 1]) AS k) SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM events, o GROUP BY ALL""")
def event_sliding(s, d):
    return _plain(W.sliding(_events(s, d), "1 hour", "30 minutes", ["event_type"]))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_session(s, d):
    return _plain(W.session(_events(s, d), "6 hours", ["user_id"]))


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, event_type AS category, CAST(user_id AS VARCHAR) AS title, epoch(ts) AS ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT id, category, title, ts, r, ts AS last, true AS ok FROM e WHERE r = 1 UNION ALL SELECT e.id, e.category, e.title, e.ts, e.r, CASE WHEN e.ts - w.last >= 86400 THEN e.ts ELSE w.last END, e.ts - w.last >= 86400 FROM w JOIN e ON e.category = w.category AND e.title = w.title AND e.r = w.r + 1)
SELECT category, title, id FROM w WHERE ok""")
def notice_dedup(s, d):
    e = _events(s, d).select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("title"), F.col("ts").cast("double").alias("ts"), F.col("event_id").alias("id"))
    return N.dedup_batch(e, 86400.0).select("category", "title", "id")


QUERIES, ORACLE = query.queries, query.oracle
