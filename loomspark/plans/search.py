"""Retrieval, text, page and memory queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import events as E
from ..operators import memory as M
from ..operators import pages as P
from ..operators import reports as R
from ..operators import search as S
from .base import EV, MEM, Registry, docs_as_memories, table, turns_as_events

query = Registry()
#: The stated queries: every vector whose id is divisible by 50 is asked with one of these texts.
EVERY = 50
TEXTS = ("the thing", "de la", "und die", "and of the")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding")


def _query_vectors(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).where(F.col("unit_id") % EVERY == 0).withColumnRenamed("unit_id", "query_id")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return _query_vectors(s, d).select("query_id", F.get(F.array(*[F.lit(t) for t in TEXTS]), (F.col("query_id") / EVERY % len(TEXTS)).cast("int")).alias("text"))


_Q = f"q AS (SELECT vec_id AS query_id, (['" + "', '".join(TEXTS) + f"'])[vec_id // {EVERY} % {len(TEXTS)} + 1] AS text, embedding FROM embeddings WHERE vec_id % {EVERY} = 0)"
_COS = "greatest(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 0.0)"


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS unit_id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM p) SELECT query_id, unit_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""")
def knn_topk(s, d):
    return S.knn(_vectors(s, d), _query_vectors(s, d), 10).select("query_id", "unit_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS unit_id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0 AND e.label <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM p) SELECT query_id, unit_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5""")
def knn_excluding(s, d):
    gone = table(s, d, "embeddings").where("label = 0").select(F.col("vec_id").alias("unit_id"))
    return S.knn(_vectors(s, d), _query_vectors(s, d), 5, gone).select("query_id", "unit_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT q.vec_id AS a, e.vec_id AS b, round({_COS}, 5) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id < e.vec_id WHERE {_COS} >= 0.4")
def neardup_pairs(s, d):
    return M.near_pairs(_vectors(s, d), 0.4).select("a", "b", F.round("sim", 5).alias("sim"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"


@query(f"""WITH {EV}, n AS (SELECT conversation_id, seq, CASE WHEN length(content) >= 3 THEN {_GRAMS.format('content')} ELSE [] END AS g FROM ev WHERE role = 'user'),
l AS (SELECT conversation_id, seq, g, lag(g) OVER (PARTITION BY conversation_id ORDER BY seq) AS p FROM n)
SELECT conversation_id, seq, round(CASE WHEN len(list_distinct(list_concat(g, p))) = 0 THEN 1.0 ELSE len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))) END, 6) AS jaccard FROM l WHERE p IS NOT NULL""")
def trigram_jaccard(s, d):
    """How much neighbouring user turns have in common."""
    from pyspark.sql import Window

    e = turns_as_events(s, d).where("role = 'user'").select("conversation_id", "seq", T.trigrams(F.col("content")).alias("g"))
    l = e.withColumn("p", F.lag("g").over(Window.partitionBy("conversation_id").orderBy("seq"))).where("p IS NOT NULL")  # noqa: E741
    return l.select("conversation_id", "seq", F.round(T.jaccard(F.col("g"), F.col("p")), 6).alias("jaccard"))


def _doc_units(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("unit_id"), "text", F.col("source").alias("conversation_id"), F.concat(F.lit("msg_"), F.col("doc_id")).alias("src_id"))


@query(f"""WITH {_Q}, f AS (SELECT q.query_id, d.doc_id AS unit_id, row_number() OVER (PARTITION BY q.query_id ORDER BY d.doc_id) AS rank FROM documents d, q WHERE contains(lower(d.text), lower(q.text)))
SELECT query_id, unit_id, 'phrase' AS channel, CAST(1.0 AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 20""")
def phrase_contains(s, d):
    return S.contains_search(_doc_units(s, d), _texts(s, d).withColumnRenamed("text", "needle"), 20, channel="phrase")


def _channels(s, d):
    vec = S.knn(_vectors(s, d), _query_vectors(s, d), 30).withColumn("rank", F.col("rank").cast("int"))
    return vec.unionByName(S.contains_search(_doc_units(s, d), _texts(s, d).withColumnRenamed("text", "needle"), 30, channel="phrase"))


_CH = f"""{_Q},
vr AS (SELECT q.query_id, e.vec_id AS unit_id, {_COS} AS score FROM q, embeddings e),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM vr),
f AS (SELECT q.query_id, d.doc_id AS unit_id, 1.0 AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY d.doc_id) AS rank FROM documents d, q WHERE contains(lower(d.text), lower(q.text))),
ch AS (SELECT query_id, unit_id, 'vec' AS channel, score, rank FROM v WHERE rank <= 30 UNION ALL SELECT query_id, unit_id, 'phrase', score, rank FROM f WHERE rank <= 30),
fu AS (SELECT query_id, unit_id, max(score) AS best, max(score) + 0.4 * sum(1.0 / (60 + rank)) AS rel, count(*) AS n_channels FROM ch GROUP BY ALL)"""


@query(f"WITH {_CH} SELECT query_id, unit_id, round(best, 5) AS best, round(rel, 5) AS rel, n_channels FROM fu")
def rrf_fusion(s, d):
    return S.fuse(_channels(s, d)).select("query_id", "unit_id", F.round("best", 5).alias("best"), F.round("rel", 5).alias("rel"), "n_channels")


@query(f"WITH {_CH}, t AS (SELECT *, max(rel) OVER (PARTITION BY query_id) AS top FROM fu) SELECT query_id, unit_id, round(rel, 5) AS rel, NOT rel >= 0.35 * top AS bypassed FROM t WHERE rel >= 0.35 * top OR (n_channels >= 2 AND best >= 0.35)")
def relative_threshold(s, d):
    return S.threshold(S.fuse(_channels(s, d)), 0.35).select("query_id", "unit_id", F.round("rel", 5).alias("rel"), "bypassed")


@query(f"""WITH {_CH}, g AS (SELECT fu.*, d.source AS conversation_id FROM fu JOIN documents d ON d.doc_id = fu.unit_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, conversation_id ORDER BY round(rel, 9) DESC, unit_id) AS seat FROM g) SELECT query_id, unit_id, conversation_id, seat FROM r WHERE seat <= 2""")
def seat_cap(s, d):
    j = S.fuse(_channels(s, d)).join(_doc_units(s, d).select("unit_id", "conversation_id"), "unit_id")
    return S.seat_cap(j).select("query_id", "unit_id", "conversation_id", F.col("seat").cast("bigint").alias("seat"))


@query()
def hybrid_search(s, d):
    """The flagship: vector, trigram, identifier and phrase channels, fused, valued, thresholded, diversified."""
    units = _doc_units(s, d).join(_vectors(s, d), "unit_id", "left")  # text channels see documents without a vector
    values = table(s, d, "labels").select(F.col("doc_id").alias("unit_id"), F.when(F.col("quality") == 1, 0.6).otherwise(0.2).alias("value"), F.lit(None).cast("double").alias("manual_value"), F.lit(1704067200.0).alias("time"), F.lit(False).alias("locked"))
    return S.hybrid(units, _texts(s, d), _query_vectors(s, d), values, 1706745600.0).select("query_id", "unit_id", F.round("rel", 5).alias("rel"), "position")


_NOISE = T.NOISE.replace("'", "''") if isinstance(T.NOISE, str) else ""


@query(f"""WITH {_Q}, asked AS (SELECT DISTINCT query_id, unnest(list_slice(list_filter({_GRAMS.format("lower(text)")}, lambda g: NOT regexp_full_match(g, '[{_NOISE}]{{3}}')), 1, 16)) AS gram FROM q),
dx AS (SELECT doc_id AS unit_id, lower(text) AS x, greatest(length(lower(text)) - 2, 0) AS len FROM documents), st AS (SELECT count(*) AS n, greatest(avg(greatest(length(text) - 2, 0)), 1.0) AS avg_len FROM documents),
g AS (SELECT unit_id, len, unnest(list_transform(range(1, len + 1), lambda i: substr(x, i, 3))) AS gram FROM dx), hit AS (SELECT unit_id, gram, len, count(*) AS tf FROM g WHERE gram IN (SELECT gram FROM asked) GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM hit GROUP BY 1),
sc AS (SELECT query_id, unit_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))) AS bm FROM hit JOIN df USING (gram) JOIN asked USING (gram), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 9) DESC, unit_id) AS rank FROM sc) SELECT query_id, unit_id, round(1.0 / rank, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def gram_bm25(s, d):
    return S.gram_search(_doc_units(s, d), _texts(s, d), 20).select("query_id", "unit_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def fingerprint_dups(s, d):
    return table(s, d, "documents").groupBy(F.md5("text").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
_PASSWORD = r"(?i)(?:password|passwd|pwd|secret|api[_-]?key)\s*[:=]\s*[''\"]?[^\s''\"]{8,}"


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}')) AS n_email, len(regexp_extract_all(text, '{_PASSWORD}')) AS n_password, len(regexp_extract_all(text, '\bAKIA[0-9A-Z]{{16}}\b')) AS n_aws FROM documents WHERE regexp_matches(text, '{_EMAIL}') OR regexp_matches(text, '{_PASSWORD}') OR regexp_matches(text, '\bAKIA[0-9A-Z]{{16}}\b')")
def redact_counts(s, d):
    rules = ("email", "password_assign", "aws_key")
    found = table(s, d, "documents").select("doc_id", F.explode(T.scan_findings(F.col("text"), only=rules)).alias("f"))
    n = lambda rule: F.count_if(F.col("f.rule") == rule)
    return found.groupBy("doc_id").agg(n("email").alias("n_email"), n("password_assign").alias("n_password"), n("aws_key").alias("n_aws"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[\s\pP\pS\pZ]+', '', 'g')) >= 40 AS ok FROM documents")
def has_substance(s, d):
    return table(s, d, "documents").select("doc_id", T.has_substance(F.regexp_replace("text", "_", "‿"), 40).alias("ok"))


@query(r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS visible FROM pages")
def visible_text_len(s, d):
    return table(s, d, "pages").select("page_id", T.visible_length(F.col("html")).cast("bigint").alias("visible"))


@query("SELECT doc_id, CASE WHEN length(text) > 320 THEN substr(text, 1, 320) || '…' ELSE text END AS clipped FROM documents")
def event_short(s, d):
    return table(s, d, "documents").select("doc_id", T.clip(F.col("text"), 320).alias("clipped"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]*\\.example\\.(com|net|org)([/?#]|$)') THEN false ELSE true END AS private FROM pages")
def private_hosts(s, d):
    return table(s, d, "pages").select("page_id", T.private_host(F.col("url")).alias("private"))


@query(f"WITH {MEM} SELECT id, 'dst_' || substr(sha256(content), 1, 16) AS src_id FROM mem WHERE status IN ('new', 'similar')")
def projected_ids(s, d):
    m = docs_as_memories(s, d).where(F.col("status").isin("new", "similar"))
    return m.select("id", F.concat(F.lit("dst_"), F.substring(F.sha2("content", 256), 1, 16)).alias("src_id"))


@query("""WITH f AS (SELECT user_id AS unit_id, CASE event_type WHEN 'error' THEN -1.0 WHEN 'purchase' THEN 1.0 ELSE 0.0 END AS sign, greatest(least(value / 100.0, 1.0), 0.0) AS mag FROM events)
SELECT unit_id, round(greatest(least(coalesce(sum(sign * mag) / nullif(sum(mag), 0.0), 0.0), 1.0), -1.0), 6) AS value, count(*) AS n FROM f GROUP BY unit_id""")
def feedback_mean(s, d):
    f = table(s, d, "events").select(F.col("user_id").alias("unit_id"), F.when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "purchase", "positive").otherwise("neutral").alias("polarity"), (F.col("value") / 100.0).alias("magnitude"))
    return M.feedback_mean(f).select("unit_id", F.round("value", 6).alias("value"), "n")


@query("""WITH l AS (SELECT user_id AS unit_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL), f AS (SELECT unit_id, CASE event_type WHEN 'error' THEN -1.0 WHEN 'purchase' THEN 1.0 ELSE 0.0 END AS sign, greatest(least(v / 100.0, 1.0), 0.0) AS mag FROM l WHERE event_type <> 'signup')
SELECT unit_id, round(greatest(least(coalesce(sum(sign * mag) / nullif(sum(mag), 0.0), 0.0), 1.0), -1.0), 6) AS value FROM f GROUP BY unit_id""")
def feedback_state(s, d):
    e = table(s, d, "events")
    f = e.select(F.col("user_id").alias("unit_id"), F.col("event_id").alias("id"), F.col("event_type").alias("channel"), F.when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "signup", "revoke").otherwise("neutral").alias("polarity"), (F.col("value") / 100.0).alias("magnitude"))
    units = e.select(F.col("user_id").alias("unit_id")).distinct().withColumn("role", F.lit("distilled"))
    return M.feedback_state(f, units).select("unit_id", F.round("value", 6).alias("value"))


@query()
def conversation_slices(s, d):
    e = E.turn_anchor(E.eligible(turns_as_events(s, d)))
    return M.slices(e, 2_000, 4).select("source", "conversation_id", "slice_key", "n_turns", "n_chars", "content_hash")


@query()
def memory_triage(s, d):
    v = _vectors(s, d)
    reps, copies = M.equal_vectors(v)
    return M.triage(v.select(F.col("unit_id").alias("id")), M.block_pairs(reps, 0.35), 0.45, 0.35, copies)


@query("WITH k AS (SELECT p_partkey AS page, p_brand || '-' || (p_partkey % 400) AS key FROM part UNION ALL SELECT p_partkey, p_type || '-' || (p_partkey % 40) FROM part) SELECT key, min(page) AS page FROM k GROUP BY key HAVING count(DISTINCT page) = 1")
def link_unique(s, d):
    """Names that stand for one page only, of brands and types with a number."""
    k = F.col("p_partkey")
    keys = F.array(F.concat("p_brand", F.lit("-"), k % 400), F.concat("p_type", F.lit("-"), k % 40))
    return P.link_index(table(s, d, "part").select(k.alias("page"), F.explode(keys).alias("key")))


_SENTENCE = "'see [m' || (doc_id % 50) || '] and [m' || (doc_id * 7 % 90) || '] and [m' || (doc_id % 50) || ']'"


@query(f"WITH t AS (SELECT doc_id AS page, {_SENTENCE} AS x FROM documents) SELECT DISTINCT page, CAST(unnest(regexp_extract_all(x, '\\[m(\\d+)\\]', 1)) AS BIGINT) AS id FROM t")
def ref_explode(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("page"), F.expr(_SENTENCE).alias("text"))
    return P.cited(t)


@query(f"""WITH t AS (SELECT {_SENTENCE} AS x FROM documents), c AS (SELECT DISTINCT CAST(unnest(regexp_extract_all(x, '\\[m(\\d+)\\]', 1)) AS BIGINT) AS id FROM t), i AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0)
SELECT (SELECT count(*) FROM c) AS n_cited, (SELECT count(*) FROM c WHERE id NOT IN (SELECT id FROM i)) AS n_invalid, (SELECT count(*) FROM c WHERE id NOT IN (SELECT doc_id FROM documents)) AS n_absent, (SELECT count(*) FROM i) AS n_inputs,
(SELECT count(*) FROM i WHERE id NOT IN (SELECT id FROM c)) AS n_uncovered, round((SELECT count(*) FROM i WHERE id IN (SELECT id FROM c)) / (SELECT count(*) FROM i), 4) AS coverage""")
def align_coverage(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"))
    return P.align(ref_explode(s, d), docs.where("id % 2 = 0"), docs)


@query("""WITH c AS (SELECT item_id AS case_id, split_part(text, ' ', 1) AS w, split_part(text, ' ', 2) AS x FROM benchmark), h AS (SELECT c.case_id, d.doc_id, row_number() OVER (PARTITION BY c.case_id ORDER BY d.doc_id) AS rank, contains(d.text, c.x) AS good, d.source FROM c JOIN documents d ON contains(lower(d.text), lower(c.w))),
p AS (SELECT case_id, min(CASE WHEN good THEN rank END) AS f, count(*) AS n, count(*) FILTER (source = 'src0') AS g FROM h WHERE rank <= 10 GROUP BY 1)
SELECT round(avg(CASE WHEN f IS NULL THEN 0 ELSE 1 END), 3) AS recall_at_k, round(avg(coalesce(1.0 / f, 0.0)), 3) AS mrr, round(avg(CASE WHEN coalesce(g, 0) > 0 THEN 1.0 ELSE 0.0 END), 3) AS conv_recall, round(avg(coalesce(g, 0) / greatest(coalesce(n, 1), 1)), 3) AS precision FROM c LEFT JOIN p USING (case_id)""")
def eval_mrr(s, d):
    """Search for the first word of every item; a hit is good if it holds the second."""
    from ..operators import health as H

    b = table(s, d, "benchmark")
    word = lambda i: F.get(F.split("text", " "), i)
    c = b.select(F.col("item_id").alias("case_id"), F.array(word(1)).alias("expect_any"), F.array(F.lit("src0")).alias("gold"))
    hits = S.contains_search(_doc_units(s, d), b.select(F.col("item_id").alias("query_id"), word(0).alias("needle")), 10)
    h = hits.select(F.col("query_id").alias("case_id"), "unit_id", "rank").join(_doc_units(s, d), "unit_id")
    return H.retrieval_metrics(c, h, 10)


@query("SELECT event_type, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 GROUP BY 1")
def json_props(s, d):
    e = table(s, d, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return R.counts(e.where("k >= 50"), F.col("event_type"), "event_type")


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings")
def vector_norms(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


QUERIES, ORACLE = query.queries, query.oracle
