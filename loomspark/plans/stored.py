"""Queries that go through what the library stores: transcripts written and read by the data source, kept indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import materials as A
from ..operators import models as M
from ..operators import nested as N
from ..operators import packing as P
from ..operators import search as S
from ..operators import vectors as V
from ..sources import convert as C
from ..sources import transcript_source as X
from ..sources.state import read_evolved, save_version, shared_dir
from .base import Registry, table
from .search import _GRAMS, _NOISE, _Q, EVERY, _query_vectors, _texts, _vectors

query = Registry()


def _place(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT CAST(conv_id AS VARCHAR) AS conversation_id, count(*) AS n_events, count(*) FILTER (role = 'assistant') AS n_assistant, sum(length(text)) AS n_chars, CAST(min(1704067200 + turn * 60) AS DOUBLE) AS started, max(text) AS last_text
FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def transcripts_stored(s, d):
    """Conversations written as compressed transcripts and read back by the data source."""
    c = table(s, d, "conversations")
    null = lambda name: F.lit(None).cast("string").alias(name)
    events = c.select(F.lit("conv").alias("source"), F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), *map(null, ("tool_name", "tool_input", "tool_output", "reasoning")), (1704067200.0 + F.col("turn") * 60).cast("double").alias("time"), F.concat_ws("-", "conv_id", "turn").alias("src_id"), null("parent_id"))
    X.register(s)
    place = _place(s, "transcripts")
    events.write.format("transcripts").mode("append").save(place)
    back = X.events(s, place, kind="jsonl_zstd").where(F.trim("content") != "")
    return back.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.sum(F.length("content")).alias("n_chars"), F.min("time").alias("started"), F.max("content").alias("last_text")
    )


def _amended(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and the new texts of one in a hundred."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("unit_id"), "text", "source")
    return docs, docs.where("unit_id % 100 = 0").withColumn("text", F.concat("text", F.lit(" amended: the thing")))


def _kept_index(s: SparkSession, d: str) -> I.TextIndex:
    """An index of all documents into which changed texts, and the removal of others, came as a second segment."""
    docs, changed = _amended(s, d)
    index = I.TextIndex(s, _place(s, "index"))
    index.update(docs, group="source")
    index.update(changed, docs.where("unit_id % 100 = 1").select("unit_id"), group="source")
    return index


_NOW = "docs AS (SELECT doc_id AS unit_id, source, CASE WHEN doc_id % 100 = 0 THEN text || ' amended: the thing' ELSE text END AS text FROM documents WHERE doc_id % 100 <> 1)"
_BM25 = """{q}, {now}, asked AS (SELECT DISTINCT query_id, unnest(list_slice(list_filter({grams}, lambda g: NOT regexp_full_match(g, '[{noise}]{{3}}')), 1, 16)) AS gram FROM q),
own AS (SELECT * FROM docs {where}), dx AS (SELECT unit_id, lower(text) AS x, greatest(length(lower(text)) - 2, 0) AS len FROM own), st AS (SELECT count(*) AS n, greatest(avg(len), 1.0) AS avg_len FROM dx),
g AS (SELECT unit_id, len, unnest(list_transform(range(1, len + 1), lambda i: substr(x, i, 3))) AS gram FROM dx), hit AS (SELECT unit_id, gram, len, count(*) AS tf FROM g WHERE gram IN (SELECT gram FROM asked) GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM hit GROUP BY 1),
sc AS (SELECT query_id, unit_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))) AS bm FROM hit JOIN df USING (gram) JOIN asked USING (gram), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 9) DESC, unit_id) AS rank FROM sc) SELECT query_id, unit_id, round(1.0 / rank, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"""


def _bm25_sql(where: str) -> str:
    return "WITH " + _BM25.format(q=_Q, now=_NOW, grams=_GRAMS.format("lower(text)"), noise=_NOISE, where=where)


@query(_bm25_sql(""))
def index_bm25(s, d):
    """Ranked search off the kept index, after an update."""
    return S.gram_search(None, _texts(s, d), 20, index=_kept_index(s, d)).select("query_id", "unit_id", F.round("score", 6).alias("score"), "rank")


@query(_bm25_sql("WHERE source = 'src0'"))
def index_subset(s, d):
    """The same within one group, off the index after its segments were merged."""
    index = _kept_index(s, d)
    index.merge()
    return S.gram_search(None, _texts(s, d), 20, index=index, group="src0").select("query_id", "unit_id", F.round("score", 6).alias("score"), "rank")


@query()
def vector_index_knn(s, d):
    """Nearest neighbours off the kept index: one half of the vectors built in, the other half added."""
    v = _vectors(s, d)
    index = V.VectorIndex(s, _place(s, "vectors")).build(v.where("unit_id % 2 = 0"))
    index.add(v.where("unit_id % 2 = 1"))
    return index.search(_query_vectors(s, d), 10).select("query_id", "unit_id", F.round("score", 5).alias("score"), "rank")


@query()
def triage_stored(s, d):
    """Every fiftieth memory is new and judged against all others, which are in the index."""
    v = _vectors(s, d)
    top = v.count()
    index = V.VectorIndex(s, _place(s, "vectors")).build(v.where(f"unit_id % {EVERY} <> 0"))
    new = v.where(f"unit_id % {EVERY} = 0").withColumn("unit_id", F.col("unit_id") + top)  # new ids come after stored ones
    return V.triage_new(index, new, 0.45, 0.35)


def _packs_sql(source: str, k: int) -> str:
    """Common table expressions p{k} (grp, id, n, batch): next-fit packing of ``source`` (grp, id, n)."""
    return f"""s{k} AS (SELECT grp, id, n, n + 60 AS c, row_number() OVER (PARTITION BY grp ORDER BY id) AS r FROM {source}),
p{k} AS (SELECT grp, id, n, r, c AS fill, 0 AS batch FROM s{k} WHERE r = 1
  UNION ALL SELECT s.grp, s.id, s.n, s.r, CASE WHEN p.fill + s.c > 60000 THEN s.c ELSE p.fill + s.c END, CASE WHEN p.fill + s.c > 60000 THEN p.batch + 1 ELSE p.batch END FROM p{k} p JOIN s{k} s ON s.grp = p.grp AND s.r = p.r + 1)"""


def _next_sql(k: int) -> str:
    """The entries of the round after k: batches of more than one entry at half their size, of groups that have several."""
    return f"""e{k} AS (SELECT grp, min(id) AS id, CASE WHEN count(*) > 1 THEN CAST(sum(n) AS BIGINT) // 2 ELSE CAST(sum(n) AS BIGINT) END AS n, batch FROM p{k} GROUP BY grp, batch),
t{k} AS (SELECT grp, id, n FROM e{k} WHERE grp IN (SELECT grp FROM e{k} WHERE batch > 0) AND EXISTS (SELECT 1 FROM p{k} GROUP BY grp, batch HAVING count(*) > 1))"""


_ENTRIES = "d AS (SELECT source AS grp, doc_id AS id, CAST(length(text) AS BIGINT) AS n FROM documents)"


@query(f"WITH RECURSIVE {_ENTRIES}, {_packs_sql('d', 1)} SELECT grp AS source, id AS doc_id, CAST(batch AS BIGINT) AS batch FROM p1")
def merge_packs(s, d):
    """Documents of a source packed in order into prompts of 60,000 characters."""
    entries = table(s, d, "documents").select(F.col("source").alias("group"), F.col("doc_id").alias("id"), F.length("text").alias("n"))
    return P.packed(entries).select(F.col("group").alias("source"), F.col("id").alias("doc_id"), "batch")


@query(f"""WITH RECURSIVE {_ENTRIES}, {_packs_sql('d', 1)}, {_next_sql(1)}, {_packs_sql('t1', 2)}, {_next_sql(2)}, {_packs_sql('t2', 3)}
SELECT grp AS source, id AS doc_id, 1 AS round, CAST(batch AS BIGINT) AS batch FROM p1 UNION ALL SELECT grp, id, 2, CAST(batch AS BIGINT) FROM p2 UNION ALL SELECT grp, id, 3, CAST(batch AS BIGINT) FROM p3""")
def merge_rounds(s, d):
    """Three rounds of merging, in which a merge leaves half of what went in."""
    entries = table(s, d, "documents").select(F.col("source").alias("group"), F.col("doc_id").alias("id"), F.length("text").alias("n"))
    half = lambda df: df.select("group", "batch", F.floor(F.col("n") / 2).alias("n"))
    return P.merge_rounds(entries, half).select(F.col("group").alias("source"), F.col("id").alias("doc_id"), "round", "batch")


#: Actions of the documents' numbers; converted is the most frequent.
_ACTIONS = ("ingest", "converted", "converted", "ingest", "error", "retry", "converted", "reconvert", "ingest", "converted", "retract", "ingest", "converted", "error", "forget", "odd")
_ACTION_SQL = "(['" + "', '".join(_ACTIONS) + "'])[n_chars % 16 + 1]"


@query(f"""WITH RECURSIVE c AS (SELECT source AS doc, doc_id AS no, {_ACTION_SQL} AS action, lang AS sha, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
w AS (SELECT doc, no, action, sha, r, 'none' AS before, CASE WHEN action = 'ingest' THEN 'pending' ELSE 'none' END AS after, action = 'ingest' AS legal, CASE WHEN action = 'ingest' THEN sha END AS held FROM c WHERE r = 1
  UNION ALL SELECT c.doc, c.no, c.action, c.sha, c.r, w.after,
    CASE WHEN c.action = 'ingest' THEN CASE WHEN w.after = 'ok' AND w.held = c.sha THEN 'ok' ELSE 'pending' END
      WHEN c.action = 'converted' AND w.after = 'pending' THEN 'ok' WHEN c.action = 'error' AND w.after = 'pending' THEN 'failed' WHEN c.action = 'retry' AND w.after = 'failed' THEN 'pending'
      WHEN c.action = 'reconvert' AND w.after IN ('ok', 'failed') THEN 'pending' WHEN c.action = 'retract' AND w.after IN ('pending', 'ok', 'failed') THEN 'retracted' WHEN c.action = 'forget' THEN 'none' ELSE w.after END,
    c.action = 'ingest' OR (c.action IN ('converted', 'error') AND w.after = 'pending') OR (c.action = 'retry' AND w.after = 'failed') OR (c.action = 'reconvert' AND w.after IN ('ok', 'failed'))
      OR (c.action = 'retract' AND w.after IN ('pending', 'ok', 'failed')) OR (c.action = 'forget' AND w.after <> 'none'),
    CASE WHEN c.action = 'ingest' THEN c.sha WHEN c.action = 'forget' THEN NULL ELSE w.held END
  FROM w JOIN c ON c.doc = w.doc AND c.r = w.r + 1)
SELECT doc, no, action, before, after, legal FROM w""")
def material_commands(s, d):
    """Documents as commands on their source, in the order of their ids: the state before and after each."""
    action = F.get(F.array(*map(F.lit, _ACTIONS)), (F.col("n_chars") % 16).cast("int"))
    commands = table(s, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("no"), action.alias("action"), F.col("lang").alias("sha"))
    return A.folded(commands).select("doc", "no", "action", "before", "after", "legal")


@query("""WITH n AS (SELECT conv_id, turn, role, length(text) AS len FROM conversations),
v AS (SELECT conv_id, '$.conv' AS path, CAST(conv_id AS BIGINT) AS value FROM (SELECT DISTINCT conv_id FROM n)
  UNION ALL SELECT conv_id, '$.turns[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '].n', turn FROM n
  UNION ALL SELECT conv_id, '$.turns[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '].about.size.len', CAST(len AS BIGINT) FROM n)
SELECT conv_id, path, value FROM v""")
def nested_ints(s, d):
    """Conversations as nested JSON documents, and all whole numbers in them."""
    about = F.struct(F.struct(F.length("text").alias("len")).alias("size"), "role")
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("n"), about.alias("about"))))
    docs = table(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.first("conv_id").alias("conv"), turns.alias("turns"))).alias("j"))
    return N.flat_ints(docs, "j", ["conv_id"])


@query("SELECT page_id, substr(sha256(html), 1, 16) AS doc_id, 'html' AS kind, CAST(NULL AS VARCHAR) AS error FROM pages WHERE html IS NOT NULL")
def pages_converted(s, d):
    """Pages through the converters, in SQL; their names say nothing of what they hold."""
    C.register(s)
    view = f"pages_{uuid.uuid4().hex}"
    table(s, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")).createOrReplaceTempView(view)
    return s.sql(f"SELECT f.page_id, d.doc_id, d.kind, d.error FROM {view} f, LATERAL convert_document('page', f.content) d")


@query("""SELECT '1' AS version, 'unknown' AS lang, count(*) AS n, sum(n_chars) AS chars, count(*) AS n_backfilled FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT '2', lang, count(*), sum(n_chars), 0 FROM documents WHERE doc_id % 3 <> 0 GROUP BY lang""")
def versions_as_one(s, d):
    """Documents in a table whose second version has a column that the first lacked, and a wider one."""
    docs, root = table(s, d, "documents"), _place(s, "evolved")
    save_version(docs.where("doc_id % 3 = 0").select("doc_id", F.col("n_chars").cast("int").alias("n_chars")), root, "1")
    save_version(docs.where("doc_id % 3 <> 0").select("doc_id", "n_chars", "lang", F.lit(True).alias("checked")), root, "2")
    one = read_evolved(s, root, {"lang": F.lit("unknown"), "checked": F.col("doc_id") < 0})
    return one.groupBy("version", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_if(~F.col("checked")).alias("n_backfilled"))


_MODELS = {"fast": 16, "base": 64}
_COSINE = "greatest(list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(u.e AS DOUBLE[])), 0.0)"


@query(f"""WITH u AS (SELECT vec_id AS id, 'vec' AS channel, embedding[1:16] AS e FROM embeddings UNION ALL SELECT vec_id, 'vec:base', embedding FROM embeddings),
p AS (SELECT q.id AS query_id, u.id AS unit_id, u.channel, {_COSINE} AS score FROM u q JOIN u ON u.channel = q.channel WHERE q.id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, unit_id) AS rank FROM p)
SELECT query_id, unit_id, round(max(score), 5) AS best, round(max(score) + 0.4 * sum(1.0 / (60 + rank)), 5) AS rel, count(*) AS n_channels FROM r WHERE rank <= 20 GROUP BY ALL""")
def model_fusion(s, d):
    """Two models of different dimension as two channels; a third of the base vectors was lacking and is repaired first."""
    v = _vectors(s, d)
    fast = v.select("unit_id", F.lit("fast").alias("model"), F.slice("embedding", 1, 16).alias("embedding"))
    base = v.where("unit_id % 3 <> 0").select("unit_id", F.lit("base").alias("model"), "embedding")
    encoders = {"fast": lambda units: units.join(v, "unit_id").select("unit_id", F.slice("embedding", 1, 16).alias("embedding")), "base": lambda units: units.join(v, "unit_id").select("unit_id", "embedding")}
    vectors = M.repaired(v.select("unit_id"), fast.unionByName(base), _MODELS, encoders)
    queries = vectors.where(F.col("unit_id") % EVERY == 0).withColumnRenamed("unit_id", "query_id")
    fused = S.fuse(M.model_channels(vectors, queries, _MODELS, 20))
    return fused.select("query_id", "unit_id", F.round("best", 5).alias("best"), F.round("rel", 5).alias("rel"), "n_channels")


QUERIES, ORACLE = query.queries, query.oracle
