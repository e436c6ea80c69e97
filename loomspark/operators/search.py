"""Hybrid retrieval for many queries at once.

Channels give candidates as (query_id, unit_id, channel, score); they are fused, valued, thresholded, admitted and
diversified. Only the last, greedy step runs on grouped pandas, over at most a few times ``k`` rows of a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources.state import cut
from . import index as I


@dataclass(frozen=True)
class Level:
    """How widely a search looks and how strictly it keeps."""

    candidate_k: int
    threshold_floor: float
    curate_floor: float
    literal_seats: int
    page_quota: int
    page_literal_seats: int
    literal_required_below: float
    page_floor_ratio: float


#: Recall levels 1 to 5. Fixed values.
LEVELS = {
    1: Level(20, 0.35, 0.90, 1, 1, 1, 0.95, 0.5),
    2: Level(25, 0.30, 0.85, 2, 2, 1, 0.85, 0.3),
    3: Level(30, 0.20, 0.80, 2, 3, 1, 0.70, 0.1),
    4: Level(40, 0.15, 0.75, 3, 4, 2, 0.50, 0.0),
    5: Level(60, 0.10, 0.70, 4, 5, 3, 0.30, 0.0),
}
PAGE_CHANNEL_K = 8
LITERAL = ("phrase", "ident", "page_fts", "fts")


def level_of(n: int | None, override: int | None = None) -> Level:
    """The caller's level if valid, else the general one, else 3."""
    return LEVELS.get(override) or LEVELS.get(n) or LEVELS[3]


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "unit_id") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries that travel to the tasks at once, needles and grams that become a literal, and needles that are looked for one by one.
QUERY_BLOCK, LITERALS, FEW = 2048, 16_384, 64
#: Queries and units of a cell of the product, and products that a task holds at once.
CELL, TILE = 16_384, 1 << 20


def _best(ids: np.ndarray, q: np.ndarray, units: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of ``x`` for each row of ``q`` (both of unit length), ties by id.

    Products are made tile by tile. What is near the k-th score is computed again pair by pair, since equal vectors at two
    places of a product of matrices may differ in their last bits.
    """
    out = [pd.DataFrame({"query_id": ids[:0], "unit_id": units[:0], "score": np.empty(0)})]
    step = max(1, TILE // max(1, len(x)))
    for a in range(0, len(q), step):
        sims = np.maximum(q[a : a + step] @ x.T, 0.0)
        cut = np.partition(sims, -k, axis=1)[:, -k] - 1e-12 if sims.shape[1] > k else np.full(len(sims), -1.0)
        i, j = np.nonzero(sims >= cut[:, None])  # everything that equals the k-th score stays until it is ranked
        score = np.zeros(len(i))
        for b in range(0, len(i), TILE // 16):
            few = slice(b, b + TILE // 16)
            score[few] = np.maximum((q[a + i[few]] * x[j[few]]).sum(axis=1), 0.0)
        order = np.lexsort((units[j], -score, i))  # rows of a query, best first
        i, j, score = i[order], j[order], score[order]
        starts = np.searchsorted(i, i)
        first = np.arange(len(i)) - starts < k
        out.append(pd.DataFrame({"query_id": ids[a + i[first]], "unit_id": units[j[first]], "score": score[first]}))
    return pd.concat(out[1:] or out)


def _matrix(pdf: pd.DataFrame, dim: int | None = None) -> tuple[np.ndarray, pd.DataFrame]:
    """Unit rows of the vectors of ``dim`` entries, and the rows of the frame they are of."""
    pdf = pdf[pdf["embedding"].map(lambda v: v is not None and (dim is None or len(v) == dim))]
    x = np.array(pdf["embedding"].tolist(), dtype=np.float64).reshape(len(pdf), -1) if len(pdf) else np.zeros((0, dim or 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), pdf


def knn(units: DataFrame, queries: pd.DataFrame | DataFrame, k: int, exclude: DataFrame | None = None, channel: str = "vec") -> DataFrame:
    """Exact nearest neighbours of a stated set of queries (columns query_id, embedding).

    Up to ``QUERY_BLOCK`` queries travel to the tasks: every partition of ``units`` (unit_id, embedding) multiplies its
    vectors with all of them and keeps k for each; only those are shuffled. More queries never come to the driver: blocks
    of queries and blocks of units meet in cells, and each cell keeps k for each of its queries. Excluded ids are dropped
    first, so no over-fetch is needed.
    """
    if exclude is not None:
        units = units.join(exclude.select("unit_id"), "unit_id", "left_anti")
    units = units.where("embedding IS NOT NULL")  # units without a vector are in no block
    if isinstance(queries, DataFrame):
        few = queries.select("query_id", "embedding").limit(QUERY_BLOCK + 1).toPandas()
        if len(few) > QUERY_BLOCK:
            return top_k(_cells(units, queries, k), k).select("query_id", "unit_id", F.lit(channel).alias("channel"), "score", "rank")
        queries = few.sort_values("query_id")
    q, asked = _matrix(queries)
    ids = asked["query_id"].to_numpy()

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"query_id": [], "unit_id": [], "score": []})
        for pdf in frames:
            x, pdf = _matrix(pdf, q.shape[1])
            if len(pdf) and len(ids):
                found = _best(ids, q, pdf["unit_id"].to_numpy(), x, k)
                best = pd.concat([best, found]).sort_values(["query_id", "score", "unit_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if len(best):
            yield best.astype({"query_id": "int64", "unit_id": "int64", "score": "float64"})

    found = units.select("unit_id", "embedding").mapInPandas(nearest, "query_id bigint, unit_id bigint, score double")
    return top_k(found, k).select("query_id", "unit_id", F.lit(channel).alias("channel"), "score", "rank")


def _cells(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, unit_id, score): the k nearest of each query in every block of units."""
    n_q, n_u = (max(1, -(-df.count() // CELL)) for df in (queries, units))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides may come from one table: their columns get names of their own
    q = queries.select("query_id", F.col("embedding").alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("qb"), every(n_u).alias("ub"))
    u = units.select("unit_id", F.col("embedding").alias("held"), F.pmod(F.xxhash64("unit_id"), F.lit(n_u)).cast("int").alias("u_ub"), every(n_q).alias("u_qb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.rename(columns={"asked": "embedding"}), right.rename(columns={"held": "embedding"})
        out = [pd.DataFrame({"query_id": left["query_id"][:0], "unit_id": right["unit_id"][:0], "score": np.empty(0)})]
        for dim in left["embedding"].map(lambda v: -1 if v is None else len(v)).unique():
            a, asked = _matrix(left, dim)
            x, held = _matrix(right, dim)
            if len(asked) and len(held):
                out.append(_best(asked["query_id"].to_numpy(), a, held["unit_id"].to_numpy(), x, k))
        return pd.concat(out)

    return q.groupBy("qb", "ub").cogroup(u.groupBy("u_qb", "u_ub")).applyInPandas(meet, "query_id bigint, unit_id bigint, score double")


def gram_search(units: DataFrame | None, queries: DataFrame, k: int, weights: dict[str, float] | None = None, channel: str = "fts", k1: float = 1.2, b: float = 0.75, index: I.TextIndex | None = None, group: str | None = None) -> DataFrame:
    """Trigram OR search ranked by BM25; the score is ``1 / rank``. Queries without a usable gram use containment.

    ``queries`` (query_id, text) is a stated set; each distinct text is searched once. Hits come from one pass over the
    texts, which sends the asked grams only, or from an ``index`` (of one field), which opens the asked grams only;
    ``group`` then confines the search to a group of units and its statistics.
    """
    weights = weights or {"text": 1.0}
    texts = queries.groupBy("text").agg(F.min("query_id").alias("first"))
    asked = texts.select("first", F.explode(T.trigrams(F.lower("text"), 16)).alias("gram")).select("first", I.code_of(F.col("gram")).alias("code"))
    # at most 16 grams a query; more than fit a literal are asked in blocks
    wanted = sorted(r["code"] for r in asked.select("code").distinct().collect())
    hit = None
    for block in [wanted[i : i + LITERALS] for i in range(0, len(wanted), LITERALS)] or [[]]:
        for field, weight in weights.items():
            rows = index.hits(block, group) if index is not None else I.hits_by_scan(units, block, field)
            rows = rows.select("unit_id", "code", (F.lit(weight) * F.col("tf")).alias("tf"), "len")
            hit = rows if hit is None else hit.unionByName(rows)
    if len(weights) > 1:
        hit = hit.groupBy("unit_id", "code").agg(F.sum("tf").alias("tf"), F.sum("len").alias("len"))
    hit = cut(hit, "hits")  # read twice
    if index is not None:
        n, length = index.statistics(group)
    else:
        size = sum((F.greatest(F.length(F.coalesce(F.col(f), F.lit(""))) - 2, F.lit(0)) for f in weights), F.lit(0))
        n, length = units.select(size.alias("n")).agg(F.count(F.lit(1)), F.greatest(F.avg("n"), F.lit(1.0))).first()
    df = hit.groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(length or 1.0)))
    scored = hit.join(df.join(asked, "code"), "code").groupBy("first", "unit_id").agg(F.round(F.sum(part), 9).alias("bm25"))  # the last bits depend on the order of a sum
    ranked = top_k(scored, k, ("first",), "bm25")
    by_gram = ranked.join(texts, "first").join(queries, "text").select("query_id", "unit_id", F.lit(channel).alias("channel"), (1.0 / F.col("rank")).alias("score"), F.col("rank").cast("int").alias("rank"))
    if units is None:
        return by_gram
    plain = queries.join(texts.join(asked.select("first").distinct(), "first", "left_anti"), "text", "left_semi").select("query_id", F.col("text").alias("needle"))
    return by_gram if plain.isEmpty() else by_gram.unionByName(contains_search(units, plain, k, tuple(weights), channel))


def needles_in(units: DataFrame, needles: list[str], fields: tuple[str, ...]) -> DataFrame:
    """(unit_id, needle) of the lower-cased needles that a unit holds in one of the fields.

    A text is lower-cased once. A few needles are looked for one by one, more by an automaton in one pass over the text.
    """
    low = units.select("unit_id", *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"low{i}") for i, f in enumerate(fields)])
    low = low.where(F.lit(bool(needles)))
    if len(needles) <= FEW:
        held = lambda n: F.greatest(*[F.contains(f"low{i}", F.lit(n)) for i in range(len(fields))], F.lit(False))
        found = F.array_compact(F.array(*[F.when(held(n), F.lit(n)) for n in needles], F.lit(None).cast("string")))
        return low.select("unit_id", F.explode(found).alias("needle"))
    kind = units.schema["unit_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n in needles:
            if n:
                automaton.add_word(n, n)
        automaton.make_automaton()
        empty = [""] if "" in needles else []
        for pdf in frames:
            found = [{n for i in range(len(fields)) for _, n in automaton.iter(row[i + 1])} | set(empty) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame({"unit_id": pdf["unit_id"].repeat([len(x) for x in found]), "needle": [n for x in found for n in sorted(x)]})

    return low.mapInPandas(run, f"unit_id {kind}, needle string")


def contains_search(units: DataFrame, needles: DataFrame, k: int, fields: tuple[str, ...] = ("text",), channel: str = "ident") -> DataFrame:
    """Literal search of several needles a query: most needles first, then id. The score is 1.

    Needles are a stated set; each distinct one is looked for once, ``LITERALS`` of them in a pass. Queries with the same
    needles have the same hits: these are ranked once, and only the k that are left go to each of the queries.
    """
    own = needles.where("needle IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set("needle")).alias("needles"))
    sets = own.groupBy("needles").agg(F.min("query_id").alias("first"))
    asked = sets.select("first", F.explode("needles").alias("needle")).withColumn("low", F.lower("needle"))
    distinct = sorted(r["low"] for r in asked.select("low").distinct().collect())
    found = None
    for block in [distinct[i : i + LITERALS] for i in range(0, len(distinct), LITERALS)] or [[]]:
        rows = needles_in(units, block, fields)
        found = rows if found is None else found.unionByName(rows)
    rows = found.withColumnRenamed("needle", "low").join(F.broadcast(asked), "low").groupBy("first", "unit_id").agg(F.count_distinct("needle").cast("double").alias("n"))
    ranked = top_k(rows, k, ("first",), "n").join(sets, "first").join(own, "needles")
    return ranked.select("query_id", "unit_id", F.lit(channel).alias("channel"), F.lit(1.0).alias("score"), "rank")


def identifier_search(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return contains_search(units, queries.select("query_id", F.explode(T.identifiers(F.col("text"))).alias("needle")), k, ("text",), "ident")


def phrase_search(units: DataFrame, queries: DataFrame, k: int, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    return contains_search(units, queries.select("query_id", F.explode(T.phrases(F.col("text"))).alias("needle")), k, fields, "phrase")


def fuse(channels: DataFrame) -> DataFrame:
    """(query_id, unit_id, best, rel, n_channels, signals): best channel score plus weighted reciprocal ranks."""
    rrf = F.sum(1.0 / (V.RRF_K + F.col("rank")))
    return channels.groupBy("query_id", "unit_id").agg(
        F.max("score").alias("best"), (F.max("score") + V.RRF_WEIGHT * rrf).alias("rel"), F.count(F.lit(1)).alias("n_channels"), F.array_sort(F.collect_set("channel")).alias("signals")
    )


def apply_values(fused: DataFrame, values: DataFrame, now: float, include_low: bool = False) -> DataFrame:
    """Raise relevance by value (unit_id, value, manual_value, time, locked); a value of zero or less drops the row."""
    v = values.select("unit_id", F.coalesce("manual_value", "value").alias("_v"), (F.lit(now) - F.col("time")).alias("_age"), F.coalesce("locked", F.lit(False)).alias("_lock"))
    out = fused.join(v, "unit_id", "left").withColumn("_b", V.boost(F.col("rel"), F.col("_v"), F.col("_age"), F.coalesce("_lock", F.lit(False))))
    if include_low:
        out = out.withColumn("_b", F.coalesce("_b", "rel"))
    return out.where(F.col("_b").isNotNull()).withColumn("rel", F.col("_b")).drop("_v", "_age", "_lock", "_b")


def threshold(fused: DataFrame, floor: float, is_page: str | None = None) -> DataFrame:
    """Keep rows near the best of their query, pages, and strong rows of two channels; plus ``bypassed``."""
    top = F.max("rel").over(Window.partitionBy("query_id"))
    page = F.coalesce(F.col(is_page), F.lit(False)) if is_page else F.lit(False)
    near = F.col("rel") >= floor * F.col("_top")
    strong = (F.col("n_channels") >= 2) & (F.col("best") >= V.STRONG)
    return fused.withColumn("_top", top).where(page | near | strong).withColumn("bypassed", ~page & ~near & strong).drop("_top")


def seat_cap(ranked: DataFrame, cap: int = 2, group: str = "conversation_id") -> DataFrame:
    w = Window.partitionBy("query_id", group).orderBy(F.desc(F.round("rel", 9)), "unit_id")  # the last bits depend on the order of a sum
    return ranked.withColumn("seat", F.row_number().over(w)).where(F.col("seat") <= cap)


def admit_pages(rows: pd.DataFrame, level: Level) -> set[int]:
    """Ids of the pages of one query that are let in. Rows: unit_id, rel, is_page, signals; best first."""
    if rows.empty:
        return set()
    floor = level.page_floor_ratio * rows["rel"].iloc[0]
    pages = [(r.unit_id, r.rel, any(s in LITERAL for s in r.signals)) for r in rows.itertuples() if r.is_page and r.rel >= floor]
    high = [p for p, score, _ in pages if score >= level.literal_required_below]
    low = [p for p, score, literal in pages if score < level.literal_required_below and literal]
    picked: list[int] = []
    for pool, upto in ((high, level.page_quota - level.page_literal_seats), (low, level.page_quota), (high, level.page_quota)):
        for p in pool:
            if len(picked) >= upto:
                break
            if p not in picked:
                picked.append(p)
    return set(picked)


def diversify(rows: pd.DataFrame, k: int, weight: float = 0.7, cap: int = 2) -> list[int]:
    """Positions of k rows by maximal marginal relevance, at most ``cap`` of a conversation (memories and pages are free)."""
    pool = rows.head(4 * k).reset_index(drop=True)
    if pool.empty:
        return []
    top = max(pool["rel"].iloc[0], 1e-12)
    unit = [None if v is None else np.asarray(v, float) / max(np.linalg.norm(v), 1e-12) for v in pool["embedding"]]
    seats: dict[object, int] = {}
    near = np.zeros(len(pool))
    picked: list[int] = []
    key = [("own", i) if free else c for i, (c, free) in enumerate(zip(pool["conversation_id"], pool["free"], strict=True))]
    while len(picked) < k:
        open_ = [i for i in range(len(pool)) if i not in picked and seats.get(key[i], 0) < cap]
        if not open_:
            break
        best = max(open_, key=lambda i: (weight * pool["rel"][i] / top - (1 - weight) * near[i], -i))
        picked.append(best)
        seats[key[best]] = seats.get(key[best], 0) + 1
        if unit[best] is not None:
            for i in open_:
                if unit[i] is not None:
                    near[i] = max(near[i], float(unit[i] @ unit[best]))
    return picked


def reserve(picked: pd.DataFrame, admitted: pd.DataFrame, quota: int) -> pd.DataFrame:
    """Give admitted pages their seats by replacing the last rows that are no pages."""
    rows = picked.to_dict("records")
    waiting = [r for r in admitted.to_dict("records") if r["unit_id"] not in {x["unit_id"] for x in rows}]
    have = sum(r["is_page"] for r in rows)
    for page in waiting:
        if have >= quota:
            break
        last = next((i for i in range(len(rows) - 1, -1, -1) if not rows[i]["is_page"]), None)
        if last is None:
            rows.append(page)
        else:
            rows[last] = page
        have += 1
    return pd.DataFrame(rows, columns=picked.columns).sort_values(["rel", "unit_id"], ascending=[False, True])


def select_tail(ranked: DataFrame, k: int, level: Level = LEVELS[3]) -> DataFrame:
    """The greedy end of a search: admission of pages, diversity, reservation of seats.

    ``ranked`` (query_id, unit_id, rel, is_page, free, conversation_id, signals, embedding) is cut to the rows that the
    tail can look at before it is grouped: 4 k others and the pages of the channel.
    """
    w = Window.partitionBy("query_id", "is_page").orderBy(F.desc("rel"), "unit_id")
    few = ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 4 * k + PAGE_CHANNEL_K * 4).drop("_r")

    def tail(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rel", "unit_id"], ascending=[False, True]).reset_index(drop=True)
        pages = admit_pages(pdf, level)
        pdf = pdf[~pdf["is_page"] | pdf["unit_id"].isin(pages)].reset_index(drop=True)
        chosen = pdf.iloc[diversify(pdf, k)]
        out = reserve(chosen, pdf[pdf["is_page"]], min(level.page_quota, len(pages)))
        out = out.assign(position=range(1, len(out) + 1))
        return out[["query_id", "unit_id", "rel", "is_page", "position"]]

    columns = ["query_id", "unit_id", "rel", "is_page", "free", "conversation_id", "signals", "embedding"]
    return few.select(*columns).groupBy("query_id").applyInPandas(tail, "query_id bigint, unit_id bigint, rel double, is_page boolean, position int")


def collapse_duplicates(hits: DataFrame) -> DataFrame:
    """Of a query's hits with one fingerprint or one text (white space aside), the best stays.

    Two ranked passes: first by fingerprint, then by text.
    """
    squeezed = F.md5(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", ""))
    own = F.concat(F.lit("u"), F.col("unit_id"))
    by_hash = F.when(F.col("src_id").rlike("^(mcp|dst)_"), F.substring("src_id", 5, 16)).otherwise(own)
    order = [F.desc("rel"), "unit_id"]
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", by_hash).orderBy(*order))).where("_r = 1")
    by_text = F.when(F.col("src_id").rlike("^(mcp|dst)_"), squeezed).otherwise(own)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", by_text).orderBy(*order))).where("_r = 1").drop("_r")


def curate(hits: DataFrame, level: Level = LEVELS[3], most: int = 20) -> DataFrame:
    """Keep hits near the best, some literal ones below, and pages; never nothing if there is a hit that is no page."""
    q = Window.partitionBy("query_id")
    literal = F.arrays_overlap("signals", F.array(*[F.lit(x) for x in ("phrase", "ident", "fts")]))
    h = hits.withColumn("_thr", level.curate_floor * F.max("rel").over(q))
    kind = F.when(F.col("is_page"), "page").when(F.col("rel") >= F.col("_thr"), "high").when(literal, "low")
    h = h.withColumn("_kind", kind).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_kind").orderBy(F.desc("rel"), "unit_id")))
    n = lambda k: F.sum((F.col("_kind") == k).cast("int")).over(q)
    h = h.withColumn("_pages", F.least(n("page"), F.lit(level.page_quota))).withColumn("_room", F.greatest(F.lit(most) - F.col("_pages"), F.lit(0)))
    h = h.withColumn("_seats", F.least(F.lit(level.literal_seats), F.col("_room"), n("low"))).withColumn("_rest", F.row_number().over(Window.partitionBy("query_id", "is_page").orderBy(F.desc("rel"), "unit_id")))
    keep = ((F.col("_kind") == "page") & (F.col("_r") <= F.col("_pages"))) | ((F.col("_kind") == "high") & (F.col("_r") <= F.col("_room") - F.col("_seats"))) | ((F.col("_kind") == "low") & (F.col("_r") <= F.greatest(F.col("_seats"), F.col("_room") - F.least(n("high"), F.col("_room") - F.col("_seats")))))
    h = h.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    h = h.withColumn("_none", F.max(F.col("_keep").cast("int")).over(q) == 0)
    return h.where(F.col("_keep") | (F.col("_none") & ~F.col("is_page") & (F.col("_rest") == 1))).drop("_thr", "_kind", "_r", "_pages", "_room", "_seats", "_rest", "_keep", "_none")


def hybrid(units: DataFrame, queries: DataFrame, query_vectors: pd.DataFrame | DataFrame, values: DataFrame, now: float, k: int = 8, level: Level = LEVELS[3]) -> DataFrame:
    """The whole search over units (unit_id, text, src_id, conversation_id, embedding): one plan for all queries."""
    n = level.candidate_k
    channels = knn(units, query_vectors, n).withColumn("rank", F.col("rank").cast("int"))
    for part in (gram_search(units, queries, n), identifier_search(units, queries, n), phrase_search(units, queries, n)):
        channels = channels.unionByName(part)
    kept = fuse(channels)
    info = units.select("unit_id", "conversation_id", "src_id", "embedding", (T.kind_of(F.col("src_id")) == "wiki").alias("is_page"), (T.kind_of(F.col("src_id")) != "message").alias("free"))
    kept = apply_values(kept, values, now).join(info, "unit_id")
    return select_tail(threshold(kept, level.threshold_floor, "is_page"), k, level)
