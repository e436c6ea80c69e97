"""A vector index that is kept: inverted lists around centroids, with the probes that an asked recall takes.

``build`` fits centroids to a sample of at most ``sample`` vectors (a stated bound; drawn by a hash of the id, so the same
for the same table), finds by the sample how many lists must be looked at for the asked recall, and deals **every** vector
to the list of its nearest centroid. ``add`` deals later vectors to the same lists. Centroids are the only thing that tasks
get from the driver: ``lists`` x dimension numbers, at most ``MOST_LISTS`` lists.

A search deals each query to its nearest lists; a list and the queries that probe it meet in cells. A list with more than
``CELL`` vectors (a cluster that holds a third of all rows, or copies of one vector) is split by a hash of the id, and
queries by blocks, so no cell grows with the table. Each cell compares exactly and keeps k for each query.

On vectors without clusters any index of this kind has to look at a large part of the lists: the probes are measured, not
promised. ``recall`` compares with the exact search. ``embedding`` null or of another length is in no list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import state
from . import search as S

SAMPLE, MOST_LISTS, CELL = 16_384, 4_096, 16_384
#: Queries of the sample by which probes are found.
TRIALS = 512


def centroids_of(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Spherical k-means on unit rows; a centroid that loses all its rows moves to the row that is worst served."""
    draw = np.random.default_rng(seed)
    c = x[draw.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        sims = x @ c.T
        own, best = sims.argmax(axis=1), sims.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """How many of its nearest lists a query must see so that ``recall`` of its ``k`` nearest sample rows are in them."""
    k = min(k, len(x))
    q = x[:: max(1, len(x) // TRIALS)][:TRIALS]
    own = (x @ c.T).argmax(axis=1)
    near = np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :], axis=1)  # at which probe a list comes
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


class VectorIndex:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, lists: int | None = None, recall: float = 0.97, k: int = 10, sample: int = SAMPLE, seed: int = 1) -> VectorIndex:
        """Fit to ``vectors`` (unit_id, embedding) and put all of them in."""
        own = vectors.select("unit_id", "embedding").where("embedding IS NOT NULL AND size(embedding) > 0")
        dims = own.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        n, dim = (dims[0]["count"], dims[0]["d"]) if dims else (0, 1)
        drawn = own.where(F.size("embedding") == dim).orderBy(F.xxhash64("unit_id"), "unit_id").limit(sample).toPandas()  # bounded
        x = S._matrix(drawn, dim)[0] if len(drawn) else np.ones((1, 1))
        lists = max(1, min(lists or int(np.sqrt(n)), MOST_LISTS, max(1, len(x) // 8)))
        c = centroids_of(x, lists, seed=seed)
        probes = probes_for(x, c, k, recall)
        rows = [(i, [float(v) for v in row], probes) for i, row in enumerate(c)]
        self.spark.createDataFrame(rows, "list int, center array<double>, probes int").coalesce(1).write.parquet(f"{self.root}/centers")
        self.add(own)
        return self

    def centers(self) -> tuple[np.ndarray, int]:
        """(centroids, probes): at most ``MOST_LISTS`` rows."""
        rows = self.spark.read.parquet(f"{self.root}/centers").orderBy("list").collect()
        return np.array([r["center"] for r in rows]), rows[0]["probes"]

    def add(self, vectors: DataFrame) -> None:
        """Deal vectors to their lists, as a batch of files of their own."""
        c, _ = self.centers()

        def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                x, pdf = S._matrix(pdf, c.shape[1])
                if len(pdf):
                    yield pdf.assign(list=(x @ c.T).argmax(axis=1).astype("int32"))

        kind = vectors.schema["embedding"].dataType.simpleString()
        dealt = vectors.select("unit_id", "embedding").mapInPandas(own, f"unit_id bigint, embedding {kind}, list int")
        found = state.versions(self.spark, f"{self.root}/lists")
        # a large list is written by several tasks, each in its own files
        dealt = dealt.repartition("list", F.pmod(F.xxhash64("unit_id"), F.lit(4))).sortWithinPartitions("list")
        state.save_version(dealt, f"{self.root}/lists", f"{len(found) + 1:06d}")

    def rows(self) -> DataFrame:
        """(unit_id, embedding, list) of all batches."""
        return self.spark.read.parquet(f"{self.root}/lists").select("unit_id", "embedding", "list")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, least: float | None = None) -> DataFrame:
        """(query_id, unit_id, score, rank) of ``queries`` (query_id, embedding): k nearest, of ``least`` or more where given."""
        c, known = self.centers()
        probes = min(len(c), probes or known)

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                q, pdf = S._matrix(pdf, c.shape[1])
                if len(pdf):
                    lists = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes].astype("int32")
                    yield pdf.assign(lists=list(lists))

        n_q = max(1, -(-queries.count() // S.QUERY_BLOCK))
        kind = queries.schema["embedding"].dataType.simpleString()
        asked = queries.select("query_id", "embedding").mapInPandas(near, f"query_id bigint, embedding {kind}, lists array<int>")
        asked = asked.select("query_id", "embedding", F.explode("lists").alias("list"), F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("qb"))
        rows = self.rows()
        parts = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))  # a row for each list
        salts = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        held = rows.join(F.broadcast(parts), "list").select("unit_id", F.col("embedding").alias("e"), F.col("list").alias("l"), F.pmod(F.xxhash64("unit_id"), F.col("parts")).cast("int").alias("s"), salts(F.lit(n_q)).alias("b"))
        asked = asked.join(F.broadcast(parts), "list").select("query_id", "embedding", "list", salts(F.col("parts")).alias("salt"), "qb")

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            q, left = S._matrix(left)
            x, right = S._matrix(right.rename(columns={"e": "embedding"}))
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "unit_id": [], "score": []}).astype({"query_id": "int64", "unit_id": "int64"})
            found = S._best(left["query_id"].to_numpy(), q, right["unit_id"].to_numpy(), x, k)
            return found if least is None else found[found["score"] >= least]

        cells = asked.groupBy("list", "salt", "qb").cogroup(held.groupBy("l", "s", "b")).applyInPandas(meet, "query_id bigint, unit_id bigint, score double")
        return S.top_k(cells, k).select("query_id", "unit_id", "score", F.col("rank").cast("int").alias("rank"))

    def recall(self, queries: DataFrame, k: int, vectors: DataFrame, probes: int | None = None) -> float:
        """Share of the exact k nearest of the queries that the index finds."""
        exact = S.knn(vectors, queries, k).select("query_id", "unit_id")
        found = self.search(queries, k, probes).select("query_id", "unit_id", F.lit(1).alias("hit"))
        return float(exact.join(found, ["query_id", "unit_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)


def triage_new(index: VectorIndex, new: DataFrame, duplicate: float, similar: float, k: int = 8) -> DataFrame:
    """(id, status, dedup_of) of new memories (unit_id, embedding) against those in the index and earlier ones of the batch.

    Stored memories are looked up in the index, ``k`` for each new one; the batch is compared with itself in blocks. Ids of
    stored memories are smaller than new ones. Equal vectors of a batch are compared once.
    """
    from . import memory as M

    stored = index.search(new.select(F.col("unit_id").alias("query_id"), "embedding"), k, least=similar)
    own, copies = M.equal_vectors(new)
    pairs = M.block_pairs(own, similar).unionByName(stored.select(F.col("unit_id").alias("a"), F.col("query_id").alias("b"), F.col("score").alias("sim")).where("a < b"))
    return M.triage(new.select(F.col("unit_id").alias("id")), pairs, duplicate, similar, copies)
