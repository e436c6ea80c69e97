"""Vectors of several models: keyed by unit and model, a channel for each, repaired where one lacks.

Models are a few names with a dimension each; the first is the one that is filled first (fast), the others follow. Vectors
of a wrong dimension count as lacking.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search as S


def channel_of(model: str, models: dict[str, int]) -> str:
    """``vec`` for the first model, ``vec:<model>`` for the others."""
    return "vec" if model == next(iter(models)) else f"vec:{model}"


def _own(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    return vectors.where((F.col("model") == model) & (F.size("embedding") == dim))


def model_channels(vectors: DataFrame, queries: DataFrame, models: dict[str, int], k: int) -> DataFrame:
    """(query_id, unit_id, channel, score, rank) of ``vectors`` (unit_id, model, embedding) for ``queries`` (query_id, model,
    embedding): each model's vectors are compared with queries of that model only."""
    out = None
    for model, dim in models.items():
        asked = _own(queries, model, dim).select("query_id", "embedding")
        rows = S.knn(_own(vectors, model, dim).select("unit_id", "embedding"), asked, k, channel=channel_of(model, models)).withColumn("rank", F.col("rank").cast("int"))
        out = rows if out is None else out.unionByName(rows)
    return out


def lacking(units: DataFrame, vectors: DataFrame, models: dict[str, int]) -> DataFrame:
    """(unit_id, model): the vectors that units lack, in the order in which models are filled (``turn``)."""
    turns = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(d).alias("dim"), F.lit(i).alias("turn")) for i, (m, d) in enumerate(models.items())]))
    wanted = units.select("unit_id", turns.alias("t")).select("unit_id", "t.*")
    have = vectors.where("embedding IS NOT NULL").select("unit_id", "model", F.size("embedding").alias("dim")).distinct()
    return wanted.join(have, ["unit_id", "model", "dim"], "left_anti").select("unit_id", "model", "turn")


def repaired(units: DataFrame, vectors: DataFrame, models: dict[str, int], encoders: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``vectors`` (unit_id, model, embedding) with what was lacking: each model's encoder gets the units that lack its
    vector, and only those, and gives (unit_id, embedding). Vectors of a wrong dimension and of unknown units are left out."""
    known = F.create_map(*[F.lit(x) for kv in models.items() for x in kv])
    good = vectors.where(F.size("embedding") == known[F.col("model")]).join(units.select("unit_id"), "unit_id", "left_semi").select("unit_id", "model", "embedding")
    missing = lacking(units, vectors, models)
    for model in models:
        todo = units.join(missing.where(F.col("model") == model).select("unit_id"), "unit_id", "left_semi")
        good = good.unionByName(encoders[model](todo).select("unit_id", F.lit(model).alias("model"), "embedding"))
    return good
