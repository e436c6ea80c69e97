"""Nested JSON as rows: every value below a document with its path, found level by level on variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.state import cut

#: What a level must be to be opened, as ``schema_of_variant`` writes it.
_OPEN = r"^(OBJECT|ARRAY)<"


def walk(docs: DataFrame, column: str, keys: list[str], deepest: int = 64) -> DataFrame:
    """(keys..., path, key, depth, value variant, kind) of every value in the JSON texts of a column, the root included.

    A level is one explode of the values above it, so a document of a million values is spread over tasks from the second
    level on. Texts that are no JSON give no rows. Raises where a document is nested deeper than ``deepest``.
    """
    root = F.try_parse_json(F.col(column))
    level = docs.select(*keys, F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("depth"), root.alias("value")).where("value IS NOT NULL")
    found = None
    for depth in range(1, deepest + 2):
        level = cut(level.withColumn("kind", F.schema_of_variant("value")), "level")
        found = level if found is None else found.unionByName(level)
        inner = level.where(F.col("kind").rlike(_OPEN))
        if inner.isEmpty():
            return found.withColumn("kind", F.regexp_extract("kind", "^[A-Z]+", 0))
        if depth > deepest:
            raise ValueError(f"documents are nested deeper than {deepest}")
        spark = docs.sparkSession
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("pos"), F.col("key").alias("inner_key"), F.col("value").alias("inner")))
        step = F.coalesce(F.concat(F.lit("."), F.col("inner_key")), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = opened.select(*keys, F.concat("path", step).alias("path"), F.col("inner_key").alias("key"), F.lit(depth).alias("depth"), F.col("inner").alias("value"))
    return found


def flat_ints(docs: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys..., path, value): all whole numbers at any depth, and strings of digits."""
    w = walk(docs, column, keys)
    text = F.try_variant_get("value", "$", "string")
    return w.where((F.col("kind") == "BIGINT") | ((F.col("kind") == "STRING") & text.rlike(r"^-?[0-9]{1,18}$"))).select(*keys, "path", F.try_variant_get("value", "$", "bigint").alias("value"))


def find_key(docs: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """(keys..., path, depth, value string): the values of a key wherever it stands."""
    return walk(docs, column, keys).where(F.col("key") == name).select(*keys, "path", "depth", F.to_json("value").alias("value"))
