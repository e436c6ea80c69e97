"""Incremental ingest: new files of events become units and vectors, each key once.

``availableNow`` runs to the end of what is there and stops; the checkpoint is the watermark. A batch that is replayed
after a failure writes what it wrote before: keys that exist are left out by an anti join, and each batch writes a
folder of its own number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events as E
from ..sources.state import exists

UNIT_KEY = ["source", "conversation_id", "seq"]


def as_units(events: DataFrame) -> DataFrame:
    """Units of eligible events; their id is a hash of the key."""
    e = E.eligible(events).withColumn("text", T.prep_text(F.col("content"))).where("text IS NOT NULL").dropDuplicates(UNIT_KEY)
    return e.select(F.xxhash64(*UNIT_KEY).alias("unit_id"), *UNIT_KEY, "role", "text", F.length("text").alias("chars"), "time")


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding: signed counts of hashed trigrams."""
    hashes = F.transform(T.trigrams(F.lower(text)), lambda g: F.xxhash64(g))
    signed = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(dim)) == i), F.lit(0.0), lambda x, h: x + F.when(h > 0, 1.0).otherwise(-1.0)))
    return F.transform(signed, lambda x: x.cast("float"))


def start(spark: SparkSession, inbox: str, out: str, checkpoint: str, schema: str, embed: Callable[[DataFrame], DataFrame] | None = None, max_files: int = 100):
    """Start the query; ``embed`` maps units to (unit_id, embedding)."""

    def write(batch: DataFrame, number: int) -> None:
        units = as_units(batch)
        path = f"{out}/units"
        if exists(batch.sparkSession, path):  # every batch writes a file, also one without rows
            seen = batch.sparkSession.read.parquet(path).where(F.col("batch") != number).select(*UNIT_KEY)
            units = units.join(seen, UNIT_KEY, "left_anti")
        units.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if embed is not None:
            embed(batch.sparkSession.read.parquet(f"{path}/batch={number}")).write.mode("overwrite").parquet(f"{out}/vectors/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(inbox)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
