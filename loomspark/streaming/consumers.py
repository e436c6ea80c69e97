"""Several consumers of one delta: each stage has an offset of its own, which moves when the stage has succeeded.

The delta is a folder of files. Every stage is a streaming query over it with its own checkpoint, so a stage that fails is
served the same batch under the same number again, stages that succeeded aren't, and a stage that is added later starts at
the beginning. A stage writes what belongs to a batch under the batch's number, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

Stage = Callable[[DataFrame, int], None]


def start(spark: SparkSession, delta: str, schema: str, checkpoints: str, stages: dict[str, Stage], max_files: int = 1000) -> dict[str, StreamingQuery]:
    """Start every stage on what it has not consumed; each ends when it has, or when it fails."""

    def one(name: str, work: Stage) -> StreamingQuery:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(delta)
        return stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{checkpoints.rstrip('/')}/{name}").queryName(f"stage_{name}").trigger(availableNow=True).start()

    return {name: one(name, work) for name, work in stages.items()}


def run(spark: SparkSession, delta: str, schema: str, checkpoints: str, stages: dict[str, Stage], max_files: int = 1000) -> dict[str, str | None]:
    """Run every stage to the end of the delta: the error of each that failed, None for the others."""
    out: dict[str, str | None] = {}
    for name, q in start(spark, delta, schema, checkpoints, stages, max_files).items():
        try:
            q.awaitTermination()
            out[name] = None
        except Exception as e:  # one stage's failure is its own
            out[name] = str(e)[:2000]
    return out
