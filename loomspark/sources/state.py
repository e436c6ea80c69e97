"""State tables: the shared folder, versioned snapshots and key tables, as Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a local session makes and sets one of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomspark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read again: later work doesn't recompute it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_version(df: DataFrame, root: str, version: str) -> str:
    """Write a table as a new version; readers of older versions are not disturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Versions of a table, newest first. One name a version: a short listing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    return sorted((s.getPath().getName().removeprefix("version=") for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("version=")), reverse=True)


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"no version in {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/version={version or found[0]}")


def prune_versions(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete all but the newest ``keep`` versions; returns the names of those deleted."""
    gone = versions(spark, root)[keep:]
    for v in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/version={v}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def newest(df: DataFrame, keep: int, order: str, group: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(group or [])).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def read_evolved(spark: SparkSession, root: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """All versions of a table as one, with the columns of all of them.

    A column that a version didn't have is null there, or takes its default: an expression over the other columns, so a
    backfill may be computed. A null that a version wrote itself stays null. Types may widen between versions (int to
    bigint, float to double); ``version`` says where a row is from.
    """
    found = sorted(versions(spark, root))
    if not found:
        raise FileNotFoundError(f"no version in {root}")
    out = None
    for v in found:  # a plan for each version, and no data read for it
        df = spark.read.parquet(f"{root.rstrip('/')}/version={v}")
        for name, value in (defaults or {}).items():
            if name not in df.columns:
                df = df.withColumn(name, value)
        df = df.withColumn("version", F.lit(v))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
