"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ``[^\x20\x09-\x0D]+`` as Java writes it: what this subpackage calls a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``. Where that is unset in a local session (tests, a laptop) a
    local folder is made and set, once per session; a cluster without it is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomspark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{stem}{i or ''}" for i in range(len(taken) + 1)) if n.lower() not in taken)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors; later stages read columns they need only.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
