"""Suppression of repeated notices: a notice passes if none of its category and title was let through in the last window.

A suppressed notice doesn't extend the window, so the state is the time of the last one that passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "category string, title string, ts double, id bigint"


def passing(times: list[float], window: float, last: float | None = None) -> tuple[list[bool], float | None]:
    keep = []
    for t in times:
        ok = last is None or t - last >= window
        keep.append(ok)
        last = t if ok else last
    return keep, last


def dedup_batch(notices: DataFrame, window: float = 300.0, bundles: int = 256) -> DataFrame:
    """The notices (category, title, ts, id) that pass.

    A gap of ``window`` or more begins anew, whatever was before: runs between such gaps are independent, so one kind of
    notice is dealt to many tasks. Runs travel in ``bundles`` by a hash, many to a group. A run without any gap is
    read by one task, as each of its decisions depends on the one before.
    """
    kind = Window.partitionBy("category", "title").orderBy("ts", "id")
    begins = F.coalesce(F.col("ts") - F.lag("ts").over(kind) >= window, F.lit(True))
    runs = notices.select("category", "title", "ts", "id").withColumn("run", F.sum(begins.cast("int")).over(kind.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.greatest(F.lit(bundles), F.lit(int(notices.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    runs = runs.withColumn("bundle", F.pmod(F.xxhash64("category", "title", "run"), n).cast("int"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["category", "title", "run", "ts", "id"], kind="stable")
        first = (pdf[["category", "title", "run"]] != pdf[["category", "title", "run"]].shift()).any(axis=1).to_numpy()
        keep, last = [], None
        for begins, t in zip(first, pdf["ts"].tolist(), strict=True):
            ok = begins or t - last >= window
            last = t if ok else last
            keep.append(ok)
        return pdf[keep][["category", "title", "ts", "id"]]

    return runs.groupBy("bundle").applyInPandas(decide, OUT)


def dedup_stream(notices: DataFrame, window: float = 300.0) -> DataFrame:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts", "id"])
        keep, last = passing(pdf["ts"].tolist(), window, state.get[0] if state.exists else None)
        state.update((last,))
        yield pdf[keep]

    return notices.select("category", "title", "ts", "id").groupBy("category", "title").applyInPandasWithState(run, OUT, "last double", "append", GroupStateTimeout.NoTimeout)
