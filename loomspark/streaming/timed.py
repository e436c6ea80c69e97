"""Event-time state that ends: suppression of repeated notices with timers, and calls that wait for their result.

Both need a state store that keeps timers and several columns (``use_rocksdb``). State is bounded by what happened in the
last window: a notice's state goes when its window is over, a call's when its limit and the lateness have passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NOTICE = "category string, title string, at timestamp, id bigint"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Suppression(StatefulProcessor):
    """Keeps when the last notice passed, until ``window`` seconds after it."""

    def __init__(self, window: float):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        span = int(self.window * 1000)
        last = self.last.get()[0] if self.last.exists() else None
        for pdf in _in_order(rows):
            keep = []
            for at in pdf["at"].astype("datetime64[ms]").astype("int64").tolist():
                # what comes late, but before the notice that passed, is judged by it as well
                ok = last is None or at - last >= span
                keep.append(ok)
                last = at if ok else last
            yield pdf[keep]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last,))
        self.handle.registerTimer(last + span)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a key in a batch by time and id; they may come in any order and in several frames."""
    pdf = pd.concat(list(frames))
    yield pdf.sort_values(["at", "id"], kind="stable")


def dedup_notices(notices: DataFrame, window: float = 300.0, late: str = "10 minutes") -> DataFrame:
    """The notices (category, title, at, id) of a stream that pass, none of whose kind passed within ``window`` seconds before.

    Notices that are later than ``late`` are dropped by the watermark. State ends with its window.
    """
    own = notices.select("category", "title", "at", "id").withWatermark("at", late)
    return own.groupBy("category", "title").transformWithStateInPandas(Suppression(window), NOTICE, "Append", "EventTime")


def pair_calls(log: DataFrame, limit: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(call_id, called_at, done_at, pending) of the calls of a stream (call_id, phase, at).

    A result counts if it comes within ``limit`` of its call; a call is put out as pending once none can come any more. Both
    sides carry the watermark, so neither is kept longer than ``limit`` and ``late`` together. A call id is one call.
    """
    calls = log.where("phase = 'call'").select("call_id", F.col("at").alias("called_at")).withWatermark("called_at", late)
    results = log.where("phase = 'result'").select(F.col("call_id").alias("result_of"), F.col("at").alias("done_at")).withWatermark("done_at", late)
    near = F.expr(f"result_of = call_id AND done_at >= called_at AND done_at <= called_at + INTERVAL {limit}")
    return calls.join(results, near, "left_outer").select("call_id", "called_at", "done_at", F.col("done_at").isNull().alias("pending"))
