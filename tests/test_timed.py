"""Streams whose state ends with event time."""

import datetime as dt
import json

import pytest

from loomspark.streaming import timed

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


@pytest.fixture()
def stream(spark, tmp_path):
    """Run one batch after the other: each call adds a file and returns what has come out so far."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    timed.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    inbox = tmp_path / "in"
    inbox.mkdir()

    def step(build, schema, rows):
        n = len(list(inbox.iterdir()))
        (inbox / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(inbox))
        q = build(df).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    yield step
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def at(seconds):
    return (DAY + dt.timedelta(seconds=seconds)).isoformat()


def test_notices_pass_once_a_window_and_leave_no_state(spark, stream, tmp_path):
    note = lambda i, s, title="disk full": {"category": "c", "title": title, "at": at(s), "id": i}
    go = lambda rows: sorted(r["id"] for r in stream(lambda df: timed.dedup_notices(df, 300.0, "60 seconds"), timed.NOTICE, rows).collect())
    kept = lambda: spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "check")).count()
    assert go([note(2, 100), note(1, 0), note(3, 299), note(4, 300), note(9, 10, "other")]) == [1, 4, 9]
    assert kept() == 2
    assert go([note(5, 500), note(6, 601)]) == [1, 4, 6, 9]  # 4 passed at 300
    assert go([note(7, 5000, "third")]) == [1, 4, 6, 7, 9]
    assert go([note(8, 5001, "third")]) == [1, 4, 6, 7, 9]
    assert kept() == 1  # only the window that is open


def test_calls_wait_for_their_result_and_no_longer(spark, stream, tmp_path):
    say = lambda c, phase, s: {"call_id": c, "phase": phase, "at": at(s)}
    go = lambda rows: sorted((r["call_id"], r["pending"]) for r in stream(lambda df: timed.pair_calls(df, "10 minutes", "1 minute"), "call_id string, phase string, at timestamp", rows).collect())
    assert go([say("a", "call", 0), say("b", "call", 5), say("c", "call", 10)]) == []
    assert go([say("a", "result", 30), say("c", "result", 900)]) == [("a", False)]  # c is answered beyond the limit
    go([say("x", "call", 2000), say("x", "result", 2001)])
    out = go([say("y", "call", 2100), say("y", "result", 2101)])
    assert out == [("a", False), ("b", True), ("c", True), ("x", False), ("y", False)]
    left = spark.read.format("statestore").option("joinSide", "left").load(str(tmp_path / "check"))
    assert {r["value"]["call_id"] for r in left.select("value").collect()} <= {"x", "y"}
