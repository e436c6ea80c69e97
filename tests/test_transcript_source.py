"""The transcripts data source: reading, pushdown, writing and streaming."""

import json
import os
import sqlite3

import pytest
import zstandard
from pyspark.sql import functions as F

from loomspark.sources import transcript_source as S
from loomspark.sources import transcripts as X

LINES = [
    {"type": "summary", "summary": "no event"},
    {"type": "user", "uuid": "u1", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "A question"}},
    {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "timestamp": 1704067260000, "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "An answer"}, {"type": "tool_use", "name": "ls", "input": {"p": 1}}]}},
    {"type": "user", "uuid": "t1", "parentUuid": "a1", "message": {"role": "tool", "content": [{"type": "tool_result", "content": "a file"}]}},
]


def jsonl():
    return ("\n".join(map(json.dumps, LINES)) + "\nnot json\n").encode()


@pytest.fixture()
def reader(spark):
    S.register(spark)
    return lambda path, **o: spark.read.format("transcripts").options(**o).load(str(path))


def test_a_relation_may_be_read_with_and_without_filters(reader, tmp_path):
    fill(tmp_path / "d", 3)
    df = reader(tmp_path / "d", per_session="true")
    assert [df.where("conversation_id = 's1'").count(), df.count(), df.where("conversation_id = 's2'").count()] == [5, 15, 5]


def fill(folder, n=6, kind="jsonl"):
    folder.mkdir(exist_ok=True)
    for i in range(n):
        data = jsonl()
        (folder / f"s{i}.{'jsonl' if kind == 'jsonl' else 'jsonl.zst'}").write_bytes(data if kind == "jsonl" else zstandard.ZstdCompressor().compress(data))


def test_it_reads_what_the_reader_functions_read(spark, reader, tmp_path):
    for kind in ("jsonl", "jsonl_zstd"):
        fill(tmp_path / kind, kind=kind)
        got = reader(tmp_path / kind, kind=kind, source="x")
        want = X.load(spark, kind, str(tmp_path / kind), "x").select(*got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 30
    odd = tmp_path / "odd.jsonl"
    odd.write_text(json.dumps({"role": "user", "content": "one line"}, ensure_ascii=False) + "\n\n[1]\nnot json\n" + json.dumps({"role": "user", "content": "last"}))
    assert [r.content for r in reader(odd).orderBy("seq").collect()] == ["one line", "last"]
    assert reader(tmp_path / "nothing here").count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        reader(tmp_path, kind="odd").count()


def test_files_of_other_sessions_are_not_opened(reader, tmp_path):
    fill(tmp_path / "d", 5)
    for i in (0, 1, 4):  # opening one of these fails
        os.remove(tmp_path / "d" / f"s{i}.jsonl")
        os.symlink(tmp_path / "missing", tmp_path / "d" / f"s{i}.jsonl")
    (tmp_path / "d" / "s9.jsonl").write_bytes(b"")
    os.chmod(tmp_path / "d" / "s9.jsonl", 0o600)
    df = reader(tmp_path / "d", per_session="true", pushdown="true").where(F.col("conversation_id").isin("s2", "s3"))
    assert df.groupBy("conversation_id").count().collect() and {r[0] for r in df.select("conversation_id").distinct().collect()} == {"s2", "s3"}
    o = S.Opener({"path": str(tmp_path / "d"), "per_session": "true", "pushdown": "true"})
    left = o.push([S.In(("conversation_id",), ("s2", "s3")), S.EqualTo(("conversation_id",), "s3"), S.EqualTo(("seq",), 1)])
    assert len(left) == 3 and o.only == {"s3"} and [f.session for f in o.wanted(S.listed(o.path, o.glob))] == ["s3"]


def test_only_the_wanted_files_are_read(reader, tmp_path):
    """A file that isn't asked for may be unreadable."""
    fill(tmp_path / "z", 3, "jsonl_zstd")
    (tmp_path / "z" / "bad.jsonl.zst").write_bytes(b"no zstd frame")
    load = lambda: reader(tmp_path / "z", kind="jsonl_zstd", per_session="true", pushdown="true")
    assert load().where("conversation_id = 's1'").count() == 5
    with pytest.raises(Exception, match="(?i)zstd|frame"):
        load().count()


def test_roles_are_pushed_down(reader, tmp_path):
    fill(tmp_path / "r", 2)
    df = reader(tmp_path / "r", pushdown="true")
    assert df.where("role = 'tool'").count() == 4 and df.where("role = 'tool'").select("seq").distinct().count() == 2
    assert df.where("role IN ('user', 'reasoning') AND conversation_id = 's1'").count() == 2


def test_sessions_of_a_database(reader, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.executescript("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT); CREATE TABLE part (id INTEGER, message_id TEXT, data TEXT);")
    for s in ("a", "b", "c"):
        for m in range(3):
            db.execute("INSERT INTO message VALUES (?, ?, ?)", [f"{s}{m}", s, json.dumps({"role": "user"})])
            db.execute("INSERT INTO part VALUES (1, ?, ?)", [f"{s}{m}", json.dumps({"type": "text", "text": f"{s} {m}"})])
    db.execute("INSERT INTO message VALUES ('bad', 'd', 'no json')")
    db.execute("INSERT INTO part VALUES (1, 'bad', 'no json')")
    db.commit()
    db.close()
    got = reader(tmp_path, kind="sqlite", pushdown="true").where("conversation_id IN ('a', 'c')")  # session d can't be parsed
    assert sorted(r.content for r in got.collect()) == [f"{s} {m}" for s in "ac" for m in range(3)]


def test_small_files_share_a_partition(tmp_path):
    files = [S.Listed(f"f{i}", size, 0) for i, size in enumerate([10, 70, 20, 200, 30, 30])]
    parts = S.packed(files, 100)
    assert sorted(f.path for p in parts for f in p.files) == [f.path for f in files]
    assert max(sum(f.size for f in p.files) for p in parts if len(p.files) > 1) <= 100 and len(parts) == 3


def test_what_is_written_reads_back(spark, reader, tmp_path):
    fill(tmp_path / "in", 4)
    events = reader(tmp_path / "in", source="x")
    out = str(tmp_path / "out")
    events.repartition(3).write.format("transcripts").mode("append").save(out)
    assert len(os.listdir(out)) == 3 and all(n.endswith(".jsonl.zst") for n in os.listdir(out))
    pick = ("conversation_id", "role", "content", "tool_name", "tool_input", "tool_output", "reasoning", "time", "src_id", "parent_id")
    again = reader(out, kind="jsonl_zstd")
    assert sorted(map(repr, again.select(*pick).collect())) == sorted(map(repr, events.select(*pick).collect()))
    events.where("conversation_id = 's1'").write.format("transcripts").mode("overwrite").save(out)
    assert reader(out, kind="jsonl_zstd").count() == 5

    def fail(batches):
        for b in batches:
            yield b
            raise ValueError("a task that fails")

    with pytest.raises(Exception, match="a task that fails"):
        events.mapInArrow(fail, events.schema).write.format("transcripts").mode("append").save(out)
    assert reader(out, kind="jsonl_zstd").count() == 5 and not any(n.startswith("_") for n in os.listdir(out))


def test_a_stream_reads_each_file_once(spark, tmp_path):
    S.register(spark)
    fill(tmp_path / "inbox", 2)

    def run():
        q = spark.readStream.format("transcripts").load(str(tmp_path / "inbox")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(90)
        return sorted((r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("conversation_id").count().collect())

    assert run() == [("s0", 5), ("s1", 5)]
    (tmp_path / "inbox" / "later.jsonl").write_bytes(jsonl())
    assert run() == [("later", 5), ("s0", 5), ("s1", 5)]
    assert run() == [("later", 5), ("s0", 5), ("s1", 5)]


def test_events_mark_system_notes(spark, tmp_path):
    fill(tmp_path / "e", 1)
    assert S.events(spark, str(tmp_path / "e"), kind="jsonl").where("is_system IS NULL OR NOT is_system").count() == 5
    fill(tmp_path / "f", 3)
    assert {r[0] for r in S.events(spark, str(tmp_path / "f"), only=["s2"], per_session=True).select("conversation_id").collect()} == {"s2"}
