"""Readers, converters, sinks and incremental reading, on small files made here."""

import io
import json
import sqlite3
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from loomspark.sources import documents, exports, state, transcripts
from loomspark.streaming import ingest, notices

LINES = [
    {"type": "summary", "summary": "no event"},
    {"type": "user", "uuid": "u1", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "A question"}},
    {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "timestamp": 1704067260000, "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "An answer"}, {"type": "tool_use", "name": "ls", "input": {"p": 1}}]}},
    {"type": "user", "uuid": "t1", "parentUuid": "a1", "message": {"role": "tool", "content": [{"type": "tool_result", "content": "a file"}]}},
]


def jsonl(lines=LINES):
    return ("\n".join(map(json.dumps, lines)) + "\nnot json\n").encode()


def test_json_lines_plain_and_compressed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s1.jsonl").write_bytes(jsonl())
    (tmp_path / "a" / "s2.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(jsonl()))
    for kind, session in (("jsonl", "s1"), ("jsonl_zstd", "s2")):
        rows = transcripts.load(spark, kind, str(tmp_path), "x").orderBy("seq").collect()
        assert [(r.conversation_id, r.role) for r in rows] == [(session, r) for r in ("user", "reasoning", "assistant", "tool", "tool")]
        assert [r.content for r in rows] == ["A question", None, "An answer", None, None]
        assert rows[1].reasoning == "hm" and rows[3].tool_name == "ls" and rows[4].tool_output == "a file"
        assert rows[0].time == 1704067200.0 and rows[2].time == 1704067260.0
    assert transcripts.load(spark, "jsonl", str(tmp_path), "x", ["other"]).count() == 0
    with pytest.raises(ValueError, match="unknown kind"):
        transcripts.load(spark, "odd", str(tmp_path), "x")
    listed = {r.conversation_id: r.length for r in transcripts.listing(spark, str(tmp_path), "*.jsonl").collect()}
    assert listed == {"s1": len(jsonl())}
    assert transcripts.freshness(spark, str(tmp_path)).first()[0] > 0


def test_turns_follow_the_chain_of_parents(spark, tmp_path):
    chain = [{"type": "user", "uuid": "u", "message": {"role": "user", "content": "start"}}] + [{"type": "assistant", "uuid": f"a{i}", "parentUuid": f"a{i - 1}" if i else "u", "message": {"role": "assistant", "content": f"step {i}"}} for i in range(40)] + [{"type": "assistant", "uuid": "lost", "parentUuid": "gone", "message": {"role": "assistant", "content": "x"}}]
    (tmp_path / "s.jsonl").write_bytes(jsonl(chain))
    out = {r.src_id: r.turn_key for r in transcripts.root_turns(transcripts.read_jsonl(spark, str(tmp_path), "x")).collect()}
    assert {out[f"a{i}"] for i in range(40)} == {"u"} and out["lost"] == "gone"
    s = transcripts.sessions(transcripts.read_jsonl(spark, str(tmp_path), "x")).first()
    assert s.event_count == 42 and s.title == "start" and s.roles == ["assistant", "user"]


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.executescript("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT); CREATE TABLE part (id INTEGER, message_id TEXT, data TEXT);")
    db.execute("INSERT INTO message VALUES ('m1', 's', ?)", [json.dumps({"role": "user", "time": {"created": 1704067200000}})])
    db.execute("INSERT INTO message VALUES ('m2', 's', ?)", [json.dumps({"role": "assistant"})])
    db.executemany("INSERT INTO part VALUES (?, ?, ?)", [(1, "m1", json.dumps({"type": "text", "text": "hello"})), (2, "m2", json.dumps({"type": "reasoning", "text": "hm"})), (3, "m2", json.dumps({"type": "text", "text": "hi"}))])
    db.commit()
    db.close()
    rows = transcripts.load(spark, "sqlite", str(tmp_path), "x").orderBy("seq").collect()
    assert [(r.role, r.content, r.reasoning) for r in rows] == [("user", "hello", None), ("reasoning", None, "hm"), ("assistant", "hi", None)]
    assert rows[0].time == 1704067200.0 and rows[0].conversation_id == "s"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_documents_of_every_kind(spark, tmp_path):
    w = 'xmlns:w="http://w"'
    docx = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b|c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>First slide</a:t></a:r></a:p><a:p><a:r><a:t>point</a:t></a:r></a:p></p:sld>'
    mind = [{"rootTopic": {"title": "Root", "children": {"attached": [{"title": "One", "labels": ["x"]}, {"title": "Two", "children": {"attached": [{"title": "Deep"}]}}]}}}]
    files = {
        "a.md": b"---\ntitle: Front\n---\n# Head\n\nbody", "b.txt": "中文".encode("gb18030"), "c.csv": b'x;"a;b"\n1;2\n', "d.html": b"<title>T</title><body><nav>menu</nav><article><h1>Head</h1><p>Text &amp; more</p></article></body>",
        "e.docx": zipped({"word/document.xml": docx}), "f.xlsx": zipped({"xl/workbook.xml": '<workbook><sheets><sheet name="Data"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>word</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}),
        "g.pptx": zipped({"ppt/slides/slide1.xml": slide}), "h.xmind": zipped({"content.json": json.dumps(mind)}), "i.docx": b"broken", "j.md": b"  ",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert (got["a.md"].title, got["a.md"].text) == ("Front", "# Head\n\nbody")
    assert got["b.txt"].text == "中文" and got["b.txt"].quality == 1.0
    assert got["c.csv"].text == "| x | a;b |\n| --- | --- |\n| 1 | 2 |"
    assert (got["d.html"].title, got["d.html"].text) == ("T", "Head\n\nText & more")
    assert got["e.docx"].title == "Title" and got["e.docx"].text == "# Title\n\nSome text\n\n| a | b\\|c |\n| --- | --- |"
    assert got["f.xlsx"].text == "## Data\n\n| word |  | 3 |\n| --- | --- | --- |"
    assert got["g.pptx"].text == "## 1. First slide\n\npoint"
    assert got["h.xmind"].text == "- Root\n  - One [x]\n  - Two\n    - Deep"
    assert got["i.docx"].error.startswith("BadZipFile") and got["j.md"].error == "empty"
    pages = documents.read_pages(spark, [str(tmp_path)]).collect()
    assert [(r.rel_path, r.title) for r in pages] == [("a.md", "Front")]


def test_exports_and_audit(spark, tmp_path):
    e = spark.createDataFrame([("x", "c1", 2, "assistant", "b", None), ("x", "c1", 1, "user", "a", None), ("x", "c2", 1, "tool", None, "out")], "source string, conversation_id string, seq int, role string, content string, tool_output string")
    exports.export_jsonl(e, str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j")).orderBy("conversation_id", "seq").collect()
    assert [(r.conversation_id, r.seq) for r in back] == [("c1", 1), ("c1", 2), ("c2", 1)]
    text = (next((tmp_path / "j" / "source=x" / "conversation_id=c2").glob("part-*"))).read_text()
    assert json.loads(text) == {"seq": 1, "role": "tool", "tool_output": "out"}
    titles = spark.createDataFrame([("x", "c1", "T")], "source string, conversation_id string, title string")
    md = {r.conversation_id: r.value for r in exports.conversation_markdown(e, titles).collect()}
    assert md["c1"] == "# T\n\n**user**\n\na\n\n**assistant**\n\nb\n" and md["c2"] == "# c2\n\n**tool**\n\nout\n"
    (tmp_path / "log.jsonl").write_text('{"ts": 1, "m": "a"}\nbroken\n{"ts": 3, "m": "c"}\n{"ts": 2, "m": "b"}\n')
    assert [r.m for r in exports.read_audit(spark, str(tmp_path / "log.jsonl"), "ts long, m string", 2).collect()] == ["c", "b"]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    for i, name in enumerate(("1", "2", "3")):
        state.save_version(spark.range(i + 1), root, name)
    assert state.read_version(spark, root).count() == 3 and state.read_version(spark, root, "1").count() == 1
    assert state.prune_versions(spark, root, 2) == ["1"] and state.versions(spark, root) == ["3", "2"]
    with pytest.raises(FileNotFoundError):
        state.read_version(spark, str(tmp_path / "none"))


def test_incremental_ingest_takes_each_key_once(spark, tmp_path):
    schema = "source string, conversation_id string, seq long, role string, content string, is_system boolean, time double"
    inbox, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    row = lambda n, text, role="user": json.dumps({"source": "x", "conversation_id": "c", "seq": n, "role": role, "content": text, "is_system": False, "time": 1.0})
    (tmp_path / "in" / "1.json").write_text("\n".join([row(1, "one"), row(2, "two"), row(3, "  "), row(4, "t", "tool")]))
    embed = lambda units: units.select("unit_id", ingest.hashed_vector(F.col("text"), 8).alias("embedding"))
    ingest.start(spark, inbox, out, check, schema, embed).awaitTermination(120)
    (tmp_path / "in" / "2.json").write_text("\n".join([row(2, "two again"), row(5, "five")]))
    ingest.start(spark, inbox, out, check, schema, embed).awaitTermination(120)
    units = spark.read.parquet(f"{out}/units").collect()
    assert sorted((r.seq, r.text) for r in units) == [(1, "one"), (2, "two"), (5, "five")]
    vectors = spark.read.parquet(f"{out}/vectors").collect()
    assert {r.unit_id for r in vectors} == {r.unit_id for r in units} and all(len(r.embedding) == 8 for r in vectors)


def test_repeated_notices(spark):
    import random

    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice("xy"), float(r.randrange(0, 4000)), i) for i in range(400)] + [("hot", "h", float(i * 7), 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "category string, title string, ts double, id long")
    want = set()
    for key in {x[:2] for x in rows}:
        own = sorted((x for x in rows if x[:2] == key), key=lambda x: x[2:])
        keep, _ = notices.passing([x[2] for x in own], 300.0)
        want |= {x[3] for x, ok in zip(own, keep, strict=True) if ok}
    assert {x.id for x in notices.dedup_batch(df, 300.0).collect()} == want
