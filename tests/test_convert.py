"""Documents through the table function."""

import io
import json
import zipfile

from loomspark.sources import convert, documents


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = '<w:document xmlns:w="http://w"><w:body><w:p><w:r><w:t>Some text</w:t></w:r></w:p></w:body></w:document>'
SHEET = '<worksheet><sheetData><row><c r="A1"><v>3</v></c></row></sheetData></worksheet>'
SLIDE = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>First</a:t></a:r></a:p></p:sld>'
FILES = {
    "a.docx": zipped({"word/document.xml": W}), "b.xlsx": zipped({"xl/workbook.xml": '<workbook><sheets><sheet name="D"/></sheets></workbook>', "xl/worksheets/sheet1.xml": SHEET}),
    "c.pptx": zipped({"ppt/slides/slide1.xml": SLIDE}), "d.xmind": zipped({"content.json": json.dumps([{"rootTopic": {"title": "Root"}}])}),
    "e.html": b"<title>T</title><p>Text &amp; more of it</p>", "f.csv": b"a,b\n1,2\n", "g.md": b"# Head\n\nbody",
    "renamed.txt": zipped({"word/document.xml": W}), "no extension": b"<!DOCTYPE html><html><body><p>A page without a name</p></body></html>", "plain": b"just text",
    "broken.docx": b"no zip", "x.bin": b"\0\1\2", "odd.zip": zipped({"a.txt": "x"}), "empty.md": b" ",
}
KINDS = {"a.docx": "docx", "b.xlsx": "xlsx", "c.pptx": "pptx", "d.xmind": "xmind", "e.html": "html", "f.csv": "csv", "g.md": "text", "renamed.txt": "docx", "no extension": "html", "plain": "text", "broken.docx": "docx", "x.bin": None, "odd.zip": None, "empty.md": "text"}


def test_documents_are_converted_in_sql(spark):
    convert.register(spark)
    spark.createDataFrame([*FILES.items(), ("nothing", None)], "path string, content binary").createOrReplaceTempView("files")
    got = {r["path"]: r for r in spark.sql("SELECT f.path, d.* FROM files f, LATERAL convert_document(f.path, f.content) d").collect()}
    assert {p: r["kind"] for p, r in got.items()} == KINDS
    assert {p: r["error"] for p, r in got.items() if r["error"]} == {"broken.docx": got["broken.docx"]["error"], "x.bin": "unsupported", "odd.zip": "unsupported", "empty.md": "empty"}
    assert got["broken.docx"]["error"].startswith("BadZipFile") and got["renamed.txt"]["text"] == got["a.docx"]["text"] == "Some text"
    again = convert.convert(spark.table("files"), "path", "content")
    assert {r["path"]: r["text"] for r in again.collect()} == {p: r["text"] for p, r in got.items()}


def test_it_agrees_with_the_reader_of_folders(spark, tmp_path):
    for name in ("a.docx", "b.xlsx", "c.pptx", "d.xmind", "e.html", "f.csv", "g.md"):
        (tmp_path / name).write_bytes(FILES[name])
    read = {r["doc_id"]: (r["kind"], r["title"], r["text"], r["quality"]) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    made = {r["doc_id"]: (r["kind"], r["title"], r["text"], r["quality"]) for r in convert.convert(files, "path", "content").collect()}
    assert made == read and len(made) == 7
