"""Conversion of documents as a table function: ``SELECT f.path, d.* FROM files f, LATERAL convert_document(f.path, f.content) d``.

Converters stand in the order of their claims, specialised before general ones; the first that claims a document converts
it. A claim looks at the name and at the first bytes, so a renamed file goes to the converter of what it holds, and text
without a known name is still text. A document that fails is a row with its error; the query goes on.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import documents as D

OUT = "doc_id string, kind string, title string, text string, quality double, warnings array<string>, error string"
#: Part of a zipped document by which its format is known. Fixed values.
PARTS = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/slides/", "xmind": ("content.json", "content.xml")}


def _holds(kind: str) -> Callable[[str, bytes], bool]:
    def claim(name: str, data: bytes) -> bool:
        if not data.startswith(b"PK"):
            return name.endswith(f".{kind}")
        try:
            members = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return name.endswith(f".{kind}")
        return any(m.startswith(PARTS[kind]) for m in members)

    return claim


def _named(*extensions: str) -> Callable[[str, bytes], bool]:
    return lambda name, data: name.endswith(tuple(f".{e}" for e in extensions))


def _html(name: str, data: bytes) -> bool:
    return name.endswith((".html", ".htm")) or bool(re.match(rb"(?:\xef\xbb\xbf)?\s*(?:<!--.*?-->\s*)*<(?:!doctype html|html)\b", data[:4096], re.I | re.S))


def _text(name: str, data: bytes) -> bool:
    """Anything without zero bytes at its begin that isn't a zipped file."""
    return not data.startswith(b"PK") and b"\0" not in data[:4096]


#: (kind, claim, converter), specialised ones first.
ORDER: list[tuple[str, Callable[[str, bytes], bool], Callable[[bytes, str], dict]]] = [
    ("docx", _holds("docx"), D.from_docx),
    ("xlsx", _holds("xlsx"), D.from_xlsx),
    ("pptx", _holds("pptx"), D.from_pptx),
    ("xmind", _holds("xmind"), D.from_xmind),
    ("html", _html, D.from_html),
    ("csv", _named("csv", "tsv"), D.from_csv),
    ("text", _text, D.from_text),
]


def converted(name: str, data: bytes) -> dict:
    """One document: what its converter makes of it, or the error."""
    row = {"doc_id": hashlib.sha256(data).hexdigest()[:16], "kind": None, "title": None, "text": None, "quality": None, "warnings": [], "error": None}
    stem = name.rpartition("/")[2].rpartition(".")[0] or name.rpartition("/")[2]
    try:
        found = next(((kind, convert) for kind, claim, convert in ORDER if claim(name.lower(), data)), None)
        if found is None:
            return row | {"error": "unsupported"}
        row["kind"] = found[0]
        row |= found[1](data, stem)
        if not (row["text"] or "").strip():
            row["error"] = "empty"
    except Exception as e:  # one bad document is one failed row
        row["error"] = f"{type(e).__name__}: {e}"[:300]
    return row


@udtf(returnType=OUT)
class Convert:
    def eval(self, name: str, data: bytes) -> Iterator[tuple]:
        if data is not None:
            row = converted(name or "", bytes(data))
            yield tuple(row[c.split()[0]] for c in OUT.split(", "))


def register(spark: SparkSession) -> None:
    """Make ``convert_document`` known to the session's SQL."""
    spark.udtf.register("convert_document", Convert)


def convert(files: DataFrame, name: str, content: str) -> DataFrame:
    """``files`` with the columns of their conversion: bytes from a file, a table or text given as it is."""
    opened = Convert(F.col(name).outer(), F.col(content).cast("binary").outer())
    return files.lateralJoin(opened)
