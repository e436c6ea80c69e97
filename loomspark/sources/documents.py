"""External documents: Markdown, text, CSV, HTML and zipped office formats to one document table.

Each file is one row of ``binaryFile``; a converter turns its bytes into title, text, quality and warnings, and a
failure is a row with its error, not the end of the job.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, COLUMNS, CELL, SHEETS = 1_000, 60, 300, 50
DOCUMENT = "path string, doc_id string, kind string, title string, text string, quality double, warnings array<string>, error string"


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding) by the first that fits."""
    for name in ("utf-8-sig", "utf-8", "gb18030"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "replace"


def split_front(text: str) -> tuple[dict[str, str], str]:
    m = re.match(r"---\r?\n(.*?)\r?\n---[ \t]*\r?\n?", text, re.S)
    if not m:
        return {}, text
    pairs = (line.partition(":") for line in m[1].splitlines() if ":" in line)
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}, text[m.end() :]


def title_of(text: str) -> str:
    bare = re.sub(r"(?ms)^(```|~~~).*?^\1[ \t]*$", "", text)
    m = re.search(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", bare)
    return m[1].strip() if m else ""


def cell(value: object) -> str:
    text = re.sub(r"\s+", " ", str(value if value is not None else "").replace("|", "\\|")).strip()
    return text[:CELL] + "…" if len(text) > CELL else text


def table(rows: list[list[object]]) -> str:
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(cell(r[i] if i < len(r) else "") for i in range(width)) + " |" for r in rows]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if rows else ""


def from_text(data: bytes, stem: str) -> dict:
    text, how = decode(data)
    front, body = split_front(text)
    return {"title": front.get("title") or title_of(body) or stem, "text": body.strip(), "quality": 0.5 if how == "replace" else 1.0, "warnings": ["undecodable"] if how == "replace" else []}


def sniff(text: str) -> str:
    """The delimiter that is most frequent outside quotes in the first lines."""
    bare = re.sub(r'"[^"]*"', "", "\n".join(text.splitlines()[:20]))
    return max(",\t;|", key=lambda d: (bare.count(d), -",\t;|".index(d)))


def from_csv(data: bytes, stem: str) -> dict:
    text, how = decode(data)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sniff(text)) if any(x.strip() for x in r)]
    cut = len(rows) > ROWS + 1 or any(len(r) > COLUMNS for r in rows)
    return {"title": stem, "text": table([r[:COLUMNS] for r in rows[: ROWS + 1]]), "quality": min(0.7 if cut else 1.0, 0.5 if how == "replace" else 1.0), "warnings": ["truncated"] * cut}


def visible(page: str) -> str:
    page = re.sub(r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>|<!--.*?-->", " ", page)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<[^>]+>", " ", page))).strip()


def embedded_tables(page: str) -> list[str]:
    """Tables from JSON that a page carries in scripts: the first list of objects of each of at most four blocks."""
    out = []
    for m in re.finditer(r"(?is)<script\b[^>]*>(.*?)</script\s*>", page):
        body = m[1].strip()
        start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
        if len(body) < 256 or start < 0:
            continue
        try:
            value, _ = json.JSONDecoder().raw_decode(body[start:])
        except ValueError:
            continue
        queue = [value]
        while queue:
            x = queue.pop(0)
            if isinstance(x, list) and x and all(isinstance(r, dict) for r in x):
                keys = list(dict.fromkeys(k for r in x for k in r))[:COLUMNS]
                out.append(table([keys, *[[r.get(k) for k in keys] for r in x[:ROWS]]]))
                break
            queue += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        if len(out) == 4:
            break
    return out


def from_html(data: bytes, stem: str) -> dict:
    page, _ = decode(data)
    m = re.search(r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", page) or re.search(r"(?is)<(body)\b[^>]*>(.*?)</body\s*>", page)
    body = m[2] if m else page
    blocks = [visible(b) for b in re.split(r"(?i)</?(?:p|div|h[1-6]|li|tr|br|section|table|ul|ol|blockquote)\b[^>]*>", re.sub(r"(?is)<(nav|footer|aside|form|header|script|style)\b.*?</\1\s*>", " ", body))]
    text = "\n\n".join(b for b in blocks if b)
    t = re.search(r"(?is)<title\b[^>]*>(.*?)</title\s*>", page)
    seen = len(visible(page))
    ratio = len(text) / max(1, seen)
    out = {"title": (visible(t[1]) if t else "") or stem, "text": text, "quality": 1.0 if ratio >= 0.5 else min(1.0, max(0.3, ratio / 0.5)), "warnings": []}
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) >= 5 and sum(bool(re.search("[:：]$", x)) and len(x) <= 40 for x in lines) / len(lines) >= 0.3 or (not text and len(data) >= 20_000):
        found = embedded_tables(page)
        out |= {"text": "\n\n".join([text, *found]), "quality": min(out["quality"], 0.9 if found else 0.4), "warnings": ["shell, rescued" if found else "shell"]}
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def from_docx(data: bytes, stem: str) -> dict:
    z = zipfile.ZipFile(io.BytesIO(data))
    body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body")
    said = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
    parts, merged = [], False
    for e in body:
        if _local(e.tag) == "p":
            style = next((v for x in e.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            level = re.search(r"(?i)heading\s*(\d)|^(\d)$", style)
            text = said(e).strip()
            listed = any(_local(x.tag) == "numPr" for x in e.iter())
            if text:
                parts.append("#" * int(level[1] or level[2]) + " " + text if level else "- " + text if listed else text)
        elif _local(e.tag) == "tbl":
            rows = [["" if any(_local(x.tag) == "vMerge" and "restart" not in x.attrib.values() for x in c.iter()) else said(c) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
            merged |= any(_local(x.tag) in ("vMerge", "gridSpan") for x in e.iter())
            parts.append(table(rows))
    text = "\n\n".join(parts)
    return {"title": title_of(text) or (parts[0].split("\n")[0][:60] if parts else stem), "text": text, "quality": 0.9 if merged else 1.0, "warnings": []}


def from_xlsx(data: bytes, stem: str) -> dict:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    names = [x.attrib.get("name", "") for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    parts, cut = [], len(files) > SHEETS
    for no, name in enumerate(files[:SHEETS]):
        rows = []
        for r in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "row"):
            row: list[str] = []
            for c in r:
                col = 0
                for ch in re.match(r"[A-Z]*", c.attrib.get("r", ""))[0]:
                    col = col * 26 + ord(ch) - 64
                v = next((x.text or "" for x in c if _local(x.tag) == "v"), "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t"))
                row += [""] * (col - 1 - len(row))
                row.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
            while row and not row[-1].strip():
                row.pop()
            rows.append(row)
        while rows and not rows[-1]:
            rows.pop()
        cut |= len(rows) > ROWS or any(len(r) > COLUMNS for r in rows)  # any sheet decides, not the last
        title = names[no] if no < len(names) else f"sheet {no + 1}"
        head = f"## {title}\n\n" if len(files) > 1 or not re.fullmatch(r"(?i)sheet\s*1|工作表1", title) else ""
        parts.append(head + table([r[:COLUMNS] for r in rows[:ROWS]]))
    return {"title": stem, "text": "\n\n".join(parts), "quality": 0.7 if cut else 1.0, "warnings": ["truncated"] * cut}


def from_pptx(data: bytes, stem: str) -> dict:
    z = zipfile.ZipFile(io.BytesIO(data))
    files = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))[:300]
    parts, spoken = [], 0
    for i, name in enumerate(files):
        root = ElementTree.fromstring(z.read(name))
        lines = [x for p in root.iter() if _local(p.tag) == "p" if (x := "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip())]
        spoken += bool(lines)
        parts.append("\n\n".join([f"## {i + 1}. {lines[0] if lines else ''}".rstrip(), *lines[1:]]))
    few = bool(files) and spoken / len(files) < 0.5
    return {"title": stem, "text": "\n\n".join(parts), "quality": 0.5 if few else 1.0, "warnings": ["mostly images"] * few}


def from_xmind(data: bytes, stem: str) -> dict:
    z = zipfile.ZipFile(io.BytesIO(data))
    lines: list[str] = []

    def walk(topic: dict, depth: int) -> None:
        if len(lines) >= 20_000:
            return
        extra = "".join(f" [{x}]" for x in topic.get("labels", []))
        lines.append("  " * min(depth, 20) + "- " + re.sub(r"\s+", " ", topic.get("title", "")) + extra)
        children = topic.get("children", {})
        for kind in ("attached", "detached", "summary"):
            for c in children.get(kind, []):
                walk(c, depth + 1)

    sheets = json.loads(z.read("content.json"))
    for s in sheets:
        walk(s["rootTopic"], 0)
    return {"title": sheets[0]["rootTopic"].get("title") or stem, "text": "\n".join(lines), "quality": 0.5 if len(lines) < 3 else 1.0, "warnings": []}


#: Specialised converters come before general ones; the first that claims an extension converts.
CONVERTERS: dict[str, tuple[str, Callable[[bytes, str], dict]]] = {
    "md": ("text", from_text), "markdown": ("text", from_text), "txt": ("text", from_text), "csv": ("csv", from_csv), "tsv": ("csv", from_csv), "html": ("html", from_html), "htm": ("html", from_html),
    "docx": ("docx", from_docx), "xlsx": ("xlsx", from_xlsx), "pptx": ("pptx", from_pptx), "xmind": ("xmind", from_xmind),
}


def convert_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for pdf in frames:
        out = []
        for path, data in zip(pdf["path"], pdf["content"], strict=True):
            stem, _, ext = path.rpartition("/")[2].rpartition(".")
            row = {"path": path, "doc_id": hashlib.sha256(data).hexdigest()[:16], "kind": None, "title": None, "text": None, "quality": None, "warnings": [], "error": None}
            try:
                kind, convert = CONVERTERS[ext.lower()]
                row |= {"kind": kind} | convert(bytes(data), stem)
                if not (row["text"] or "").strip():
                    row["error"] = "empty"
            except KeyError as e:
                row["error"] = f"unsupported: {e.args[0] if e.args else ext}"
            except Exception as e:  # one bad file is one failed row
                row["error"] = f"{type(e).__name__}: {e}"[:300]
            out.append(row)
        yield pd.DataFrame(out, dtype=object)


def read_documents(spark: SparkSession, path: str, exts: list[str] | None = None) -> DataFrame:
    """One row a file of the allowed extensions; equal bytes are converted once."""
    glob = "*.{" + ",".join(exts or sorted(CONVERTERS)) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(convert_files, DOCUMENT)


def read_pages(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Markdown pages of several folders: (root, rel_path, title, domain, origin, doc, body); index, hidden and empty files are left out."""
    from ..functions import text as T

    out = None
    for root in roots:
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
        rel = F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")
        front = T.split_front(F.col("value"))
        df = df.select(F.lit(root).alias("root"), F.decode(F.encode(F.url_decode(rel), "UTF-8"), "UTF-8").alias("rel_path"), front.alias("f"))
        df = df.where(~F.col("rel_path").rlike(r"(^|/)(\.|_?index\.md$)")).where(~T.is_blank(F.col("f.body")))
        stem = F.regexp_extract("rel_path", r"([^/]+)\.md$", 1)
        df = df.select("root", "rel_path", F.coalesce(T.front_value(F.col("f.front"), "title"), T.title_of(F.col("f.body")), stem).alias("title"), *[T.front_value(F.col("f.front"), k).alias(k) for k in ("domain", "origin", "doc")], F.col("f.body").alias("body"))
        out = df if out is None else out.unionByName(df)
    return out
