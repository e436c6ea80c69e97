"""Transcripts as a Spark data source: ``spark.read.format("transcripts")``, ``readStream``, and ``write`` as JSON lines.

    events(spark, path, only=["a", "b"], kind="jsonl_zstd", per_session=True)

The driver lists names and sizes only; files are packed into partitions of about ``partition_bytes`` and opened by tasks,
which send Arrow batches. With the option ``pushdown`` two filters are pushed down:

* ``conversation_id`` (equal, null-safe equal, IN). With the option ``per_session`` a file is named after its session, so
  files of other sessions are never opened; in a database the ids become part of the query. Spark checks the rows again.
* ``role`` (equal, IN) drops events before they are sent.

Spark 4.1 keeps what was pushed down with the relation and uses it again for a later scan of the same DataFrame without
filters, which would lose rows. So pushdown is off unless asked for, and ``events`` loads a relation of its own each time.

A stream's offset is the place of the last file in the order of (modification time, path); only later files are read, so
writers move finished files into the folder. ``settle`` seconds must have passed since a file's change. Writing gives one
compressed file a task; files appear under their names when the job is committed, and those of a failed job are deleted.

Options: ``path``; ``kind`` jsonl (default), jsonl_zstd or sqlite; ``source`` (the name in the column); ``glob``;
``per_session`` false; ``pushdown`` false; ``partition_bytes``; ``settle`` 0; ``mode`` of a write is Spark's append or overwrite.
"""

from __future__ import annotations

import fnmatch
import io
import json
import os
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import text as T
from . import transcripts as X

GLOBS = {"jsonl": "*.jsonl", "jsonl_zstd": "*.zst*", "sqlite": "*.db"}
KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
SCHEMA = pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in X.EVENT.split(", "))])
#: Events in a batch that a task sends.
BATCH = 4096


@dataclass(frozen=True)
class Listed:
    """A file as the listing knows it."""

    path: str
    size: int
    changed: int

    @property
    def session(self) -> str:
        return os.path.basename(self.path).split(".")[0]


@dataclass
class Files(InputPartition):
    files: tuple[Listed, ...]

    def __init__(self, files: tuple[Listed, ...]):
        self.files = files


def filesystem(path: str):
    """(file system, path in it) of a URI or local path."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" and rest.startswith("/"):
        path = "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, glob: str) -> list[Listed]:
    """Files below a folder, or the file itself; hidden ones are left out. In the order of change, then name."""
    from pyarrow import fs

    system, base = filesystem(path)
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else []
    own = [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob) and not any(p.startswith((".", "_")) for p in f.path.removeprefix(base).split("/"))]
    return sorted((Listed(f.path, f.size, f.mtime_ns or 0) for f in own), key=lambda f: (f.changed, f.path))


def packed(files: list[Listed], most: int) -> list[Files]:
    """Partitions of about ``most`` bytes; a larger file is a partition of its own."""
    out: list[list[Listed]] = []
    room = 0
    for f in sorted(files, key=lambda f: (-f.size, f.path)):
        if f.size > room or not out:
            out.append([])
            room = most
        out[-1].append(f)
        room -= f.size
    return [Files(tuple(x)) for x in out]


class Opener:
    """What a task needs to read files: it travels with the reader."""

    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options.get("path", ""), options.get("kind", "jsonl")
        if not self.path:
            raise ValueError("give a path to load")
        if self.kind not in GLOBS:
            raise ValueError(f"unknown kind of transcript: {self.kind}; known: {', '.join(GLOBS)}")
        self.glob = options.get("glob", GLOBS[self.kind])
        self.source = options.get("source", self.kind)
        self.per_session = options.get("per_session", "false").lower() == "true"
        self.pushdown = options.get("pushdown", "false").lower() == "true"
        self.most = int(options.get("partition_bytes", 32 << 20))
        self.settle = float(options.get("settle", 0))
        self.only: frozenset[str] | None = None
        self.roles: frozenset[str] | None = None

    def push(self, filters: list[Filter]) -> list[Filter]:
        """Take what can be used; all are given back, as ids inside a file may be others than its name's."""
        for f in filters if self.pushdown else ():
            values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, EqualTo | EqualNullSafe) else None
            if values is None or f.attribute not in (("conversation_id",), ("role",)):
                continue
            values = frozenset(v for v in values if v is not None)
            name = "only" if f.attribute == ("conversation_id",) else "roles"
            had = getattr(self, name)
            setattr(self, name, values if had is None else had & values)
        return filters

    def wanted(self, files: list[Listed]) -> list[Listed]:
        if self.only is None or not self.per_session or self.kind == "sqlite":
            return files
        return [f for f in files if f.session in self.only]

    def records(self, path: str) -> Iterator[dict]:
        """Records of a file, line by line as the stream is read; databases are asked for the wanted sessions."""
        system, _ = filesystem(self.path)
        if self.kind == "sqlite":
            with system.open_input_stream(path, compression=None) as f, tempfile.NamedTemporaryFile(suffix=".db") as copy:  # SQLite reads local files only
                while block := f.read(1 << 20):
                    copy.write(block)
                copy.flush()
                yield from sqlite_records(copy.name, self.only)
            return
        with system.open_input_stream(path, compression=None) as f:
            raw = f
            if self.kind == "jsonl_zstd":
                import zstandard

                raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True, closefd=False)
            for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n"):
                if (record := X.json_record(line)) is not None:
                    yield record

    def batches(self, part: Files) -> Iterator[pa.RecordBatch]:
        names = SCHEMA.names
        rows: list[dict] = []
        for f in part.files:
            seq = 0
            for r in self.records(f.path):
                # in a file of one session the name decides; else a record may say whose it is
                own = f.session if self.per_session else str(r.get("sessionId") or r.get("session_id") or f.session)
                for e in X.block_events(r):
                    if (self.only is None or own in self.only) and (self.roles is None or X.role_of(e["role"]) in self.roles):
                        rows.append({"source": self.source, "conversation_id": own, "seq": seq} | e | {"role": X.role_of(e["role"])})
                    seq += 1
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in rows], t) for n, t in zip(names, SCHEMA.types, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in rows], t) for n, t in zip(names, SCHEMA.types, strict=True)], names=names)


def sqlite_records(path: str, only: frozenset[str] | None) -> Iterator[dict]:
    """Messages of a database with tables session, message (JSON) and part (JSON), in order, row by row."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        some = "" if only is None else " WHERE m.session_id IN (SELECT value FROM json_each(?))"
        rows = db.execute(f"SELECT m.session_id, m.id, m.data, p.data FROM message m JOIN part p ON p.message_id = m.id{some} ORDER BY m.session_id, m.id, p.id", [] if only is None else [json.dumps(sorted(only))])
        for session, mid, m, p in rows:
            message, part = json.loads(m), json.loads(p)
            when = (message.get("time") or {}).get("created") if isinstance(message.get("time"), dict) else message.get("time")
            yield {"session_id": session, "id": mid, "time": when, "message": {"role": message.get("role"), "content": [part]}}
    finally:
        db.close()


class TranscriptReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.opener = Opener(options)

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        return self.opener.push(filters)

    def partitions(self) -> list[Files]:
        return packed(self.opener.wanted(listed(self.opener.path, self.opener.glob)), self.opener.most) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.opener.batches(partition)


class TranscriptStream(DataSourceStreamReader):
    """New files only; an offset is the place of the last one that was read."""

    def __init__(self, options: dict[str, str]):
        self.opener = Opener(options)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def _settled(self) -> list[Listed]:
        import time

        until = time.time_ns() - int(self.opener.settle * 1e9)
        return [f for f in listed(self.opener.path, self.opener.glob) if f.changed <= until]

    def latestOffset(self) -> dict:
        files = self._settled()
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return packed([f for f in listed(self.opener.path, self.opener.glob) if low < (f.changed, f.path) <= high], self.opener.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.opener.batches(partition)


@dataclass
class Wrote(WriterCommitMessage):
    temporary: str
    final: str
    rows: int


class TranscriptWriter(DataSourceArrowWriter):
    """Events as compressed JSON lines that the reader reads back."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        import zstandard
        from pyspark import TaskContext

        system, base = filesystem(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.jsonl.zst"
        place, n = f"{base}/_writing-{self.job}", 0
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{name}", compression=None) as f, zstandard.ZstdCompressor().stream_writer(f, closefd=False) as out:
            for batch in iterator:
                for r in batch.to_pylist():
                    kind = "thinking" if r.get("reasoning") is not None else "tool_use" if r.get("tool_name") is not None else "tool_result" if r.get("tool_output") is not None else "text"
                    block = {"type": kind, "thinking": r.get("reasoning"), "name": r.get("tool_name"), "input": json.loads(r["tool_input"]) if r.get("tool_input") else None, "content": r.get("tool_output"), "text": r.get("content")}
                    line = {"sessionId": r.get("conversation_id"), "uuid": r.get("src_id"), "parentUuid": r.get("parent_id"), "timestamp": r.get("time"), "type": r.get("role"), "message": {"role": r.get("role"), "content": [{k: v for k, v in block.items() if v is not None}]}}
                    out.write(json.dumps(line, ensure_ascii=False).encode() + b"\n")
                    n += 1
        return Wrote(f"{place}/{name}", f"{base}/{name}", n)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, base = filesystem(self.path)
        old = [f.path for f in listed(self.path, "*")] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)
        for path in old:
            system.delete_file(path)
        self._forget(system, base)

    def abort(self, messages: list[Wrote | None]) -> None:
        self._forget(*filesystem(self.path))

    def _forget(self, system, base: str) -> None:
        from pyarrow import fs

        place = f"{base}/_writing-{self.job}"
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class TranscriptSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return X.EVENT

    def reader(self, schema: StructType) -> TranscriptReader:
        return TranscriptReader(dict(self.options))

    def streamReader(self, schema: StructType) -> TranscriptStream:
        return TranscriptStream(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TranscriptWriter:
        return TranscriptWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; filters are pushed down where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TranscriptSource)


def events(spark: SparkSession, path: str, only: list[str] | None = None, **options: object) -> DataFrame:
    """Events of transcripts (of the sessions ``only``, where given) with their system notes marked."""
    register(spark)
    df = spark.read.format("transcripts").options(pushdown="true", **options).load(path)
    if only is not None:
        df = df.where(F.col("conversation_id").isin(*only))
    return df.withColumn("is_system", (F.col("role") == "user") & T.is_system_note(F.col("content")))
