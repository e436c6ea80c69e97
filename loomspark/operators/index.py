"""A text index that is kept: postings of trigrams in segments, with delete marks, statistics and merging.

A segment is three tables in a folder of its own, written once and never changed:

* ``postings`` (bucket, gram, block, places, tfs): for each gram and block of texts, which of the block's texts hold it and
  how often, as packed numbers; one row where a table of pairs would have hundreds. Rows are partitioned by ``bucket`` (a
  hash of the gram) and sorted by gram, so a search opens the folders of its grams' buckets, and in them few row groups.
* ``texts`` (block, unit_id, place, len, group): what a place stands for.
* ``deletes`` (unit_id): units that this segment takes from all earlier ones.

``update`` writes the changed texts as a small segment of their own; earlier segments are not touched. ``merge`` writes all
live postings into one segment. A version is a list of segments with their counts, so readers of an older version are not
disturbed, and the statistics that ranking needs (texts, characters) are read and never counted again.

A gram is the three code points of its characters as one number, found by running sums over a whole block of texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import state
from ..sources.state import cut

#: Characters of text in a block, those that are counted at once, and folders that grams are dealt to.
BLOCK, SCAN, BUCKETS = 4 << 20, 1 << 20, 64
#: Places that a task unpacks at once.
POSTINGS = 1 << 18
#: Bits of a code point.
POINT = 21
_SEGMENT = "segment string, n bigint, chars bigint"


def code_of(gram: Column) -> Column:
    """The number of a gram of three characters."""
    point = lambda i: F.ascii(F.substring(gram, i, 1)).cast("bigint")  # noqa: E731  the code point of the first character
    return F.shiftleft(point(1), 2 * POINT).bitwiseOR(F.shiftleft(point(2), POINT)).bitwiseOR(point(3))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``most`` bytes of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        block = np.cumsum(sizes) // most
        starts = [*np.flatnonzero(np.diff(block, prepend=-1)), len(block)] if len(block) else [0]
        for a, b in zip(starts, starts[1:], strict=False):
            yield batch.slice(a, b - a)


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all grams of all texts, the text of each, characters of each text); no gram crosses texts."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), sizes
    codes = points[:-2] << 2 * POINT | points[1:-1] << POINT | points[2:]
    of = np.repeat(np.arange(len(texts)), sizes)
    inside = of[:-2] == of[2:]
    return codes[inside], of[:-2][inside], sizes


def counted(codes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, text, how often), sorted by gram and text, for the grams of ``n`` texts."""
    import pandas as pd

    at, grams = pd.factorize(codes)
    order = np.argsort(grams, kind="stable")
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    keys, tf = np.unique(rank[at] * n + of, return_counts=True)
    return grams[order][keys // n], keys % n, tf


def counted_texts(texts: list[str | None], most: int = SCAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``counted`` for all grams of the texts, and the characters of each; about ``most`` characters are laid out at once."""
    sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1)).tolist()
    found = [(np.empty(0, np.int64),) * 3]
    for a, b in zip(starts, [*starts[1:], len(texts)], strict=True):
        codes, of, _ = grams_of(texts[a:b])
        if len(codes):
            gram, text, tf = counted(codes, of, b - a)
            found.append((gram, text + a, tf))
    gram, text, tf = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(gram, kind="stable")  # texts of a gram stay in their order
    return gram[order], text[order], tf[order], sizes


def packed(x: np.ndarray, dfs: np.ndarray) -> pa.Array:
    """Rows of ``dfs`` numbers below 2**32 each, byte plane by byte plane, lowest first, without planes of zeros at the end:
    they compress well. No row is empty."""
    starts = np.cumsum(dfs) - dfs
    most = np.maximum.reduceat(x, starts) if len(dfs) else np.empty(0, np.int64)
    used = 1 + sum((most >> 8 * i > 0).astype(np.int64) for i in (1, 2, 3))
    offsets = np.append(0, np.cumsum(dfs * used))
    out = np.empty(offsets[-1], np.uint8)
    to = np.repeat(offsets[:-1] - starts, dfs) + np.arange(len(x))
    for i in range(int(used.max(initial=0))):
        deep = np.repeat(used > i, dfs)
        out[(to + np.repeat(i * dfs, dfs))[deep]] = (x[deep] >> 8 * i & 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(dfs), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unpacked(rows: pa.Array, dfs: np.ndarray) -> np.ndarray:
    """The numbers of packed rows, one row after the other."""
    if not len(rows):
        return np.empty(0, np.int64)
    _, offsets, data = rows.buffers()
    offsets = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    used = np.diff(offsets) // dfs
    to = np.repeat(offsets[:-1] - (np.cumsum(dfs) - dfs), dfs) + np.arange(int(dfs.sum()))
    out = np.zeros(len(to), np.int64)
    for i in range(int(used.max(initial=0))):
        deep = np.repeat(used > i, dfs)
        out[deep] |= data[(to + np.repeat(i * dfs, dfs))[deep]].astype(np.int64) << 8 * i
    return out


def steps_of(x: np.ndarray, dfs: np.ndarray) -> np.ndarray:
    """Differences within rows; the first of a row is its own value."""
    steps, starts = np.diff(x, prepend=0), np.cumsum(dfs) - dfs
    steps[starts] = x[starts]
    return steps


def sums_of(steps: np.ndarray, dfs: np.ndarray) -> np.ndarray:
    """The values that ``steps_of`` was made from."""
    sums, starts = np.cumsum(steps), np.cumsum(dfs) - dfs
    return sums - np.repeat(sums[starts] - steps[starts], dfs)


def df_blocks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of packed postings that hold about ``most`` places when they are unpacked."""
    block = np.cumsum(batch.column("df").to_numpy()) // most
    starts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
        yield batch.slice(a, b - a)


def hits_by_scan(units: DataFrame, wanted: list[int], field: str = "text", block: int = SCAN) -> DataFrame:
    """(unit_id, code, tf, len) of the wanted grams by one pass over the texts; nothing else leaves a task."""
    asked = np.sort(np.array(sorted(set(wanted)), dtype=np.int64))
    kind = units.schema["unit_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches, "low", block):
            codes, of, sizes = grams_of(part.column("low").to_pylist())
            if not len(asked) or not len(codes):
                continue
            at = np.minimum(np.searchsorted(asked, codes), len(asked) - 1)
            keep = asked[at] == codes
            gram, text, tf = counted(codes[keep], of[keep], len(sizes))
            if len(gram):
                yield pa.RecordBatch.from_arrays([part.column("unit_id").take(pa.array(text)), pa.array(gram), pa.array(tf), pa.array(np.maximum(sizes[text] - 2, 0))], names=["unit_id", "code", "tf", "len"])

    low = units.select("unit_id", F.lower(F.coalesce(F.col(field), F.lit(""))).alias("low"))
    return low.mapInArrow(run, f"unit_id {kind}, code bigint, tf bigint, len bigint")


class TextIndex:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, unit_kind: str = "bigint"):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schemas = {
            "postings": "gram bigint, block bigint, df bigint, places binary, tfs binary, bucket int",
            "texts": f"block bigint, place int, unit_id {unit_kind}, len bigint, group string",
            "deletes": f"unit_id {unit_kind}",
        }

    # what a version holds -------------------------------------------------------------------------------------------

    def segments(self) -> list[tuple[str, int, int]]:
        """(name, texts, characters) of the live segments, oldest first; what a segment deletes counts against it."""
        if not state.versions(self.spark, f"{self.root}/versions"):
            return []
        rows = state.read_version(self.spark, f"{self.root}/versions").collect()  # a row for each segment
        return sorted((r["segment"], r["n"], r["chars"]) for r in rows)

    def _publish(self, segments: list[tuple[str, int, int]]) -> None:
        found = state.versions(self.spark, f"{self.root}/versions")
        number = int(found[0]) + 1 if found else 1
        state.save_version(self.spark.createDataFrame(segments, _SEGMENT).coalesce(1), f"{self.root}/versions", f"{number:08d}")

    def _read(self, name: str, table: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/segments/{name}/{table}")

    def _each(self, table: str) -> DataFrame | None:
        out = None
        for i, (name, *_) in enumerate(self.segments()):
            df = self._read(name, table).withColumn("age", F.lit(i))
            out = df if out is None else out.unionByName(df)
        return out

    def texts(self) -> DataFrame:
        """(segment age, block, place, unit_id, len, group) of live texts."""
        every, gone = self._each("texts"), self._each("deletes")
        gone = gone.groupBy("unit_id").agg(F.max("age").alias("gone"))
        # a unit is live in the last segment that holds it, unless a later one deletes it
        out = every.join(gone, "unit_id", "left")
        return out.where(F.col("gone").isNull() | (F.col("age") >= F.col("gone"))).drop("gone")

    def statistics(self, group: str | None = None) -> tuple[int, float]:
        """(texts, grams of an average text): from the version, or counted for a group."""
        if group is None:
            segments = self.segments()
            n, chars = sum(s[1] for s in segments), sum(s[2] for s in segments)
        else:
            n, chars = self.texts().where(F.col("group") == group).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        return n, max(chars / n, 1.0) if n else 1.0

    # writing --------------------------------------------------------------------------------------------------------

    def update(self, units: DataFrame, deleted: DataFrame | None = None, group: str | None = None, field: str = "text", block: int = BLOCK) -> str:
        """Put ``units`` (unit_id, text; one row a unit) in as a new segment: new ones, and new texts of known ones.

        ``deleted`` (unit_id) go. ``group`` names a column that subset searches may ask for. Returns the segment's name.
        """
        before = self.segments()
        name = f"{len(state.versions(self.spark, f'{self.root}/versions')):08d}-{uuid.uuid4().hex[:8]}"
        place = f"{self.root}/segments/{name}"
        kind = units.schema["unit_id"].dataType.simpleString()
        if self.schemas["deletes"] != f"unit_id {kind}":
            raise ValueError(f"the index holds units by {self.schemas['deletes']}, not {kind}")
        low = units.select("unit_id", (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("group"), F.lower(F.coalesce(F.col(field), F.lit(""))).alias("low"))
        buckets = self.buckets
        names = ["block", "unit_id", "place", "len", "group", "gram", "df", "places", "tfs"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            for i, part in enumerate(text_blocks(batches, "low", block)):
                gram, text, tf, sizes = counted_texts(part.column("low").to_pylist())
                n = part.num_rows
                own = [np.full(n, task << 32 | i, dtype=np.int64), part.column("unit_id"), np.arange(n, dtype=np.int32), np.maximum(sizes - 2, 0), part.column("group")]
                empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x) for x in own), *empty], names=names)
                if not len(gram):
                    continue
                starts = np.flatnonzero(np.diff(gram, prepend=-1))
                dfs = np.diff(np.append(starts, len(gram)))
                rows = [packed(steps_of(text, dfs), dfs), packed(tf - 1, dfs)]
                m = len(starts)
                blank = [pa.nulls(m, part.column("unit_id").type), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, task << 32 | i, dtype=np.int64)), *blank, pa.array(gram[starts]), pa.array(dfs), *rows], names=names)

        made = cut(low.mapInArrow(run, f"block bigint, unit_id {kind}, place int, len bigint, group string, gram bigint, df bigint, places binary, tfs binary"), "segment")
        texts = made.where("place IS NOT NULL").select("block", "place", "unit_id", "len", "group")
        self._write_postings(made.where("gram IS NOT NULL").select("block", "gram", "df", "places", "tfs"), place)
        texts.write.parquet(f"{place}/texts")
        texts = self._read(name, "texts")
        gone = texts.select("unit_id") if deleted is None else texts.select("unit_id").unionByName(deleted.select(F.col("unit_id").cast(kind))).distinct()
        (gone if before else gone.limit(0)).write.parquet(f"{place}/deletes")
        if before:
            live = self.texts().join(self._read(name, "deletes"), "unit_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("chars")).first()
        else:
            live = {"n": 0, "chars": 0}
        now = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("chars")).first()
        self._publish([*before, (name, now["n"] - live["n"], now["chars"] - live["chars"])])
        return name

    def _write_postings(self, postings: DataFrame, place: str) -> None:
        bucket = F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int")
        # Spark splits a bucket that is too large for a task and lets small ones share one
        dealt = postings.withColumn("bucket", bucket).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{place}/postings")

    def merge(self) -> str:
        """All live postings in one segment; deleted texts leave it, and places are counted anew."""
        segments = self.segments()
        name = f"{len(state.versions(self.spark, f'{self.root}/versions')):08d}-{uuid.uuid4().hex[:8]}"
        place = f"{self.root}/segments/{name}"
        live = cut(self.texts().withColumn("to", F.xxhash64("age", "block")), "live")
        live.select(F.col("to").alias("block"), "place", "unit_id", "len", "group").write.parquet(f"{place}/texts")
        texts = live.select(F.col("to").alias("of"), F.col("place").alias("kept"))
        every = self._each("postings").withColumn("block", F.xxhash64("age", "block")).select("block", "gram", "df", "places", "tfs")

        def thin(held: pa.Table, left: pa.Table) -> pa.Table:
            """The postings of a block without places that are not live."""
            kept = left.column("kept").to_numpy()
            alive = np.zeros(int(kept.max(initial=-1)) + 2, dtype=bool)  # the last place stands for all beyond
            alive[kept] = True
            dfs = held.column("df").to_numpy()
            at = sums_of(unpacked(held.column("places").combine_chunks(), dfs), dfs)
            stay = alive[np.minimum(at, len(alive) - 1)]
            now = np.add.reduceat(stay.astype(np.int64), np.cumsum(dfs) - dfs) if len(dfs) else dfs
            out, now = held.select(["block", "gram"]).filter(pa.array(now > 0)), now[now > 0]
            at, tf = at[stay], unpacked(held.column("tfs").combine_chunks(), dfs)[stay]
            for name, column in (("df", pa.array(now)), ("places", packed(steps_of(at, now), now)), ("tfs", packed(tf, now))):
                out = out.append_column(name, column)
            return out

        # a block's postings and its live texts meet once, and not a copy of its texts for each of its grams
        rows = every.groupBy("block").cogroup(texts.groupBy("of"))
        self._write_postings(rows.applyInArrow(thin, "block bigint, gram bigint, df bigint, places binary, tfs binary"), place)
        live.select("unit_id").limit(0).write.parquet(f"{place}/deletes")
        self._publish([(name, sum(s[1] for s in segments), sum(s[2] for s in segments))])
        return name

    # reading --------------------------------------------------------------------------------------------------------

    def hits(self, wanted: list[int], group: str | None = None) -> DataFrame:
        """(unit_id, code, tf, len) of live texts (of a group, where given) that hold one of the grams."""
        grams = sorted(set(wanted))
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram bigint").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int"))
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most ``buckets``
        found = self._each("postings").where(F.col("bucket").isin(*buckets) & F.col("gram").isin(*grams)).select("age", "block", "gram", "df", "places", "tfs")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x for batch in batches for x in df_blocks(batch, POSTINGS)):
                df = b.column("df").to_numpy()
                places, tfs = sums_of(unpacked(b.column("places"), df), df), unpacked(b.column("tfs"), df) + 1
                rows = pa.array(np.repeat(np.arange(len(df)), df))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("age", "block", "gram")), pa.array(places.astype(np.int32)), pa.array(tfs)], names=["age", "block", "code", "place", "tf"])

        texts = self.texts() if group is None else self.texts().where(F.col("group") == group)
        places = found.mapInArrow(spread, "age int, block bigint, code bigint, place int, tf bigint")
        return places.join(texts.select("age", "block", "place", "unit_id", "len"), ["age", "block", "place"]).select("unit_id", "code", "tf", "len")
