"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a small grid, a row's cell gets its index on the Hilbert curve over that
grid, and the rows in curve order are cut into runs of equal length: files that cover a compact part of the metadata
space, so that min/max statistics prune on every one of the columns.

Ranks are found in levels: rows are counted by cell (4096 at most), a cell is cut by a hash into sub-cells of about
``SUB_ROWS`` rows, the counts are summed along the curve, and only rows of one sub-cell are sorted together. So a cell
that holds a third of all rows is dealt to many tasks, however many rows there are.

Edge cases: null metadata sorts below everything else; null text has size 16 and the checksum of no bytes; equal
rows tie and take neighbouring slots; an empty table gives an empty result. Columns of any name pass through (a row
travels as one struct); those named like a result (``curve_cell``, ``shard``, ``slot``) are replaced by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bits per dimension, dimensions, and about how many rows are sorted together: a task holds their texts.
GRID_BITS, DIMS, SUB_ROWS = 3, 4, 1 << 12


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of ``coords`` (n, d), each in [0, 2**bits): Skilling's transform, on columns."""
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def text_cuts(rows: DataFrame, dim: Column, bits: int) -> list[str]:
    """Up to ``2**bits - 1`` cut points of a string: its values if they are no more, else quantiles of the rows.

    Whole strings are compared. Values are counted first, and the counts summed in ranges of values.
    """
    n = 1 << bits
    counts = rows.select(dim.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    few = [r["v"] for r in counts.select("v").orderBy("v").limit(n).collect()]
    if len(few) < n:
        return few
    before = counts.groupBy("part").agg(F.sum("n").alias("part_n"))  # a row for each partition
    before = before.select("part", (F.sum("part_n").over(Window.orderBy("part")) - F.col("part_n")).alias("start"), F.sum("part_n").over(Window.partitionBy()).alias("total"))
    along = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    upto = counts.join(F.broadcast(before), "part").select("v", "n", "total", along.alias("upto"))
    step = f"(upto - n) * {n} div total"
    return [r["v"] for r in upto.where(f"upto * {n} div total > {step} AND {step} < {n - 1}").orderBy("v").select("v").collect()]


def text_rank(dim: Column, cuts: list[str]) -> Column:
    """How many of the cut points a string reaches; null reaches none."""
    return sum((F.coalesce((dim >= F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))


def curve_cell(dims: list[Column], cuts: list[list[float]], bits: int) -> Column:
    """Curve index of the cell that ``cuts`` put the values of ``dims`` in.

    The grid is small (``2**(bits * dims)`` cells), so the index of every cell is found once and a row looks its own up.
    """
    side, d = 1 << bits, len(dims)
    every = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), axis=-1).reshape(-1, d)
    table = F.lit([int(x) for x in hilbert_index(every, bits)])
    place = F.lit(0)
    for x, c in zip(dims, cuts, strict=True):
        place = place * side + sum(((x >= F.lit(float(v))).cast("int") for v in c), F.lit(0))
    return F.get(table, place)


def assign(rows: DataFrame, dims: list[Column], tie: list[Column], shards: int = 40, bits: int = GRID_BITS, sub_rows: int = SUB_ROWS) -> DataFrame:
    """``rows`` plus curve_cell, shard, slot: runs of the curve order whose lengths differ by one at most.

    ``tie`` orders rows within a cell and spreads a cell over sub-cells. The cut points are ``2**bits - 1`` quantiles of
    each dimension, all that comes to the driver. A string's values are ranked whole.
    """
    names = [f"dim{i}" for i in range(len(dims))]
    strings = [f.dataType.typeName() == "string" for f in rows.select(*dims).schema]
    dims = [text_rank(c, text_cuts(rows, c, bits)) if text else c for c, text in zip(dims, strings, strict=True)]
    ties = [f"tie{i}" for i in range(len(tie))]
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("curve_cell", "shard", "slot")]
    base = rows.select(F.struct(*kept).alias("row"), *[c.alias(t) for c, t in zip(tie, ties, strict=True)], F.xxhash64(*tie).alias("mix"), *[F.coalesce(c.cast("double"), F.lit(-1.0)).alias(n) for c, n in zip(dims, names, strict=True)])
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = base.agg(*[F.percentile_approx(n, steps, 2000).alias(n) for n in names]).first()
    cuts = [[i + 0.5 for i in range((1 << bits) - 1)] if text else sorted(set(found[n] or [])) for n, text in zip(names, strings, strict=True)]
    base = base.withColumn("cell", curve_cell([F.col(n) for n in names], cuts, bits)).drop(*names)
    cells = base.groupBy("cell").agg(F.count(F.lit(1)).alias("cell_n"))
    along = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**(bits * dims) rows
    cells = cells.select("cell", F.ceil(F.col("cell_n") / sub_rows).cast("bigint").alias("parts"), F.coalesce(F.sum("cell_n").over(along), F.lit(0)).alias("cell_start"), F.sum("cell_n").over(Window.partitionBy()).alias("total"))
    cells = materialise(cells, "cells")
    base = base.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("sub", F.pmod("mix", "parts")).drop("parts")  # 2**(bits * dims) rows at most: 4096 of two numbers
    counts = base.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("sub_start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(cells), "cell").select("cell", "sub", (F.col("cell_start") + F.col("sub_start")).alias("start"), "total")
    order = Window.partitionBy("cell", "sub").orderBy("mix", *ties)
    ranked = base.withColumn("at", F.row_number().over(order)).join(starts, ["cell", "sub"]).withColumn("rank", F.col("start") + F.col("at") - 1)
    small, extra = F.expr(f"total div {shards}"), F.expr(f"total % {shards}")
    edge = extra * (small + 1)  # the first shards take one row more
    shard = F.when(F.col("rank") < edge, F.expr(f"rank div (total div {shards} + 1)")).otherwise(extra + F.floor((F.col("rank") - edge) / F.greatest(small, F.lit(1))).cast("bigint"))
    slot = F.when(F.col("rank") < edge, F.expr(f"rank % (total div {shards} + 1)")).otherwise((F.col("rank") - edge) % F.greatest(small, F.lit(1)))
    return ranked.select("row.*", F.col("cell").alias("curve_cell"), shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def shard_dims(size: Column) -> list[Column]:
    return [F.col("lang"), F.col("source"), size, F.col("doc_id")]


def op2_hilbert(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of the whole table, under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = assign(thin, shard_dims(F.col("size")), [F.col("text_crc32"), F.col("doc_id")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` plus curve_cell, shard, slot."""
    return assign(docs, shard_dims(F.coalesce(F.octet_length("text"), F.lit(0))), [F.xxhash64("text"), F.col("doc_id")], shards)
