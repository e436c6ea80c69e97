"""Greedy packing of long sequences in parallel.

Next-fit packing puts entries, in order, into a batch until the next one would exceed the budget; then a new batch begins.
Each decision depends on all before it, but only through one number: how full the open batch is. So a block of consecutive
entries is a function from the fill at its begin to the fill at its end and the batches begun in it, and blocks are worked
on side by side:

1. Entries are ordered and numbered in ranges, and cut into blocks.
2. From a place where a batch begins everything is decided. Working from a block's end, each place gets the fill at the end
   and the batches that follow. The fill at the begin only decides where the first batch of the block begins, which is
   within the budget of its first entries: the function is a list of steps, no longer than a batch has entries.
3. The functions of a group are applied in order, a row for each block; one task reads them as a stream.
4. Each block, told its fill and its first batch, numbers its entries.

Entries of one group may be dealt to any number of tasks; groups may be many and small as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.state import cut

BUDGET, OVERHEAD = 60_000, 60
#: Entries in a block.
BLOCK = 65_536


def next_cuts(costs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(running sums from 0, for each place the place where the batch that begins there ends)."""
    sums = np.concatenate([[0], np.cumsum(costs, dtype=np.int64)])
    ends = np.searchsorted(sums, sums[:-1] + budget, side="right") - 1
    # a batch without anything in it takes the next entry, whatever its size
    empty = sums[ends] == sums[:-1]
    return sums, np.where(empty, np.minimum(ends + 1, len(costs)), ends)


def chains(costs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(running sums, exit, more): for a batch that begins at each place, the fill at the block's end and the batches after it."""
    sums, ends = next_cuts(costs, budget)
    n = len(costs)
    exit_, more = (sums[n] - sums[:-1]).tolist(), [0] * n
    for i, e in zip(range(n - 1, -1, -1), ends[::-1].tolist(), strict=True):
        if e < n:
            exit_[i], more[i] = exit_[e], more[e] + 1
    return sums, np.array(exit_, dtype=np.int64), np.array(more, dtype=np.int64)


def steps(costs: np.ndarray, budget: int) -> dict:
    """The function of a block. ``marks`` are sums of its first entries; the first above ``budget - fill`` is the step that
    is taken: ``exits`` and ``begun``. Beyond all marks the batch stays open. A fill of 0 is no open batch and goes its own way."""
    sums, exit_, more = chains(costs, budget)
    reach = min(len(costs), int(np.searchsorted(sums[1:], budget, side="right")) + 1)
    marks, exits, begun = sums[1 : reach + 1], exit_[:reach], more[:reach] + 1
    last = np.ones(reach, bool)  # steps with one result are one step
    last[:-1] = (exits[1:] != exits[:-1]) | (begun[1:] != begun[:-1])
    return {"marks": marks[last], "exits": exits[last], "begun": begun[last], "total": int(sums[-1]), "exit": int(exit_[0]), "more": int(more[0])}


def passed(f: dict, fill: int, budget: int) -> tuple[int, int]:
    """(fill at the end, batches begun) of a block that is entered with a fill."""
    if not fill:
        return f["exit"], f["more"]
    i = int(np.searchsorted(f["marks"], budget - fill, side="right"))
    return (fill + f["total"], 0) if i == len(f["marks"]) else (int(f["exits"][i]), int(f["begun"][i]))


def numbered(costs: np.ndarray, fill: int, budget: int) -> np.ndarray:
    """How many batches have begun in a block up to each entry."""
    sums, ends = next_cuts(costs, budget)
    out = np.zeros(len(costs), np.int64)
    at = max(int(np.searchsorted(sums, budget - fill, side="right")) - 1, 0) if fill else int(ends[0])
    while at < len(costs):
        out[at] = 1
        at = int(ends[at])
    return np.cumsum(out)


def _blocks(entries: DataFrame, block: int) -> DataFrame:
    """(key, group, no, ids, costs): blocks of entries (key, group, id, cost) in order; ``no`` orders the blocks of a group."""
    kinds = {c: entries.schema[c].dataType.simpleString() for c in ("group", "id")}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, no = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ends = pa.array([0, len(t)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, t.column(c).chunk(0)) for c in ("id", "cost")]
            one = [t.column(c).chunk(0).slice(0, 1) for c in ("key", "group")]
            return pa.RecordBatch.from_arrays([*one, pa.array([part << 32 | no], pa.int64()), *lists], names=["key", "group", "no", "ids", "costs"])

        last = None
        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else []
            for s, e in zip(starts, starts[1:], strict=False):
                if held and (size == block or keys[s] != last):
                    yield flush()
                    held, size, no = [], 0, no + 1
                last = keys[s]
                while s < e:
                    if size == block:
                        yield flush()
                        held, size, no = [], 0, no + 1
                    take = min(int(e - s), block - size)
                    held.append(b.slice(int(s), take))
                    s, size = s + take, size + take
        if held:
            yield flush()

    ordered = entries.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return cut(ordered.mapInArrow(gather, f"key string, group {kinds['group']}, no bigint, ids array<{kinds['id']}>, costs array<bigint>"), "blocks")


def _folded(budget: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Apply the functions of blocks, sorted by group and place: (group, no, fill, first) of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, fill, first = None, 0, 0
        for pdf in frames:
            out = []
            for f in pdf.to_dict("records"):
                if last is None or f["key"] != last:
                    last, fill, first = f["key"], 0, 0
                out.append((f["key"], f["no"], fill, first))
                fill, begun = passed(f, fill, budget)
                first += begun
            yield pd.DataFrame(out, columns=["key", "no", "fill", "first"])

    return run


def packed(entries: DataFrame, budget: int = BUDGET, overhead: int = OVERHEAD, block: int = BLOCK) -> DataFrame:
    """(group, id, batch) of ``entries`` (group, id, n): the batch, from 0 in each group, of next-fit packing by id.

    An entry costs ``n + overhead``; one larger than the budget is alone in its batch. Ids don't repeat in a group; a null
    group is a group, a null size is 0.
    """
    cost = F.coalesce(F.col("n"), F.lit(0)).cast("bigint") + overhead
    key = F.md5(F.coalesce(F.concat(F.lit("g"), F.col("group").cast("string")), F.lit("null")))  # a group's name, never null
    rows = _blocks(entries.select(key.alias("key"), "group", "id", cost.alias("cost")), block)
    kinds = {c: entries.schema[c].dataType.simpleString() for c in ("group", "id")}

    def functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([{"key": k, "no": n} | steps(np.asarray(c), budget) for k, n, c in zip(pdf["key"], pdf["no"], pdf["costs"], strict=True)])

    made = rows.select("key", "no", "costs").mapInPandas(functions, "key string, no bigint, marks array<bigint>, exits array<bigint>, begun array<bigint>, total bigint, exit bigint, more bigint")
    state = made.repartition("key").sortWithinPartitions("key", "no").mapInPandas(_folded(budget), "key string, no bigint, fill bigint, first bigint")
    told = rows.join(state, ["key", "no"])

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            batches = [first + numbered(np.asarray(c), int(fill), budget) for c, fill, first in zip(pdf["costs"], pdf["fill"], pdf["first"], strict=True)]
            yield pd.DataFrame({"group": pdf["group"], "ids": pdf["ids"], "batches": batches})

    out = told.select("group", "ids", "costs", "fill", "first").mapInPandas(number, f"group {kinds['group']}, ids array<{kinds['id']}>, batches array<bigint>")
    pairs = F.inline(F.arrays_zip("ids", "batches"))
    return out.select("group", pairs).select("group", F.col("ids").alias("id"), F.col("batches").alias("batch"))


def merge_rounds(entries: DataFrame, merged_size: Callable[[DataFrame], DataFrame], budget: int = BUDGET, overhead: int = OVERHEAD, rounds: int = 3) -> DataFrame:
    """(group, id, round, batch): how ``entries`` (group, id, n) are merged in up to ``rounds`` rounds.

    In a round every batch of a group becomes one entry, of the size that ``merged_size`` gives it ((group, batch, n, first)
    to (group, batch, n); a batch of one entry keeps its own size). A group with one batch is done. ``id`` of a later round
    is the first id of what was merged.
    """
    now, out = entries.select("group", "id", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")), None
    for r in range(1, rounds + 1):
        dealt = cut(packed(now, budget, overhead), "round")
        done = dealt.withColumn("round", F.lit(r))
        out = done if out is None else out.unionByName(done)
        if r == rounds:
            break
        same = [dealt["group"].eqNullSafe(now["group"]), dealt["id"] == now["id"]]
        batches = dealt.join(now, same).select(dealt["group"], dealt["id"], "batch", "n")
        batches = cut(batches.groupBy("group", "batch").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.count(F.lit(1)).alias("parts")), "merged")
        several = batches.where("parts > 1")
        if several.isEmpty():
            break
        sizes = merged_size(several.select("group", "batch", "n", "first")).select(F.col("group").alias("g"), F.col("batch").alias("b"), F.col("n").alias("merged"))
        more = batches.groupBy("group").agg(F.max("batch").alias("top")).where("top > 0").select(F.col("group").alias("h"))  # one batch: done
        now = batches.join(sizes, F.col("group").eqNullSafe(F.col("g")) & (F.col("batch") == F.col("b")), "left").join(more, F.col("group").eqNullSafe(F.col("h")), "left_semi")
        now = cut(now.select("group", F.col("first").alias("id"), F.coalesce("merged", "n").cast("bigint").alias("n")), "entries")
        if now.isEmpty():
            break
    return out
