"""Packing in parallel against the loop that it stands for."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.operators import packing as P


def loop(costs, budget, fill=0):
    """Batches begun up to each entry, and the fill at the end."""
    n, out = 0, []
    for c in costs:
        if fill and fill + c > budget:
            n, fill = n + 1, 0
        fill += c
        out.append(n)
    return out, fill


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 40), st.integers(0, 60))
def test_a_block_is_a_function_of_its_fill(costs, budget, fill):
    want, end = loop(costs, budget, fill)
    x = np.array(costs)
    assert P.numbered(x, fill, budget).tolist() == want
    assert P.passed(P.steps(x, budget), fill, budget) == (end, want[-1])


def test_functions_are_short():
    r = np.random.default_rng(2)
    f = P.steps(r.integers(60, 3000, 50_000), 60_000)
    assert len(f["marks"]) < 150


def frame(spark, rows):
    return spark.createDataFrame(rows, "group string, id bigint, n int")


def plain(rows, budget, overhead):
    by, out = defaultdict(list), {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        by[g].append((i, (n or 0) + overhead))
    for g, own in by.items():
        for (i, _), b in zip(own, loop([c for _, c in own], budget)[0], strict=True):
            out[g, i] = b
    return out


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_packing_equals_the_loop(spark, block):
    r = random.Random(block)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None, ""]), i, r.choice([None, 0, r.randint(0, 300), 5000])) for i in range(900)]
    got = P.packed(frame(spark, rows), 1000, 10, block)
    assert {(x["group"], x["id"]): x["batch"] for x in got.collect()} == plain(rows, 1000, 10)
    assert P.packed(frame(spark, []), 1000, 10, block).count() == 0


def test_one_key_of_a_million_entries(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("one").alias("group"), "id", (F.pmod(F.xxhash64("id"), F.lit(4000))).cast("int").alias("n"))
    sizes = [r["n"] for r in df.orderBy("id").select("n").toLocalIterator(prefetchPartitions=True)]
    got = P.packed(df, block=16_384)
    blocks = P._blocks(df.select(F.lit("k").alias("key"), "group", "id", F.col("n").cast("bigint").alias("cost")), 16_384)
    assert blocks.rdd.getNumPartitions() > 1 and blocks.count() >= n // 16_384
    want = np.array(loop([x + 60 for x in sizes], 60_000)[0])
    batches = np.empty(n, np.int64)
    for t in got.toPandas().itertuples():
        batches[t.id] = t.batch
    assert (batches == want).all()


def test_rounds_of_a_merge(spark):
    r = random.Random(5)
    rows = [("a", i, r.randint(1, 400)) for i in range(200)] + [("b", i, 10) for i in range(3)] + [("c", 1, 5000)]
    half = lambda df: df.select("group", "batch", F.floor(F.col("n") / 2).alias("n"))
    got = defaultdict(dict)
    for x in P.merge_rounds(frame(spark, rows), half, 1000, 10).collect():
        got[x["round"]][x["group"], x["id"]] = x["batch"]
    now, want = rows, {}
    for k in (1, 2, 3):
        if not now:
            break
        want[k] = plain(now, 1000, 10)
        by = defaultdict(list)
        for g, i, n in sorted(now, key=lambda t: t[1]):
            by[g, want[k][g, i]].append((i, n))
        tops = {g for g, b in by if b > 0}
        now = [(g, own[0][0], sum(n for _, n in own) // 2 if len(own) > 1 else own[0][1]) for (g, _), own in by.items() if g in tops]
    assert dict(got) == want and len(want) == 3
