"""The kept text and vector indexes against plain searches, through updates, removals and merges."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import index as I
from loomspark.operators import memory as M
from loomspark.operators import search as S
from loomspark.operators import vectors as V
from loomspark.sources import state

WORDS = "alpha beta gamma delta été naïve 日本語 😀x the of and".split()


def texts(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 12))), f"g{i % 3}") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "unit_id bigint, text string, source string")


def plain_hits(rows, grams):
    out = []
    for i, t, _ in rows:
        low = (t or "").lower()
        seen = Counter(low[j : j + 3] for j in range(len(low) - 2))
        out += [(i, g, seen[g], max(len(low) - 2, 0)) for g in grams if seen[g]]
    return sorted(out)


def code(g):
    return ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])


GRAMS = ["alp", "eta", "a b", "été", "日本語", " 😀x", "zzz"]


def hits(df):
    names = {code(g): g for g in GRAMS}
    return sorted((r["unit_id"], names[r["code"]], r["tf"], r["len"]) for r in df.collect())


def test_codes_are_code_points(spark):
    got = spark.createDataFrame([(g,) for g in GRAMS], "g string").select("g", I.code_of(F.col("g")).alias("c")).collect()
    assert {r["g"]: r["c"] for r in got} == {g: code(g) for g in GRAMS}


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_scan_and_index_find_the_same_grams(spark, tmp_path, block):
    rows = [*texts(60, 1), (900, None, "g0"), (901, "", "g1"), (902, "ab", "g1"), (903, "alp" * 500, None)]
    want = plain_hits(rows, GRAMS)
    assert hits(I.hits_by_scan(frame(spark, rows), [code(g) for g in GRAMS], block=block)) == want
    index = I.TextIndex(spark, str(tmp_path), buckets=5)
    index.update(frame(spark, rows), group="source", block=block)
    assert hits(index.hits([code(g) for g in GRAMS])) == want
    assert hits(index.hits([code("alp")], group="g1")) == [h for h in want if h[1] == "alp" and h[0] % 3 == 1 and h[0] < 900]
    assert index.statistics() == (len(rows), max(1.0, sum(max(len(t or "") - 2, 0) for _, t, _ in rows) / len(rows)))
    assert I.hits_by_scan(frame(spark, []), [code("alp")]).count() == 0 and index.hits([]).count() == 0


def test_updates_and_removals_touch_their_own_segment(spark, tmp_path):
    rows = {i: (i, t, g) for i, t, g in texts(80, 2)}
    index = I.TextIndex(spark, str(tmp_path), buckets=4)
    first = index.update(frame(spark, list(rows.values())), group="source", block=300)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob(f"segments/{first}/**/*.parquet")}
    changed = [(i, f"alpha beta {i}", "g9") for i in (3, 5, 79, 200)]
    index.update(frame(spark, changed), spark.createDataFrame([(7,), (9,), (12345,)], "unit_id bigint"), group="source")
    rows |= {c[0]: c for c in changed}
    del rows[7], rows[9]
    index.update(frame(spark, [(7, "back again alpha", "g9")]), group="source")
    rows[7] = (7, "back again alpha", "g9")
    index.update(frame(spark, []), spark.createDataFrame([(200,)], "unit_id bigint"))
    del rows[200]
    want, n = plain_hits(rows.values(), GRAMS), len(rows)
    sizes = sum(max(len(t) - 2, 0) for _, t, _ in rows.values())
    assert {p: p.stat().st_mtime_ns for p in files} == files
    for _ in range(3):  # as segments, merged, and merged again after an update
        assert hits(index.hits([code(g) for g in GRAMS])) == want and index.statistics() == (n, sizes / n)
        assert hits(index.hits([code("alp")], group="g9")) == [h for h in want if h[1] == "alp" and h[0] in (3, 5, 79, 7)]
        index.merge()
        assert len(index.segments()) == 1
        index.update(frame(spark, [rows[3]]), group="source")


def test_a_search_opens_the_buckets_of_its_grams(spark, tmp_path):
    index = I.TextIndex(spark, str(tmp_path), buckets=16)
    index.update(frame(spark, texts(50, 3)))
    plan = index.hits([code("alp")])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(gram)" in plan and "df:bigint" in plan
    files = index._each("postings").where("bucket = 3").select(F.input_file_name()).distinct().count()
    assert files < index._each("postings").select(F.input_file_name()).distinct().count()


def test_ranked_search_is_the_same_with_and_without_index(spark, tmp_path):
    units = frame(spark, texts(120, 4)).withColumn("title", F.lit("alpha title"))
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "été naïve"), (3, "日本語"), (4, "alpha beta"), (5, "of")], "query_id bigint, text string")
    index = I.TextIndex(spark, str(tmp_path))
    index.update(units)
    a = sorted(map(tuple, S.gram_search(units, queries, 7).where("query_id < 5").collect()))
    b = sorted(map(tuple, S.gram_search(None, queries.where("query_id < 5"), 7, index=index).collect()))
    assert a == b and len([x for x in a if x[0] == 1]) == 7 and [x[1:] for x in a if x[0] == 1] == [x[1:] for x in a if x[0] == 4]
    both = S.gram_search(units, queries, 5, {"text": 1.0, "title": 2.0})
    assert {r["query_id"] for r in both.collect()} == {1, 2, 3, 4, 5}  # 5 has no gram: containment


def test_many_needles_take_one_pass(spark, monkeypatch):
    units = frame(spark, texts(70, 5))
    needles = [(i, w) for i, w in enumerate(["ALPHA", "beta gamma", "été", "", "x", "nothing like it", "a"])]
    df = spark.createDataFrame(needles, "query_id bigint, needle string")
    one = sorted(map(tuple, S.contains_search(units, df, 9).collect()))
    want = [(q, i) for q, w in needles for i in [i for i, t, _ in texts(70, 5) if w.lower() in t.lower()][:9]]
    assert [(x[0], x[1]) for x in one] == sorted(want)
    monkeypatch.setattr(S, "FEW", 2)
    monkeypatch.setattr(S, "LITERALS", 4)
    assert sorted(map(tuple, S.contains_search(units, df, 9).collect())) == one


# vectors -------------------------------------------------------------------------------------------------------------


def clustered(n, dim=16, seed=7, hot=3):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(30, dim)) * 2
    x = centers[r.integers(0, 30, n)] + r.normal(size=(n, dim)) * 0.6
    x[::hot] = x[0] + r.normal(size=(len(x[::hot]), dim)) * 0.01  # a third in one place
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_index_reaches_its_recall(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "CELL", 500)
    rows = clustered(4000)
    df = spark.createDataFrame([*rows, (9001, None), (9002, [1.0])], "unit_id bigint, embedding array<float>")
    index = V.VectorIndex(spark, str(tmp_path)).build(df.where("unit_id < 3000 OR unit_id > 9000"), recall=0.97)
    index.add(df.where("unit_id >= 3000 AND unit_id < 9000"))
    queries = df.where("unit_id % 50 = 0").select(F.col("unit_id").alias("query_id"), "embedding")
    whole = df.where("size(embedding) = 16")
    assert index.rows().count() == 4000 and index.recall(queries, 10, whole) >= 0.9
    centers, probes = index.centers()
    assert 1 <= probes < len(centers)
    every = index.search(queries, 10, probes=len(centers))  # all lists: exact
    exact = S.knn(whole, queries, 10)
    pick = lambda d: sorted((r["query_id"], r["unit_id"], round(r["score"], 6)) for r in d.collect())
    assert pick(every) == pick(exact)


def test_cells_equal_one_pass(spark, monkeypatch):
    df = spark.createDataFrame(clustered(500), "unit_id bigint, embedding array<float>")
    queries = df.where("unit_id % 5 = 0").select(F.col("unit_id").alias("query_id"), "embedding")
    one = sorted(map(tuple, S.knn(df, queries, 4).collect()))
    monkeypatch.setattr(S, "QUERY_BLOCK", 30)
    many = S.knn(df, queries, 4)
    assert "FlatMapCoGroups" in many._jdf.queryExecution().executedPlan().toString()
    assert [x[:3] + (round(x[3], 9),) + x[4:] for x in sorted(map(tuple, many.collect()))] == [x[:3] + (round(x[3], 9),) + x[4:] for x in one]


def test_new_memories_are_judged_against_stored_ones(spark, tmp_path):
    r = np.random.default_rng(3)
    old = r.normal(size=(300, 24))
    new = []
    for i in range(60):
        base = old[r.integers(300)] if i % 3 else r.normal(size=24)
        noise = (0.0, 0.2, 0.6)[i % 3 if i % 2 else 2]
        new.append(base + noise * r.normal(size=24) * (np.linalg.norm(base) / math.sqrt(24)))
    new[10] = new[4].copy()
    new[11] = new[4] + 0.1 * r.normal(size=24)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate([*old, *new])]
    df = spark.createDataFrame(rows, "unit_id bigint, embedding array<double>")
    index = V.VectorIndex(spark, str(tmp_path)).build(df.where("unit_id < 300"), recall=0.999)
    got = {t["id"]: (t["status"], t["dedup_of"]) for t in V.triage_new(index, df.where("unit_id >= 300"), 0.92, 0.80).collect()}
    unit = np.array([x for _, x in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    gone, want = set(), {}
    for i in range(300, 360):
        sims = [(float(unit[i] @ unit[j]), -j) for j in range(i) if j not in gone]
        sim, j = max(sims)
        status = "duplicate" if sim >= 0.92 else "similar" if sim >= 0.80 else "new"
        if status == "duplicate":
            gone.add(i)
        want[i] = (status, -j if status != "new" else None)
    assert Counter(s for s, _ in want.values()).keys() == {"new", "similar", "duplicate"} and got == want


def test_queries_and_units_of_one_table_meet_in_cells(spark, monkeypatch):
    """Findings F1: many queries that come from the table of the units."""
    from loomspark import registry

    query = registry.queries()["model_fusion"]
    few = sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    monkeypatch.setattr(S, "CELL", 64, raising=False)
    many = query(spark, "/root/testdata/sf0.001")
    assert "FlatMapCoGroups" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect())) == few


def test_products_are_held_tile_by_tile():
    """Findings F8 and F9: memory of a task doesn't grow with queries times units; copies of a vector tie."""
    import tracemalloc

    r = np.random.default_rng(2)
    x = r.normal(size=(12_000, 16))
    x[7::40] = x[7]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:1_500]
    tracemalloc.start()
    found = S._best(np.arange(len(q)), q, np.arange(len(x)), x, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(q) * len(x) * 8 / 2
    assert found[found["query_id"] == 7]["unit_id"].tolist() == [7, 47, 87, 127, 167] and len(found) == 5 * len(q)


def test_a_merge_deals_texts_to_blocks_and_not_to_postings(spark, tmp_path, monkeypatch):
    """Findings F10: the texts of a block travel once, and not with each of its grams."""
    plans, write = [], I.TextIndex._write_postings
    monkeypatch.setattr(I.TextIndex, "_write_postings", lambda self, df, place: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df, place))
    rows = texts(80, 9)
    index = I.TextIndex(spark, str(tmp_path))
    index.update(frame(spark, rows), block=300)
    index.update(frame(spark, rows[:9]), frame(spark, rows[9:20]).select("unit_id"))
    index.merge()
    assert "FlatMapCoGroupsInArrow" in plans[-1]
    assert hits(index.hits([code(g) for g in GRAMS])) == plain_hits([*rows[:9], *rows[20:]], GRAMS)


def test_postings_are_packed_and_unpacked_in_bounded_slices():
    """Findings F12: an unpacked slice holds few places more than its bound, however many a batch has."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    dfs = r.integers(1, 300, 400)
    x = np.concatenate([np.sort(r.choice(1 << int(r.choice([10, 18, 31])), n, replace=False)) for n in dfs])
    batch = pa.RecordBatch.from_arrays([pa.array(dfs), I.packed(I.steps_of(x, dfs), dfs)], names=["df", "places"])
    slices = list(I.df_blocks(batch, 1_000))
    sizes = [b.column("df").to_numpy().sum() for b in slices]
    assert len(slices) > 20 and max(sizes) < 1_300 and sum(sizes) == len(x)
    assert np.concatenate([I.sums_of(I.unpacked(b.column("places"), b.column("df").to_numpy()), b.column("df").to_numpy()) for b in slices]).tolist() == x.tolist()
    own = [t for _, t, _ in texts(90, 4)]
    whole, parts = I.counted_texts(own), I.counted_texts(own, 50)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
