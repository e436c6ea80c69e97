"""Stages with offsets of their own, tables whose columns change, vectors of several models."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import models
from loomspark.sources import state
from loomspark.streaming import consumers


def test_a_stage_that_fails_is_served_again_and_others_are_not(spark, tmp_path):
    delta, seen, broken = str(tmp_path / "delta"), [], [True]

    def stage(name):
        def work(batch, number):
            ids = sorted(r["id"] for r in batch.collect())
            if name == "b" and broken[0] and 3 in ids:
                raise ValueError("the second stage is down")
            seen.append((name, number, ids))

        return work

    go = lambda *names: consumers.run(spark, delta, "id bigint", str(tmp_path / "check"), {n: stage(n) for n in names})
    spark.range(0, 2).coalesce(1).write.mode("append").parquet(delta)
    assert go("a", "b") == {"a": None, "b": None} and sorted(seen) == [("a", 0, [0, 1]), ("b", 0, [0, 1])]
    seen.clear()
    spark.range(2, 4).coalesce(1).write.mode("append").parquet(delta)
    out = go("a", "b")
    assert out["a"] is None and "is down" in out["b"] and seen == [("a", 1, [2, 3])]
    seen.clear()
    broken[0] = False
    assert go("a", "b", "late") == {"a": None, "b": None, "late": None}
    assert ("b", 1, [2, 3]) in seen and ("late", 0, [0, 1, 2, 3]) in seen and not [x for x in seen if x[0] == "a"]


def test_versions_with_other_columns(spark, tmp_path):
    root = str(tmp_path / "t")
    state.save_version(spark.createDataFrame([(1, 5), (2, None)], "id int, n int"), root, "1")
    state.save_version(spark.createDataFrame([(3, 1 << 40, "x", None)], "id bigint, n bigint, name string, doubled bigint"), root, "2")
    state.save_version(spark.createDataFrame([(4,)], "id int"), root, "3")
    got = state.read_evolved(spark, root, {"doubled": F.col("id") * 2, "name": F.lit("none")})
    assert sorted(map(tuple, got.select("version", "id", "n", "name", "doubled").collect()), key=repr) == sorted([("1", 1, 5, "none", 2), ("1", 2, None, "none", 4), ("2", 3, 1 << 40, "x", None), ("3", 4, None, "none", 8)], key=repr)
    with pytest.raises(FileNotFoundError):
        state.read_evolved(spark, str(tmp_path / "nothing"))


def test_vectors_of_several_models(spark):
    units = spark.createDataFrame([(i,) for i in range(4)], "unit_id bigint")
    rows = [(0, "fast", [1.0, 0.0]), (1, "fast", [0.0, 1.0]), (1, "base", [1.0]), (2, "base", [1.0, 0.0, 0.0]), (9, "fast", [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "unit_id bigint, model string, embedding array<float>")
    sizes = {"fast": 2, "base": 3}
    assert sorted(map(tuple, models.lacking(units, vectors, sizes).collect())) == [(0, "base", 1), (1, "base", 1), (2, "fast", 0), (3, "base", 1), (3, "fast", 0)]
    asked = []

    def encoder(dim):
        def encode(todo):
            asked.append(sorted(r["unit_id"] for r in todo.collect()))
            return todo.select("unit_id", F.array(*[F.col("unit_id").cast("float")] * dim).alias("embedding"))

        return encode

    full = models.repaired(units, vectors, sizes, {m: encoder(d) for m, d in sizes.items()})
    assert asked == [[2, 3], [0, 1, 3]] and full.count() == 8 and models.lacking(units, full, sizes).count() == 0
    queries = spark.createDataFrame([(7, "fast", [1.0, 0.1]), (7, "base", [0.0, 0.0, 1.0])], "query_id bigint, model string, embedding array<float>")
    got = models.model_channels(full, queries, sizes, 1).collect()
    assert {(r["channel"], r["unit_id"]) for r in got} == {("vec", 0), ("vec:base", 1)}


def test_a_delta_of_many_sessions_is_whole(spark, tmp_path):
    """Findings F2: more sessions than the cap that a delta has by default."""
    import duckdb

    from loomspark.plans import changes

    spark.range(12_000).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", "'x' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = changes.delta_recorded(spark, str(tmp_path)).select("run", "source", "id", "status", "oversized")
    want = con.execute("SELECT run, source, id, status, oversized FROM (" + changes.ORACLE["delta_recorded"] + ")").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and len(want) > 10_000


def test_pages_of_one_root_are_not_gathered(spark):
    """Findings F11: whether a root was scanned is looked up without dealing the pages, texts and all, by root."""
    from loomspark.operators import pages

    old = spark.createDataFrame([(f"w{i}", "de" if i % 5 else "fr", f"text {i}") for i in range(40)], "src_id string, root string, text string")
    now = old.where("root = 'de' AND src_id <> 'w1'")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pages.projection_changes(old, now, now.select("src_id"), ("text", "root"), now.select("root"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["src_id"]: r["change"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan
    outer = next(i for i, line in enumerate(plan.splitlines()) if "FullOuter" in line)
    assert not any("SortMergeJoin" in line for line in plan.splitlines()[:outer])  # nothing is joined by a key that the outer join left null
    assert got == {f"w{i}": "kept" if i % 5 == 0 else "gone" if i == 1 else "same" for i in range(40)}
