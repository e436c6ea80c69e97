"""The pipeline's stages, each held against what its operator decides."""

from collections import Counter

import corpus_pipeline
from loomspark.llm import decontam, mixing, simhash, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(names) == 5
    a = stages[0](spark, docs, SMALL)
    toxic = {r.doc_id for r in toxicity.op3_toxicity(docs, labels).where("predicted = 1").collect()}
    assert ids(a) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in toxic)
    b = stages[1](spark, a, SMALL)
    classes = {}
    for r in simhash.similar_classes(a).collect():
        classes.setdefault(r.root, []).append(r.id)
    assert ids(b) == Counter(min(x) for x in classes.values())
    c = stages[2](spark, b, SMALL)
    leaks = {r.doc_id for r in decontam.op1_decontam(b, items).collect()}
    assert ids(c) == Counter(x for x in ids(b) if x not in leaks)
    d = stages[3](spark, c, SMALL)
    plan = {r.id: r.times for r in mixing.mix(c).collect()}
    assert ids(d) == Counter({k: n for k, n in plan.items() if n})
    e = stages[4](spark, d, SMALL)
    assert ids(e) == ids(d) and all(x.columns == docs.columns for x in (a, b, c, d))
    sizes = [r["count"] for r in e.groupBy("shard").count().collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 1


def test_run_agrees_with_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    again = corpus_pipeline.run(spark, SMALL)
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert Counter(map(key, out.collect())) == Counter(map(key, again.collect()))


def test_stages_on_edge_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a row without an id", "en", "a", 1), (3, "same words in every copy of this text", "en", "a", 1), (4, "same words in every copy of this text", "de", None, 1), (5, "x" * 200_000 + " and some words", "en", "z", 1), (5, "another text of one id", "en", "z", 1), (6, "row", "en", "a", 1), (6, "row", "en", "a", 1)]
    for name, table, columns in (("labels", [], "doc_id bigint, quality int, toxic int"), ("benchmark", [], "item_id bigint, text string")):
        spark.createDataFrame(table, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    clash = "_leaks score _score kept_id n h times shard slot _mix_n row cell".split()
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for i, name in enumerate(clash):
            docs = docs.selectExpr("*", f"{i} AS `{name}`")
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            kept = out.columns if name != "sharding" else [c for c in out.columns if c not in ("shard", "slot", "curve_cell")]
            assert [c for c in kept] == [c for c in docs.columns if name != "sharding" or c not in ("shard", "slot")]
            found = Counter((r.doc_id, r.text) for r in out.collect())
            all_ = Counter((r.doc_id, r.text) for r in docs.collect())
            if name in ("toxicity", "benchmark_decontamination", "sharding"):
                assert found == all_, name
            if name == "simhash_near_dedup" and n:
                assert found == Counter({(1, None): 1, (None, "a row without an id"): 1, (3, rows[3][1]): 1, (5, rows[5][1]): 1, (5, rows[6][1]): 1, (6, "row"): 1})
            if name == "mixing":
                assert set(found) <= set(all_)
