"""Values of nested JSON against a recursive reading."""

import json
import random

import pytest

from loomspark.operators import nested


def plain(value, path="$", key=None, depth=0):
    yield path, key, depth, value
    if isinstance(value, dict):
        for k, v in value.items():
            yield from plain(v, f"{path}.{k}", k, depth + 1)
    if isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain(v, f"{path}[{i}]", None, depth + 1)


def made(r, depth):
    kind = r.choice(["int", "text", "null", "bool", "float", *(["dict", "list"] * 3 if depth else [])])
    if kind == "dict":
        return {k: made(r, depth - 1) for k in r.sample(["a", "b", "id", "x"], r.randint(0, 4))}
    if kind == "list":
        return [made(r, depth - 1) for _ in range(r.randint(0, 4))]
    return {"int": r.randint(-5, 10**12), "text": r.choice(["17", "-3", "x1", "", "1.5"]), "null": None, "bool": True, "float": 1.5}[kind]


def test_walk_equals_the_recursion(spark):
    r = random.Random(3)
    docs = [{"a": made(r, 6), "id": i} for i in range(40)]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(100, None), (101, "no json"), (102, "7"), (103, "[]")]
    df = spark.createDataFrame(rows, "doc bigint, j string")
    docs = {**dict(enumerate(docs)), 102: 7, 103: []}
    want = {i: sorted((p, k, d) for p, k, d, _ in plain(x)) for i, x in docs.items()}
    got = {}
    for t in nested.walk(df, "j", ["doc"]).collect():
        got.setdefault(t["doc"], []).append((t["path"], t["key"], t["depth"]))
    assert {i: sorted(x, key=repr) for i, x in got.items()} == {i: sorted(x, key=repr) for i, x in want.items()}
    ints = sorted((i, p, int(v)) for i, x in docs.items() for p, _, _, v in plain(x) if type(v) is int or isinstance(v, str) and v in ("17", "-3"))
    assert sorted(map(tuple, nested.flat_ints(df, "j", ["doc"]).collect())) == ints
    found = sorted((i, p, d, json.dumps(v, separators=(",", ":"))) for i, x in docs.items() for p, k, d, v in plain(x) if k == "id")
    assert [t[:3] for t in sorted(map(tuple, nested.find_key(df, "j", ["doc"], "id").collect()))] == [t[:3] for t in found]
    with pytest.raises(ValueError, match="deeper"):
        nested.walk(df, "j", ["doc"], 2)
