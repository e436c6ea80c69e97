"""The fold of commands against a plain loop."""

import random

import pytest

from loomspark.operators import materials as M


def plain(commands):
    """(doc, no) -> (before, after, legal), and the last state of each document."""
    state, sha, rows = {}, {}, {}
    for doc, no, action, s in sorted(commands, key=lambda c: c[1]):
        if doc is None:
            rows[doc, no] = ("none", "none", False)
            continue
        now = state.get(doc, "none")
        to = None
        if action == "ingest":
            to = "ok" if now == "ok" and s is not None and sha.get(doc) == s else "pending"
        elif action in ("converted", "error") and now == "pending":
            to = "ok" if action == "converted" else "failed"
        elif action == "retry" and now == "failed" or action == "reconvert" and now in ("ok", "failed"):
            to = "pending"
        elif action == "retract" and now in ("pending", "ok", "failed"):
            to = "retracted"
        elif action == "forget" and now != "none":
            to = "none"
        if action == "ingest":
            sha[doc] = s
        if action == "forget":
            sha[doc] = None
        state[doc] = to or now
        rows[doc, no] = (now, state[doc], to is not None)
    return rows, state


def commands(n, seed, hot=0.4):
    r = random.Random(seed)
    weights = (4, 6, 2, 1, 1, 1, 1)
    return [("hot" if r.random() < hot else r.choice([*"abcdefg", None]), no, r.choices([*M.ACTIONS], weights)[0] if r.random() > 0.02 else r.choice(["odd", None]), r.choice(["s1", "s2", "s3", None])) for no in range(n)]


SCHEMA = "doc string, no bigint, action string, sha string"


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_fold_equals_the_loop(spark, block):
    rows = commands(400, block)
    want, state = plain(rows)
    done = M.folded(spark.createDataFrame(rows, SCHEMA), block)
    assert {(r["doc"], r["no"]): (r["before"], r["after"], r["legal"]) for r in done.collect()} == want
    live = {r["doc"]: (r["status"], r["commands"], r["illegal"]) for r in M.current(done).collect()}
    assert live == {d: (s, sum(k[0] == d for k in want), sum(k[0] == d and not v[2] for k, v in want.items())) for d, s in state.items() if s != "none"}
    assert M.folded(spark.createDataFrame([], SCHEMA), block).count() == 0


def test_long_documents_are_composed_in_runs(spark, monkeypatch):
    short = M._entries
    monkeypatch.setattr(M, "_entries", lambda maps: short(maps, 4))
    rows = commands(300, 9, hot=0.9)
    done = M.folded(spark.createDataFrame(rows, SCHEMA), 2)
    assert {(r["doc"], r["no"]): (r["before"], r["after"], r["legal"]) for r in done.collect()} == plain(rows)[0]


def test_duplicates_and_retries(spark):
    say = lambda doc, *actions: [(doc, a.split(":")[0], a.split(":")[1] if ":" in a else None) for a in actions]
    script = [*say("a", "ingest:x", "converted"), *say("b", "ingest:x"), *say("c", "ingest:y", "error", "retry", "error"), *say("d", "ingest:z", "error"), *say("e", "ingest:x", "retract"), *say("f", "ingest:w", "error", "retry", "converted", "reconvert", "error"), *say("g", "ingest:v", *["error", "retry"] * 3, "error")]
    rows = [(d, i, a, s) for i, (d, a, s) in enumerate(script)]
    done = M.folded(spark.createDataFrame(rows, SCHEMA))
    live = M.current(done)
    assert [tuple(r) for r in M.duplicates(live).collect()] == [("b", "a")]
    assert sorted((r["doc"], r["failures"], r["next_no"]) for r in M.to_retry(done, live).collect()) == [("c", 2, 0), ("d", 1, 1), ("f", 1, 2)]
