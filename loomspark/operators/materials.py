"""Life cycle of materials: an ordered fold of commands by document, and what to retry.

A document is known by its source (URL or path): bytes that are new for a known source replace what was there, bytes that
another live document has already are a duplicate. Commands come in the order of their numbers:

| action    | none     | pending  | ok         | failed  | retracted |
| --------- | -------- | -------- | ---------- | ------- | --------- |
| ingest    | pending  | pending  | pending or | pending | pending   |
|           |          |          | unchanged  |         |           |
| converted | illegal  | ok       | illegal    | illegal | illegal   |
| error     | illegal  | failed   | illegal    | illegal | illegal   |
| retry     | illegal  | illegal  | illegal    | pending | illegal   |
| reconvert | illegal  | illegal  | pending    | pending | illegal   |
| retract   | illegal  | retracted| retracted  | retracted | illegal |
| forget    | illegal  | none     | none       | none    | none      |

An illegal command changes nothing and is reported with its row. Ingesting the same bytes into an ``ok`` document leaves it.

The status is one of five, so a block of commands is a function from five statuses to five, as an array; functions of
blocks are composed in order, a row for each block, and a document's commands are folded by as many tasks as it has blocks.
Before that its commands are numbered and compared with the ingest before, in one task's sorted stream. Whether an ingest brings the bytes of the ingest before it is known without the fold, from the
commands alone, as each ingest that isn't left out sets them and one that is left out equals them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.state import cut
from .events import number_rows

STATES = ("none", "pending", "ok", "failed", "retracted")
ACTIONS = ("ingest", "converted", "error", "retry", "reconvert", "retract", "forget")
NONE, PENDING, OK, FAILED, RETRACTED = range(5)
#: Where each action leads from each state, in the order of STATES; -1 is illegal.
MOVES = {
    "ingest": (PENDING, PENDING, PENDING, PENDING, PENDING),
    "ingest_same": (PENDING, PENDING, OK, PENDING, PENDING),
    "converted": (-1, OK, -1, -1, -1),
    "error": (-1, FAILED, -1, -1, -1),
    "retry": (-1, -1, -1, PENDING, -1),
    "reconvert": (-1, -1, PENDING, PENDING, -1),
    "retract": (-1, RETRACTED, RETRACTED, RETRACTED, -1),
    "forget": (-1, NONE, NONE, NONE, NONE),
}
#: Commands of one document in a block.
BLOCK = 4096


def _moves(action: Column) -> Column:
    """Array of the five places that an action leads to; an unknown one is illegal everywhere."""
    table = F.create_map(*[x for a, to in MOVES.items() for x in (F.lit(a), F.array(*map(F.lit, to)))])
    return F.coalesce(F.element_at(table, action), F.array(*[F.lit(-1)] * len(STATES)))


def _step(state: Column, moves: Column) -> Column:
    """The state after a command; an illegal one changes nothing."""
    to = F.get(moves, state)
    return F.when(to < 0, state).otherwise(to)


def prepared(commands: DataFrame, block: int = BLOCK) -> DataFrame:
    """Commands (doc, no, action, sha) with the place in their document, its block, and ``kind``: the action, or
    ``ingest_same`` where the document had these bytes before and was not forgotten since. Numbers don't repeat."""
    own = Window.partitionBy("doc").orderBy("no")
    # bytes are set by an ingest and gone with a forget: both known from the commands alone
    sets = F.when(F.col("action") == "ingest", F.struct(F.col("sha").alias("sha"))).when(F.col("action") == "forget", F.struct(F.lit(None).cast("string").alias("sha")))
    before = F.last(sets, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    c = commands.withColumn("_before", before).withColumn("_at", F.row_number().over(own))
    same = (F.col("action") == "ingest") & F.col("_before.sha").isNotNull() & (F.col("_before.sha") == F.col("sha"))
    return c.withColumn("kind", F.when(same, "ingest_same").otherwise(F.col("action"))).withColumn("block", F.floor((F.col("_at") - 1) / block)).drop("_before", "_at")


def _entries(maps: DataFrame, size: int = 256) -> DataFrame:
    """(doc, block, entry): the state that each block is entered with, from the functions ``f`` of a document's blocks.

    Functions are composed in runs of ``size`` blocks first, and the runs' functions in order; no list is longer than a run,
    or than the number of runs.
    """
    m = maps.withColumn("run", F.floor(F.col("block") / size))
    follow = lambda lists, state: F.aggregate(lists, state, lambda s, f: F.get(f, s))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "f"))), lambda x: x["f"])
    start = F.array(*[F.lit(i) for i in range(len(STATES))])
    runs = m.groupBy("doc", "run").agg(ordered.alias("fs")).select("doc", "run", F.aggregate("fs", start, lambda g, f: F.transform(g, lambda s: F.get(f, s))).alias("f"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("earlier", F.collect_list("f").over(earlier("doc").orderBy("run"))).select("doc", "run", follow("earlier", F.lit(NONE)).alias("start"))
    within = m.withColumn("earlier", F.collect_list("f").over(earlier("doc", "run").orderBy("block")))
    return within.join(runs, ["doc", "run"]).select("doc", "block", follow("earlier", F.col("start")).alias("entry"))


def folded(commands: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each command (doc, no, action, sha) with the state ``before`` and ``after`` it, and whether it was ``legal``.

    A null document is no document: its commands are illegal and stay as they are.
    """
    c = cut(prepared(commands.where("doc IS NOT NULL"), block), "commands")
    sorted_moves = F.transform(F.sort_array(F.collect_list(F.struct("no", "kind"))), lambda x: _moves(x["kind"]))  # at most ``block``
    blocks = c.groupBy("doc", "block").agg(sorted_moves.alias("moves"))
    start = F.array(*[F.lit(i) for i in range(len(STATES))])
    function = F.aggregate("moves", start, lambda f, m: F.transform(f, lambda s: _step(s, m)))
    maps = blocks.select("doc", "block", function.alias("f"))
    entered = _entries(blocks.select("doc", "block", function.alias("f")))
    lists = c.groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.struct("no", "kind"))).alias("rows")).join(entered, ["doc", "block"])
    none = F.expr("cast(array() as array<struct<no:bigint,before:int,after:int>>)")

    def walk(acc: Column, r: Column) -> Column:
        before = acc["state"]
        after = _step(before, _moves(r["kind"]))
        return F.struct(after.alias("state"), F.concat(acc["seen"], F.array(F.struct(r["no"].cast("bigint").alias("no"), before.alias("before"), after.alias("after")))).alias("seen"))

    seen = F.aggregate("rows", F.struct(F.col("entry").alias("state"), none.alias("seen")), walk, lambda acc: acc["seen"])
    names = F.array(*map(F.lit, STATES))
    walked = lists.select("doc", F.explode(seen).alias("s")).select("doc", F.col("s.no").alias("no"), F.get(names, F.col("s.before")).alias("before"), F.get(names, F.col("s.after")).alias("after"))
    out = c.join(walked, ["doc", "no"])
    legal = F.get(_moves(F.col("kind")), F.array_position(names, F.col("before")).cast("int") - 1) >= 0
    out = out.withColumn("legal", legal)
    lost = commands.where("doc IS NULL").withColumn("kind", F.col("action")).withColumn("block", F.lit(0).cast("bigint")).withColumn("before", F.lit("none")).withColumn("after", F.lit("none")).withColumn("legal", F.lit(False))
    return out.unionByName(lost.select(*out.columns)).drop("block")


def current(done: DataFrame) -> DataFrame:
    """(doc, status, sha, commands, illegal, last_no) of each document after its commands; forgotten ones are gone."""
    moved = F.col("legal")
    return done.where("doc IS NOT NULL").groupBy("doc").agg(
        F.max_by("after", "no").alias("status"),
        F.max_by(F.when(moved & (F.col("action") == "ingest"), F.col("sha")), F.when(moved & (F.col("action") == "ingest"), F.col("no"))).alias("sha"),
        F.count(F.lit(1)).alias("commands"), F.count_if(~moved).alias("illegal"), F.max("no").alias("last_no"),
    ).where("status <> 'none'")


def duplicates(live: DataFrame) -> DataFrame:
    """(doc, duplicate_of): documents of ``current`` whose bytes an earlier live document holds. Retracted ones don't count."""
    own = live.where(F.col("status").isin("pending", "ok") & F.col("sha").isNotNull())
    first = own.groupBy("sha").agg(F.min(F.struct("last_no", "doc")).alias("first"))
    return own.join(first.select("sha", F.col("first.doc").alias("duplicate_of")), "sha").where("doc <> duplicate_of").select("doc", "duplicate_of")


def to_retry(done: DataFrame, live: DataFrame, most: int = 3) -> DataFrame:
    """(doc, failures, next_no): failed documents that failed fewer than ``most`` times since they were last ok, with the
    number of the retry, in the order of their failures."""
    failed = live.where("status = 'failed'").select("doc")
    own = done.join(failed, "doc", "left_semi").where(F.col("legal"))
    good = own.groupBy("doc").agg(F.coalesce(F.max(F.when(F.col("after") == "ok", F.col("no"))), F.lit(-1)).alias("good"))
    counts = own.join(good, "doc").where((F.col("action") == "error") & (F.col("no") > F.col("good"))).groupBy("doc").agg(F.count(F.lit(1)).alias("failures"), F.max("no").alias("failed_at"))
    few = counts.where(F.col("failures") < most)
    return number_rows(few.withColumn("_place", F.struct("failed_at", "doc")), "_place", "next_no").drop("_place", "failed_at")
