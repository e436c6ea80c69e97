"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets, in SQL functions only.

Every source gets a budget of words. The budget is filled with complete epochs of the source first; the rest is a
weighted sample without replacement: each document draws the key ``-ln(u) / quality`` (``u`` from a hash of its id and
text), documents are sorted by key within their source and taken while the running sum of words fits the rest.

The running sum is computed in three levels so that no source meets in one task: words are first summed by (source,
key bucket), buckets are summed over a source, and only rows of one bucket are sorted together.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, after all others; null
ids and repeated ids draw keys by their text (only rows equal in both tie, in no particular order, which changes no
sum); columns of ``docs`` keep their names and values whatever they are; an empty table gives an empty result; a source of size 0 gets the target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise

#: Key buckets of a source.
BUCKETS = 1024
#: Weights of the sources, by code point, repeated.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: symbols count against a text, as do words of odd length (characters a word outside 3 to 12) and fewer than 20 words."""
    chars = F.coalesce(F.length(text), F.lit(0))
    symbols = chars - F.coalesce(F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0))
    clean = F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(10.0) * symbols / F.greatest(chars, F.lit(1)))
    ordinary = F.when((chars / F.greatest(size, F.lit(1))).between(3, 12), 1.0).otherwise(0.5)
    return clean * ordinary * F.when(size >= 20, 1.0).otherwise(0.5)


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(src, no_src, source_size) plus rank, target: water-filling of the total by weight under ``cap`` times a source's size.

    One row per source; sources are metadata, and their table is sorted in one task.
    """
    rank = Window.orderBy("no_src", F.encode("src", "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(rank)).withColumn("weight", F.element_at(cycle, (F.expr(f"(rank - 1) % {len(weights)}") + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # sources fill up in order of limit / weight; the first that does not has the level of all that remain
    open_ = ranked.withColumn("level", level).withColumn("open", F.col("limit") / F.col("weight") >= F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "rank", "level"))).over(everything)
    return open_.withColumn("final", final["level"]).withColumn("target", F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("final") * F.col("weight")))).select("src", "no_src", "source_size", "weight", "target")


def _draw(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights=WEIGHTS, cap: float = 3.0, seed: int = 7) -> DataFrame:
    """(id, h, size, src, no_src, source_size, target, times): how often the mix takes each row of ``docs``; ``h`` is a hash of id and text."""
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.col(source_col).isNull().alias("no_src"),
        n_words(F.col(text_col)).alias("size"), F.col(text_col).alias("text"), _draw(id_col, text_col, seed).alias("h"), *([] if quality is None else [quality.cast("double").alias("q")]),
    )
    if quality is None:
        base = base.withColumn("q", text_quality(F.col("text"), F.col("size")))
    u = (F.shiftrightunsigned(F.col("h"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    key = -F.log(u) / F.greatest(F.coalesce(F.col("q"), F.lit(0.0)), F.lit(1e-6))
    base = base.withColumn("key", key).withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.lit(BUCKETS) * F.col("key") / (1.0 + F.col("key"))).cast("int"))).select("id", "h", "size", "src", "no_src", "key", "bucket")
    base = materialise(base, "mix")
    group = ["src", "no_src", "bucket"]
    sums = base.groupBy(*group).agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("src", "no_src").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    order = Window.partitionBy("src", "no_src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(order), F.lit(0))).join(targets, ["src", "no_src"])
    starts = starts.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("bigint"))
    starts = starts.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy(*group).orderBy("key", "id", "h").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.join(starts, group).withColumn("upto", F.col("start") + F.sum("size").over(running))
    # the document in which the rest ends is taken if more than half of it fits
    times = F.col("epochs") + F.when((F.col("size") > 0) & (F.col("upto") - F.col("size") / 2.0 <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)
    capped = F.least(times, F.lit(int(cap)))
    return rows.select("id", "h", "size", "src", "no_src", "source_size", "target", F.when(F.col("size") > 0, capped).otherwise(0).cast("bigint").alias("times"))


def op6_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of the whole table."""
    return mix(docs).select(F.col("id").alias("doc_id"), "size", F.col("source_size").cast("bigint"), F.col("target").cast("double"), (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Of rows equal in id and text, each takes their largest number."""
    key, times, n = (fresh(docs, stem) for stem in ("mix_key", "mix_times", "mix_n"))
    plan = mix(docs, id_col, text_col, seed=seed, **options).where("times > 0").groupBy(F.col("h").alias(key)).agg(F.max("times").cast("int").alias(times))
    rows = docs.withColumn(key, _draw(id_col, text_col, seed)).join(plan, key)
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
