"""Knowledge pages: manifests, citations, links, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def manifest(memories: DataFrame) -> DataFrame:
    """(id, md5, session) of the memories that pages are made from."""
    usable = memories.where(F.col("status").isin("new", "similar"))
    if "wiki_ignore_at" in memories.columns:
        usable = usable.where(F.col("wiki_ignore_at").isNull())
    return usable.select("id", F.md5("content").alias("md5"), F.concat_ws("/", "source", "conversation_id").alias("session"))


def diff(old: DataFrame, now: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(id, change): added, changed, same or removed; removed is split into missing and reclassified given the ids that exist."""
    o, n = old.select("id", F.col("md5").alias("h0")), now.select("id", F.col("md5").alias("h1"))
    out = o.join(n, "id", "full_outer").select("id", F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed").otherwise("same").alias("change"))
    if existing is None:
        return out
    known = existing.select("id", F.lit(True).alias("_there")).distinct()
    return out.join(known, "id", "left").withColumn("change", F.when((F.col("change") == "removed") & F.col("_there").isNull(), "missing").when(F.col("change") == "removed", "reclassified").otherwise(F.col("change"))).drop("_there")


def dirty_sessions(changes: DataFrame, old: DataFrame, now: DataFrame) -> DataFrame:
    """(session, n, ids) of changes; the old owner of a memory counts. No cap: this is a work list."""
    owner = now.select("id", F.col("session").alias("s1")).join(old.select("id", F.col("session").alias("s0")), "id", "full_outer").select("id", F.coalesce("s0", "s1").alias("session"))
    return changes.where("change <> 'same'").join(owner, "id").groupBy("session").agg(F.count(F.lit(1)).alias("n"))


def cited(pages: DataFrame, text: str = "text") -> DataFrame:
    """(page, id): what each page cites."""
    return pages.select("page", F.explode(T.citations(F.col(text))).alias("id"))


def align(refs: DataFrame, inputs: DataFrame, memories: DataFrame) -> DataFrame:
    """One row: cited, invalid citations, inputs, uncovered inputs, coverage (4 places)."""
    c = refs.select("id").distinct().withColumn("c", F.lit(1))
    i = inputs.select("id").distinct().withColumn("i", F.lit(1))
    m = memories.select("id").distinct().withColumn("m", F.lit(1))
    j = c.join(i, "id", "full_outer").join(m, "id", "left")
    n = lambda cond: F.count_if(cond)
    both = n(F.col("c").isNotNull() & F.col("i").isNotNull())
    out = j.agg(n(F.col("c").isNotNull()).alias("n_cited"), n(F.col("c").isNotNull() & F.col("i").isNull()).alias("n_invalid"), n(F.col("c").isNotNull() & F.col("m").isNull()).alias("n_absent"), n(F.col("i").isNotNull()).alias("n_inputs"), n(F.col("i").isNotNull() & F.col("c").isNull()).alias("n_uncovered"), both.alias("_b"))
    return out.withColumn("coverage", F.round(F.col("_b") / F.greatest(F.col("n_inputs"), F.lit(1)), 4)).drop("_b")


def link_index(keys: DataFrame) -> DataFrame:
    """(key, page) of keys that name exactly one page; the rest are ambiguous and of no use."""
    return keys.groupBy("key").agg(F.count_distinct("page").alias("n"), F.min("page").alias("page")).where("n = 1").select("key", "page")


def page_keys(pages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, page): stem, title and normalised title of each page, and its aliases."""
    names = pages.select("page", F.explode(F.array_distinct(F.array(F.col("stem"), F.col("title"), T.link_key(F.col("title"))))).alias("key"))
    if aliases is not None:
        names = names.unionByName(aliases.select("page", F.col("alias").alias("key")))
    return names.where("key IS NOT NULL AND key <> ''").distinct()


def resolve(links: DataFrame, pages: DataFrame, redirects: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``links`` (page, target) plus ``to`` and ``by``: stem, key, redirect, last segment, normalised name, or unresolved."""
    last = F.regexp_extract("target", r"([^/]+)$", 1)
    stems = pages.select(F.col("stem").alias("key"), F.col("page").alias("to")).groupBy("key").agg(F.min("to").alias("to"))
    keys = link_index(page_keys(pages, aliases)).withColumnRenamed("page", "to")
    moved = redirects.select(F.col("old").alias("key"), F.col("new").alias("page")).join(pages.select("page"), "page", "left_semi").select("key", F.col("page").alias("to"))
    ladder = [("stem", F.col("target"), stems), ("key", F.col("target"), keys), ("redirect", F.col("target"), moved), ("segment", last, stems), ("segment_key", last, keys), ("normalised", T.link_key(F.col("target")), keys)]
    out = links
    for i, (_, key, index) in enumerate(ladder):
        out = out.withColumn(f"_k{i}", key).join(index.select(F.col("key").alias(f"_k{i}"), F.col("to").alias(f"_t{i}")), f"_k{i}", "left")
    by = None
    for i, (name, _, _) in enumerate(ladder):
        by = F.when(F.col(f"_t{i}").isNotNull(), name) if by is None else by.when(F.col(f"_t{i}").isNotNull(), name)
    return out.select(*links.columns, F.coalesce(*[F.col(f"_t{i}") for i in range(len(ladder))]).alias("to"), by.otherwise("unresolved").alias("by"))


def touched_pages(pages: DataFrame, touched: DataFrame) -> DataFrame:
    """Pages (page, from_files) made from any touched file."""
    return pages.select("page", F.explode("from_files").alias("file")).join(touched.select("file").distinct(), "file", "left_semi").select("page").distinct()


def projection_changes(old: DataFrame, now: DataFrame, vectors: DataFrame, columns: tuple[str, ...] = ("text", "title", "domain", "path", "origin", "doc"), scanned: DataFrame | None = None) -> DataFrame:
    """(src_id, change): new, changed (text or any of its data), unembedded, same or gone.

    Given the roots that were ``scanned`` (root), a page that isn't there any more is gone only if its root was among them;
    pages of other roots are kept.
    """
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    have = vectors.select(F.col("src_id").alias("_v")).distinct()
    # vectors are looked up first: after the outer join, all pages that aren't there any more would meet at one null key
    own = now.join(have, F.col("src_id") == F.col("_v"), "left")
    j = old.alias("o").join(own.alias("n"), F.col("o.src_id") == F.col("n.src_id"), "full_outer")
    change = F.when(F.col("o.src_id").isNull(), "new").when(F.col("n.src_id").isNull(), "gone").when(~same, "changed").when(F.col("_v").isNull(), "unembedded").otherwise("same")
    if scanned is None:
        return j.select(F.coalesce("n.src_id", "o.src_id").alias("src_id"), change.alias("change"))
    out = j.select(F.coalesce("n.src_id", "o.src_id").alias("src_id"), F.col("o.root").alias("root"), change.alias("change"))
    seen = scanned.select(F.col("root").alias("_root")).distinct()
    # a row for each scanned root; rows stay where they are, since many pages share a root
    out = out.join(F.broadcast(seen), F.col("root") == F.col("_root"), "left")
    return out.select("src_id", F.when((F.col("change") == "gone") & F.col("_root").isNull(), "kept").otherwise(F.col("change")).alias("change"))


def projected(old: DataFrame, now: DataFrame, changes: DataFrame) -> DataFrame:
    """The projection after ``changes``: rows of ``now`` where they are new, changed, unembedded or the same, and old rows that
    are kept; ``embed`` says which need a vector."""
    c = changes.select("src_id", "change")
    own = now.join(c, "src_id").select(*now.columns, F.col("change").isin("new", "changed", "unembedded").alias("embed"))
    kept = old.join(c.where("change = 'kept'").select("src_id"), "src_id", "left_semi").select(*now.columns, F.lit(False).alias("embed"))
    return own.unionByName(kept)


def skew_verdict(a: Column, b: Column, within: float = 60.0) -> Column:
    return F.when(a.isNull() | b.isNull(), "unknown").when(F.abs(a - b) <= within, "ok").when(a > b, "behind").otherwise("ahead")


def guards(stats: DataFrame) -> DataFrame:
    """(rule, ok) from one row of tasks, degraded, old_pages, new_pages, coverage, incremental."""
    rules = [
        ("degraded", F.coalesce(F.col("degraded") / F.nullif(F.col("tasks"), F.lit(0)), F.lit(0.0)) < 0.5),
        ("collapse", ~(F.col("incremental") & (F.col("old_pages") >= 4) & (F.col("new_pages") < 0.5 * F.col("old_pages")))),
        ("coverage", F.col("incremental") | (F.col("coverage") >= 0.85)),
    ]
    return stats.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), ok.alias("ok")) for n, ok in rules])).alias("r")).select("r.rule", "r.ok")
