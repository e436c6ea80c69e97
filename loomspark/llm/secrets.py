"""Secret scan: patterns plus a log-likelihood ratio of two character Markov models, in SQL functions only.

Base findings come from three patterns. The method adds tokens that the model of random strings explains better than
the model of ordinary identifiers. Both are first-order Markov chains over the characters of a token, trained from
labelled samples: label 1, strings drawn from a hash (base-64 and hexadecimal alphabets); label 0, words of a bounded
sample of documents and identifiers joined from them (snake case, camel case, numbered). What is learned is a table
of 66 x 66 log ratios.

Positions are code points.

Edge cases: null and empty texts have no span; spans of one start are ordered by kind; an added span that overlaps a
base span is dropped; repeated rows are scanned one by one; a corpus without words leaves the chain for identifiers
with its prior, trained on a fixed list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SEED_WORDS = "get set user name value list index count file path read write open close config default request response server client session message handler manager factory service controller item data table column row key cache buffer stream parse format print error result state event update delete insert create".split()
#: Samples of each label, and the share of documents is chosen so that about this many give words.
N_SAMPLES, N_DOCS = 20_000, 2_000
THRESHOLD, PER_CHAR = 12.0, 0.45
_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: (pattern, characters that the group needs, group) of each kind; a hex match is the maximal run that passes.
RULES = ((ASSIGN, 6, 2), (ACCESS, 20, 0), (r"[0-9a-f]{24,}", 24, 0), (TOKEN, 16, 0))
#: Running folds work in blocks of 64 values: 2**6.
_BLOCK = 6


def _folded(a: Column, zero: Column, step) -> Column:
    """The fold of each block of an array (null for an empty one)."""
    blocks = F.sequence(F.lit(0), F.shiftright(F.size(a) - 1, _BLOCK))
    fold = lambda b: F.aggregate(F.slice(a, F.shiftleft(b, _BLOCK) + 1, F.lit(1 << _BLOCK)), zero, step)
    return F.when(F.size(a) > 0, F.transform(blocks, fold))


def running(df: DataFrame, names: list[str], zero: Column, step) -> tuple[DataFrame, list]:
    """For columns ``names`` of arrays, functions from an index to the fold of all values up to it.

    Folds of blocks, and of blocks of blocks, are columns of their own (the returned frame has them), so that a call
    reads some 64 values and what the functions are used on costs in proportion to the length of the array.
    """
    df = df.select("*", *[_folded(F.col(n), zero, step).alias(f"{n}1") for n in names])
    df = df.select("*", *[_folded(F.col(f"{n}1"), zero, step).alias(f"{n}2") for n in names])
    low = (1 << _BLOCK) - 1

    def at(n: str):
        def fold(i: Column) -> Column:
            block, far = F.shiftright(i, _BLOCK), F.shiftright(i, 2 * _BLOCK)
            # the last column is read twice: what is read once, the optimiser would move into the lambda of the caller
            x = F.when(F.col(f"{n}2").isNotNull(), F.aggregate(F.slice(f"{n}2", F.lit(1), far), zero, step))
            x = F.aggregate(F.slice(f"{n}1", F.shiftleft(far, _BLOCK) + 1, block.bitwiseAND(low)), x, step)
            return F.aggregate(F.slice(n, F.shiftleft(block, _BLOCK) + 1, i.bitwiseAND(low) + 1), x, step)

        return fold

    return df, [at(n) for n in names]


def spans(df: DataFrame, text: str, kinds: list[int]) -> DataFrame:
    """``df`` plus, for each kind, the columns ``m<kind>`` (its matches) and ``s<kind>`` (their array<struct<start, kind, end>>).

    Java's ``split`` and ``regexp_extract_all`` walk the same matches: a match starts where the gaps and matches before it
    end. Every array is a column before a lambda reads it, so that none is computed again for each match.
    """
    t = F.col(text)
    gate = lambda k: t.rlike(RULES[k][0])
    none = F.array().cast("array<string>")
    df = df.select("*", *[F.when(gate(k), F.regexp_extract_all(t, F.lit(RULES[k][0]), F.lit(0))).otherwise(none).alias(f"m{k}") for k in kinds])
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    hops = lambda k: F.zip_with(lengths(F.split(t, RULES[k][0], -1)), F.concat(F.array(F.lit(0)), lengths(F.col(f"m{k}"))), lambda gap, match: gap + match)
    groups = [k for k in kinds if RULES[k][2]]
    df = df.select(
        "*",
        *[F.when(F.size(f"m{k}") > 0, hops(k)).alias(f"h{k}") for k in kinds],
        *[F.when(F.size(f"m{k}") > 0, lengths(F.regexp_extract_all(t, F.lit(RULES[k][0]), F.lit(RULES[k][2])))).alias(f"g{k}") for k in groups],
    )
    df, start = running(df, [f"h{k}" for k in kinds], F.lit(0), lambda x, y: x + y)
    def located(k: int, first):
        chars = lambda i, m: F.get(f"g{k}", i) if k in groups else F.length(m)
        return F.transform(f"m{k}", lambda m, i: F.struct(first(i).alias("start"), F.length(m).alias("n"), chars(i, m).alias("g")))

    def passing(k: int) -> Column:
        some = F.filter(f"f{k}", lambda x: x["g"] >= RULES[k][1])
        return F.transform(some, lambda x: F.struct(x["start"], F.lit(k).alias("kind"), (x["start"] + x["n"]).alias("end")))

    df = df.select("*", *[F.when(F.size(f"m{k}") > 0, located(k, first)).alias(f"f{k}") for k, first in zip(kinds, start, strict=True)])
    df = df.select("*", *[F.coalesce(passing(k), F.array().cast(_SPAN)).alias(f"s{k}") for k in kinds])
    return df


def labelled(docs: DataFrame, text_col: str = "text", n_samples: int = N_SAMPLES, n_docs: int = N_DOCS) -> DataFrame:
    """(token, random): the labelled samples."""
    spark = docs.sparkSession
    ids = spark.range(n_samples)
    digest = F.sha2(F.concat(F.lit("random sample "), F.col("id")), 256)
    b64 = F.regexp_replace(F.substring(F.base64(F.unhex(digest)), 1, 40), "=", "A")
    strong = ids.select(F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, b64).otherwise(F.regexp_replace(b64, "[+/]", "7")).alias("token"), F.lit(1).alias("random"))
    n = max(1, docs.count())
    sampled = docs.where(F.pmod(F.xxhash64(F.lit(3), text_col), F.lit(max(1, n // n_docs))) == 0)
    words = sampled.select(F.explode(F.split(F.coalesce(text_col, F.lit("")), "[^A-Za-z]+")).alias("w")).where(F.length("w").between(2, 24)).groupBy("w").count()
    fixed = spark.createDataFrame([(w,) for w in SEED_WORDS], "w string")
    pool = words.select("w").union(fixed)
    h = F.xxhash64(F.lit(9), "w")
    numbered = F.concat("w", F.when(F.pmod(h, F.lit(4)) == 0, F.pmod(F.shiftright(h, 8), F.lit(100)).cast("string")).otherwise(F.lit("")))
    shaped = F.when(F.pmod(h, F.lit(5)) == 0, F.concat(F.lower("w"), F.lit("_"), F.lower(numbered))).when(F.pmod(h, F.lit(5)) == 1, F.concat(F.lower("w"), F.initcap("w"))).when(F.pmod(h, F.lit(5)) == 2, F.concat(F.lower("w"), F.lit("-"), numbered)).when(F.pmod(h, F.lit(5)) == 3, F.concat(F.upper("w"), F.lit("/"), F.lower("w"))).otherwise(numbered)
    return strong.union(pool.select(shaped.alias("token"), F.lit(0).alias("random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log ratios of the two chains' transitions, row by row of the alphabet's index (0: another character)."""
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    pairs = samples.where(F.length("token") >= 2).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.struct(code(F.substring("token", i, F.lit(1))).alias("a"), code(F.substring("token", i + 1, F.lit(1))).alias("b")))).alias("p"))
    counts = pairs.groupBy("random", "p.a", "p.b").count().collect()  # at most 2 x 66 x 66 rows
    k = len(ALPHABET) + 1
    n = [[[smoothing] * k for _ in range(k)] for _ in range(2)]
    for r in counts:
        n[r["random"]][r["a"]][r["b"]] += r["count"]
    return [math.log(n[1][a][b] / sum(n[1][a])) - math.log(n[0][a][b] / sum(n[0][a])) for a in range(k) for b in range(k)]


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token: random against ordinary."""
    k = len(ALPHABET) + 1
    values = F.split(F.lit(",".join(f"{v:.4f}" for v in table)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(state: Column, c: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), c)
        return F.struct(code.alias("last"), F.when(state["last"] < 0, F.lit(0.0)).otherwise(state["sum"] + F.get(values, state["last"] * k + code)).alias("sum"))

    return F.aggregate(F.slice(F.split(token, ""), F.lit(1), F.length(token)), start, step, lambda s: s["sum"])


def is_random(token: Column, table: list[float]) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    least = F.greatest(F.lit(THRESHOLD), PER_CHAR * F.length(token))
    return mixed & (ratio(token, table) >= least)


def findings(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): sorted arrays of struct<start, kind (index into KINDS), end>.

    The time per text grows in proportion to its length and number of matches.
    """
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = spans(df, "t", [0, 1, 2, 3])
    # m3 and s3 run side by side: every match of TOKEN is long enough; one that holds a base finding isn't judged
    judged = F.filter(F.zip_with("s3", F.transform("m3", lambda m: ~m.rlike("[0-9a-f]{24}|AKIA[A-Z0-9]{16}") & is_random(m, table)), lambda s, ok: F.when(ok, s)), lambda s: s.isNotNull())
    df = df.select("id", F.sort_array(F.concat("s0", "s1", "s2")).alias("base"), F.when(F.size("m3") > 0, judged).alias("more"))
    # in order of start, an added span is clear of all base spans if those before it end in time and its right
    # neighbour begins in time (added spans are disjoint, so a neighbour that begins inside is a base span)
    df = df.select("id", "base", F.when(F.size("more") > 0, F.sort_array(F.concat("base", "more"))).alias("o"))
    df = df.select("*", F.transform("o", lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0))).alias("e"))
    df, (reach,) = running(df, ["e"], F.lit(0), lambda x, y: F.greatest(x, y))
    clear = lambda s, i: (s["kind"] == 3) & (reach(i) <= s["start"]) & F.coalesce(F.get("o", i + 1)["start"] >= s["end"], F.lit(True))
    added = F.coalesce(F.filter("o", clear), F.array().cast(_SPAN)).alias("added")
    # a caller's filter on the findings stays above the generator; pushed below, it would repeat the search
    return df.select("id", F.inline(F.array(F.struct("base", added))))


def spelled(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def model(docs: DataFrame) -> list[float]:
    return train(labelled(docs))


def op7_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of the whole table."""
    found = findings(docs, model(docs))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.sort_array(F.concat("base", "added"))).alias("spans"))
