"""Line-first cleaning, in SQL functions only.

Every line is judged by punctuation, navigation and boilerplate rules; lines that fail are removed; a document that
loses more than ``max_loss`` of its characters is rejected, as is one that fails the base rules on its words.

Edge cases: a null text has no words and fails the base rules; empty lines are neither kept nor counted as lost;
repeated rows are judged one by one; a column of ``docs`` named like a result is left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
_TERMINAL = r"[.!?…。！？:;,\"'”’»)\]]\s*$"
#: Separators of navigation lines; a line with two of them is one. Fixed values.
_SEPARATORS = (" | ", " » ", " › ", " • ", " · ", " > ")
_BOILERPLATE = r"(?i)\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|javascript is (?:disabled|required)|subscribe to (?:our|the) newsletter|sign up for our|click here to|share (?:this|on) (?:facebook|twitter)|log ?in to (?:comment|continue)|skip to (?:main )?content|lorem ipsum)\b"


def word_list(text: Column) -> Column:
    """The words of a text: split at the runs between them, after trimming the ends."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def line_fails(line: Column, boilerplate_share: float = 0.1) -> Column:
    """One of the three kinds of line rules.

    Punctuation: more than one symbol in 20 characters, or under three words without an end mark. Navigation: two
    separators of one kind. Boilerplate: its phrases make up ``boilerplate_share`` of the line or more, so that a long line
    of prose may quote one.
    """
    chars = F.greatest(F.length(line), F.lit(1))
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    punctuation = (symbols * 20 > chars) | (~line.rlike(_TERMINAL) & ~line.rlike(r"\S+\s+\S+\s+\S+"))
    navigation = F.lit(False)
    for x in _SEPARATORS:
        navigation |= F.length(line) - F.length(F.replace(line, F.lit(x), F.lit(""))) >= 2 * len(x)
    phrases = F.length(line) - F.length(F.regexp_replace(line, _BOILERPLATE, ""))
    return punctuation | navigation | (line.rlike(_BOILERPLATE) & (phrases >= boilerplate_share * chars))


def cleaned_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~line_fails(x))


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The base measures of each row, and its lines with a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), word_list(F.col(text_col)).alias("_w"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n = F.size("_w")
    windows = F.when(n >= 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice("_w", i, 8)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("*", n.cast("bigint").alias("n_words"), F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"), (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"), lines.alias("_lines"), windows.alias("_h")).drop("_w")
    df = df.select("*", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"), (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_again"))
    # windows that occur twice: neighbours once (hash, place) are sorted
    ordered = F.when(F.col("_again"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.select("*", ordered.alias("_o")).drop("_h")
    same = lambda x, j: F.coalesce(F.get("_o", j)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_o", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    df = df.select("*", F.when(F.col("_again"), places).alias("_p")).drop("_o")
    gaps = F.zip_with(F.slice("_p", 2, F.size("_p")), F.slice("_p", 1, F.size("_p") - 1), lambda b, a: F.least(F.lit(8), b - a))
    covered = F.when(F.col("_again"), F.aggregate(gaps, F.lit(8), lambda s, x: s + x)).otherwise(F.lit(0))
    return df.select("*", covered.cast("bigint").alias("n_repeat_words")).drop("_p", "_again")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = 0.5) -> DataFrame:
    """id, the measures, base_failed, cleaned (the lines kept, joined), lost (share of characters), kept."""
    df = measured(docs, id_col, text_col)
    chars = lambda a: F.length(F.array_join(a, ""))
    df = df.select("*", cleaned_lines(F.col("_lines")).alias("_ok"), chars("_lines").alias("_all"), F.size("_lines").alias("n_lines"))
    df = df.select("*", F.array_join("_ok", "\n").alias("cleaned"), (1.0 - chars("_ok") / F.greatest(F.col("_all"), F.lit(1))).alias("lost"), F.size("_ok").alias("n_kept_lines"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("lost") <= max_loss)
    df = df.withColumn("kept", kept)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_kept_lines", "lost", "kept"]
    # a filter on a result stays above the generator; pushed below, it would repeat the sort of all windows for each window
    out = df.select(F.col("_id").alias(id_col), "cleaned", F.inline(F.array(F.struct(*names))))
    return out.select(id_col, *names[:-1], "cleaned", "kept")


def op10_quality(docs: DataFrame) -> DataFrame:
    """The measures and verdicts of the whole table."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
