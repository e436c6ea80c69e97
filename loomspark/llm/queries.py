"""One query for each operator of this subpackage, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, decontam, hilbert, html, license, mixing, quality, secrets, simhash, suffix, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontam": lambda s, d: decontam.op1_decontam(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_hilbert": lambda s, d: hilbert.op2_hilbert(table(s, d, "documents")),
        "op3_toxicity": lambda s, d: toxicity.op3_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op4_suffix": lambda s, d: suffix.op4_suffix(table(s, d, "documents")),
        "op5_html": lambda s, d: html.op5_html(table(s, d, "pages")),
        "op6_mixing": lambda s, d: mixing.op6_mixing(table(s, d, "documents")),
        "op7_secrets": lambda s, d: secrets.op7_secrets(table(s, d, "documents")),
        "op8_simhash": lambda s, d: simhash.op8_simhash(table(s, d, "documents")),
        "op9_license": lambda s, d: license.op9_license(table(s, d, "documents")),
        "op10_quality": lambda s, d: quality.op10_quality(table(s, d, "documents")),
        "op11_chat": lambda s, d: chat.op11_chat(table(s, d, "conversations")),
        "op12_align": lambda s, d: align.op12_align(table(s, d, "documents")),
        "op13_whitening": lambda s, d: whitening.op13_whitening(table(s, d, "embeddings")),
    }


def _license_sql() -> str:
    rows = ", ".join(f"('{n}', {i}, [{', '.join(repr(x) for x in b)}])" for n, i, b in license.flat_templates())
    t = license.THRESHOLD
    return f"""
    WITH t(license, template_no, t) AS (VALUES {rows}),
    d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l, regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n') AS p FROM documents),
    u AS (
      SELECT doc_id, 'line' AS k, unnest(range(len(l))) AS no, unnest(l) AS x FROM d
      UNION ALL SELECT doc_id, 'paragraph', unnest(range(len(p))), unnest(p) FROM d WHERE len(p) > 1
      UNION ALL SELECT doc_id, 'text', 0, text FROM d WHERE len(l) > 1),
    w AS (SELECT doc_id, k, no, string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u WHERE length(x) >= 3),
    b AS (SELECT doc_id, k, no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) >= 2),
    m AS (
      SELECT doc_id, k, no, license, 2.0 * len(list_intersect(b, t)) / (len(b) + len(t)) AS dice
      FROM b JOIN t ON len(b) BETWEEN len(t) * {t / (2 - t)} AND len(t) * {(2 - t) / t})
    SELECT doc_id, license, count(DISTINCT (k, no)) AS n_units, round(max(dice), 6) AS best_dice, CAST(min(CASE WHEN k = 'line' THEN no END) AS BIGINT) AS first_line
    FROM m WHERE dice >= {t} GROUP BY doc_id, license
    """


def oracle_sql() -> dict[str, str]:
    return {"op9_license": _license_sql()}
