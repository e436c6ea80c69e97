"""External documents: formats, registry, converters' common rules, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

#: Folders, file names and extensions of credentials. Fixed values.
SECRET_FOLDERS = (".ssh", ".aws", ".gnupg", ".kube", ".docker", ".config/gcloud", "appdata/roaming/microsoft/credentials", "appdata/local/microsoft/credentials")
SECRET_NAMES = ("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "kubeconfig", "credentials", ".netrc", ".pgpass", ".env")
SECRET_EXTENSIONS = ("pem", "key", "p12", "pfx")
STATUSES = ("pending", "ok", "failed", "retracted")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def sensitive(path: Column) -> Column:
    """folder, name or extension where a path looks like a credential's, else null. Only the path is looked at."""
    low = F.lower(F.translate(path, "\\", "/"))
    name = F.substring_index(low, "/", -1)
    folder = F.lit(False)
    for x in SECRET_FOLDERS:
        folder |= F.contains(F.concat(low, F.lit("/")), F.lit(f"/{x}/"))
    named = F.lit(False)
    for x in SECRET_NAMES:
        named |= (name == x) | name.startswith(f"{x}.")
    return F.when(folder, "folder").when(named, "name").when(extension(path).isin(*SECRET_EXTENSIONS), "extension")


def allowed(ext: Column, override: list[str] | None, config: list[str] | None, registry: list[str]) -> Column:
    """Override before configuration before registry; the first that is set decides."""
    return ext.isin(*(override if override is not None else config if config is not None else registry))


def doc_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def low_quality(quality: Column, warnings: Column) -> Column:
    return (quality < 0.5) | (F.size(F.coalesce(warnings, F.array())) > 0)


def html_quality(markdown_chars: Column, visible: Column, failed_images: Column, shell: Column, rescued: Column) -> Column:
    ratio = markdown_chars / F.greatest(visible, F.lit(1))
    q = F.when(ratio >= 0.5, 1.0).otherwise(V.clamp(ratio / 0.5, 0.3, 1.0))
    q = F.when(failed_images, F.least(q, F.lit(0.7))).otherwise(q)
    return F.when(shell & rescued, F.least(q, F.lit(0.9))).when(shell, F.least(q, F.lit(0.4))).otherwise(q)


def pdf_route(encrypted: Column, openable: Column, pages: Column, chars: Column, tables: Column) -> Column:
    return F.when(encrypted & ~openable, "encrypted").when((pages == 0) | (chars / F.greatest(pages, F.lit(1)) < 50), "scanned").when(tables > 0, "table").otherwise("text")


def js_rendered(html: Column, text_chars: Column) -> Column:
    return (F.octet_length(html) >= 20_000) & (text_chars / F.greatest(F.octet_length(html), F.lit(1)) < 0.03)


def scan_targets(files: DataFrame, exts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files (path, length) of the allowed extensions, and counts by extension of all."""
    e = files.withColumn("ext", extension(F.col("path")))
    return e.where(F.col("ext").isin(*exts)), e.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def register(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of each incoming document (doc_id, sha256, source_ref): duplicate, replaces (same source, new bytes), restored or new."""
    by_sha = existing.groupBy("sha256").agg(F.bool_and(F.col("status") == "retracted").alias("_gone"))
    by_ref = existing.where("source_ref IS NOT NULL AND status <> 'retracted'").select("source_ref", F.col("sha256").alias("_sha")).groupBy("source_ref").agg(F.max("_sha").alias("_sha"))
    j = incoming.dropDuplicates(["sha256"]).join(by_sha, "sha256", "left").join(by_ref, "source_ref", "left")
    return j.withColumn("outcome", F.when(F.col("_gone"), "restored").when(F.col("_gone").isNotNull(), "duplicate").when(F.col("_sha").isNotNull() & (F.col("_sha") != F.col("sha256")), "replaces").otherwise("new")).drop("_gone", "_sha")


def lint(materials: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """(level, rule, doc_id): inconsistencies between registry, stored files and projected units."""
    have = files.select("path").distinct().withColumn("_f", F.lit(1))
    unit = units.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("_u", F.lit(1))
    ok = materials.where("status = 'ok'").join(have, materials["raw_path"] == have["path"], "left").join(unit, "doc_id", "full_outer")
    rules = [
        ("P0", "raw_missing", F.col("sha256").isNotNull() & F.col("_f").isNull()),
        ("P0", "unit_without_material", F.col("sha256").isNull() & F.col("_u").isNotNull()),
        ("P1", "not_projected", F.col("sha256").isNotNull() & F.col("_u").isNull()),
        ("P1", "low_quality", F.coalesce(low_quality(F.col("quality"), F.col("warnings")), F.lit(False))),
        ("P1", "junk_title", F.col("sha256").isNotNull() & T.is_blank(F.col("title"))),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("rule"), c.alias("hit")) for a, b, c in rules]), lambda r: r["hit"])
    return ok.select("doc_id", F.explode(found).alias("r")).select("r.level", "r.rule", "doc_id")


def render_page(title: Column, body: Column, doc: Column, day: Column) -> Column:
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\ndoc: "), doc, F.lit("\ndate: "), day.cast("string"), F.lit("\norigin: external\n---\n\n"), body)
