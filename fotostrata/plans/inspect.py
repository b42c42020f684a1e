"""What is known about each file: every source, the decisions, and how good their evidence is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotostrata.functions import paths
from fotostrata.operators import location, review
from fotostrata.operators.rules import Rule, apply_rules
from fotostrata.plans.organize import read_media, resolve_dates, textual_places, with_facts
from fotostrata.session import materialise
from fotostrata.sources.heif import audits


def inspect_files(spark: SparkSession, source: str, policy: str = "precedence", heuristics: bool = True, rules: list[Rule] | None = None, priority: str = "highest", recursive: bool = True, heif=None) -> DataFrame:
    """One row per image: sources, date decision with its candidates, place decision, RAW and HEIF audit."""
    media, _ = read_media(spark, source, recursive, heif)
    media = materialise(apply_rules(with_facts(media), rules or [], priority), "inspect")
    dated = resolve_dates(media, policy, heuristics)
    rows = media.join(dated, "path", "left").join(textual_places(media), "path", "left")
    filled = lambda m: F.map_filter(m, lambda _, v: F.coalesce(v, F.lit("")) != "")
    status = F.when(F.col("selected").isNotNull(), "resolved").otherwise("missing")
    place_status = F.when(F.col("coordinates").isNotNull(), "gps").when(F.col("inferred").isNotNull(), "inferred").otherwise("missing")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for n, c in (("make", "make"), ("model", "model"), ("datetime", "selected"), ("gps", "coordinates"))]))
    raw = F.when(paths.is_raw(F.col("ext")), F.struct(
        paths.raw_format(F.col("ext")).alias("format"), paths.raw_flow(F.col("ext")).alias("flow"), missing.alias("missing"), F.when(F.size(missing) == 0, "supported").otherwise("partial").alias("status"), F.col("warnings").alias("warnings"),
    ))
    has = lambda c: F.size(filled(c)) > 0
    parts = [("EXIF", has("exif")), ("XMP embedded", has("xmp")), ("XMP sidecar", has("xmp_sidecar")), ("HEIF container", F.col("container.status").isin("supported", "complex"))]
    some = lambda there: F.array_compact(F.array(*[F.when(c if there else ~c, F.lit(n)) for n, c in parts]))
    rows = rows.join(audits(media, heif), "path", "left")
    audit = F.when(F.col("container").isNotNull(), F.struct(F.lit("HEIF/HEIC").alias("format"), F.col("ext").alias("extension"), "container", some(True).alias("found"), some(False).alias("missing")))
    return rows.select(
        F.col("path").alias("source"),
        F.struct(filled("exif").alias("exif"), filled("xmp").alias("xmp"), filled("xmp_sidecar").alias("xmp_sidecar"), filled("iptc").alias("iptc"), filled("png").alias("png")).alias("sources"),
        status.alias("date_status"), F.col("selected.value").alias("date_value"), F.col("selected.source").alias("date_source"), F.col("selected.field").alias("date_field"), F.col("selected.confidence").alias("date_confidence"),
        F.col("selected.used_fallback").alias("date_fallback"), F.coalesce("conflict", F.lit(False)).alias("date_conflict"), F.col("reason").alias("date_reason"), "candidates",
        review.date_evidence(status, F.col("selected.source"), F.col("selected.used_fallback")).alias("date_evidence"),
        place_status.alias("location_status"), "coordinates", F.when(F.col("coordinates").isNull(), F.col("inferred")).alias("location"), location.location_text(F.col("inferred"), F.col("coordinates")).alias("location_text"),
        review.location_evidence(place_status, F.lit(None).cast("string"), F.col("coordinates.latitude")).alias("location_evidence"),
        F.nullif(F.concat_ws(" ", "make", "model"), F.lit("")).alias("camera_profile"), raw.alias("raw"), audit.alias("heif"), "correction", "warnings",
    )


def inspect_summary(items: DataFrame) -> DataFrame:
    """One row: files inspected, dates and places resolved, date conflicts."""
    return items.agg(
        F.count(F.lit(1)).alias("inspected_files"), F.count_if(F.col("date_status") == "resolved").alias("date_resolved"),
        F.count_if(F.col("location_status") != "missing").alias("location_resolved"), F.count_if("date_conflict").alias("date_conflicts"),
    )


def explain_items(items: DataFrame) -> DataFrame:
    """Decision, candidates and sources of each file, nested for a JSON report."""
    return items.select(
        "source",
        F.struct("date_status", "date_value", "date_source", "date_field", "date_confidence", "date_reason", "date_conflict", "date_evidence").alias("date_decision"), "candidates",
        F.struct("location_status", "location_text", "location_evidence").alias("location_decision"), "sources",
    )


def audit_items(items: DataFrame) -> DataFrame:
    """RAW and HEIF files with what was found in them and how good the evidence of date and place is."""
    audited = items.where(F.col("raw").isNotNull() | F.col("heif").isNotNull())
    return audited.select("source", "raw", "heif", F.struct("date_evidence", "date_source", "date_field", "date_value").alias("date"), F.struct("location_evidence", "location_text", "coordinates").alias("location"), "warnings")
