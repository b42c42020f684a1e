"""Review flags, reasons, and the one-row summaries of a plan or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ("REVIEW_BURST", "REVIEW_CONFLICT", "REVIEW_DATE", "REVIEW_DUPLICATE", "REVIEW_LOCATION")
#: Location statuses that ask for a review.
UNSURE_PLACES = ("missing-gps", "inferred", "unknown-location", "error", "disabled")
#: The sentences of review reports.
REASONS = {"REVIEW_DATE": "date is inferred, fallback, or conflicting", "REVIEW_LOCATION": "location status is ", "REVIEW_DUPLICATE": "duplicate file decision needed", "REVIEW_BURST": "burst candidate decision needed", "REVIEW_CONFLICT": "destination conflict"}
SUGGESTIONS = {
    "REVIEW_DATE": "confirm the capture date or add a correction manifest rule",
    "REVIEW_LOCATION": "confirm GPS/location data or add city/state/country metadata",
    "REVIEW_DUPLICATE": "choose the canonical file and decide whether duplicates stay",
    "REVIEW_BURST": "inspect the sequence and keep, group, or discard near-identical shots",
    "REVIEW_CONFLICT": "choose a conflict policy or rename one of the destinations",
}


def review_flags(date_fallback: Column, date_kind: Column, date_conflict: Column, location_status: Column, burst_mark: Column, outcome: Column | None = None, observations: Column | None = None, duplicate: Column | None = None) -> Column:
    """Sorted array of the flags that apply; null inputs raise none."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = [F.when(yes(burst_mark == "REVIEW_BURST"), "REVIEW_BURST")]
    if outcome is not None and observations is not None:
        flags.append(F.when(yes(outcome.isin("skipped", "error") & F.lower(observations).contains("conflict")), "REVIEW_CONFLICT"))
    flags.append(F.when(yes(date_fallback) | yes(date_kind == "inferred") | yes(date_conflict), "REVIEW_DATE"))
    if duplicate is not None:
        flags.append(F.when(yes(duplicate), "REVIEW_DUPLICATE"))
    flags.append(F.when(yes(location_status.isin(*UNSURE_PLACES)), "REVIEW_LOCATION"))
    return F.array_compact(F.array(*flags))


def review_reasons(flags: Column, date_reason: Column, location_status: Column, burst_reason: Column, observations: Column) -> Column:
    """"FLAG: reason" of each flag, joined."""
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return F.array_join(
        F.transform(
            flags,
            lambda f: F.concat(
                f, F.lit(": "),
                F.when(f == "REVIEW_DATE", filled(date_reason, REASONS["REVIEW_DATE"]))
                .when(f == "REVIEW_LOCATION", F.concat(F.lit(REASONS["REVIEW_LOCATION"]), filled(location_status, "unknown")))
                .when(f == "REVIEW_DUPLICATE", F.lit(REASONS["REVIEW_DUPLICATE"]))
                .when(f == "REVIEW_BURST", filled(burst_reason, REASONS["REVIEW_BURST"]))
                .otherwise(filled(observations, REASONS["REVIEW_CONFLICT"])),
            ),
        ),
        "; ",
    )


def review_suggestions(flags: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUGGESTIONS.items() for x in pair])
    return F.array_join(F.transform(flags, lambda f: F.concat(f, F.lit(": "), table[f])), "; ")


def review_summary(rows: DataFrame, flags: str = "review_flags") -> DataFrame:
    """One row: rows with any flag, and rows with each flag, zeros included."""
    has = lambda f: F.count_if(F.coalesce(F.array_contains(flags, f), F.lit(False))).alias(f"{f.lower()}_items")
    return rows.agg(F.count_if(F.coalesce(F.size(flags), F.lit(0)) > 0).alias("review_items"), *[has(f) for f in FLAGS])


def run_summary(plan: DataFrame, mode: str, ignored: int = 0, status: str | None = None) -> DataFrame:
    """One row of counts of a plan (date_fallback, location, coordinates, location_status, organization_fallback) and, with ``status``, its outcome."""
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    outcome = F.col(status) if status else F.lit("planned")
    return plan.agg(
        F.lit(mode).alias("mode"),
        count((outcome != "planned") & ~outcome.isin("error", "skipped"), "processed_files"),
        F.lit(ignored).cast("long").alias("ignored_files"),
        count(outcome == "error", "error_files"),
        count(F.col("date_fallback"), "fallback_files"),
        count(F.col("location").isNotNull(), "location_files"),
        count(F.col("coordinates").isNotNull(), "gps_files"),
        count(F.col("location_status") == "missing-gps", "missing_gps_files"),
        count(F.col("organization_fallback"), "organization_fallback_files"),
    )


def group_summary(plan: DataFrame, window_minutes: int | None = None) -> DataFrame:
    """One row: events of a plan and their window, bursts and the files in them; zeros without any, a null window without events asked for."""
    return plan.agg(
        F.count_distinct("event_id").alias("events"), F.lit(window_minutes).cast("int").alias("event_window_minutes"), F.count_distinct("burst_group_id").alias("burst_groups"), F.count("burst_group_id").alias("burst_files")
    )


def date_evidence(status: Column, source: Column, used_fallback: Column, compat: bool = True) -> Column:
    """missing, inferred-or-fallback or real-metadata; an XMP sidecar counts as real only without ``compat``."""
    real = ["EXIF", "XMP", "IPTC-IIM", "PNG metadata", "Correction manifest", *([] if compat else ["XMP sidecar"])]
    fine = ~F.coalesce(used_fallback, F.lit(False)) & F.coalesce(source.isin(*real), F.lit(False))
    return F.when(F.coalesce(status != "resolved", F.lit(True)), "missing").when(fine, "real-metadata").otherwise("inferred-or-fallback")


def location_evidence(status: Column, kind: Column, latitude: Column) -> Column:
    s, k = F.coalesce(status, F.lit("")), F.coalesce(kind, F.lit(""))
    return (
        F.when(s.isin("resolved", "gps") & latitude.isNotNull(), "real-gps")
        .when((k == "inferred") | (s == "inferred"), "inferred")
        .when(s.isin("missing", "missing-gps", ""), "missing")
        .otherwise(s)
    )


def histogram(files: DataFrame, key: str, size: str, none: str = "<none>") -> DataFrame:
    """(key, n_files, total_bytes) by a key, blanks under ``none``."""
    label = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(none))
    return files.groupBy(label.alias(key)).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce(F.col(size), F.lit(0))).alias("total_bytes"))


def top_entries(counts: DataFrame, label: str, number: str, n: int = 8) -> DataFrame:
    """The n most frequent entries, of equals the first by label."""
    return counts.orderBy(F.desc(number), label).limit(n)


def health(files: DataFrame, gps: Column, conflict: Column, profile: Column) -> DataFrame:
    """One row: how many files have coordinates, an undisputed date and a camera, and the rounded percentages; null percentages without files."""
    total = F.count(F.lit(1))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    parts = {"gps": yes(gps), "timestamp": yes(~F.coalesce(conflict, F.lit(False))), "camera": yes(profile)}
    percent = lambda x: F.when(total > 0, F.bround(100.0 * x / total).cast("long"))
    return files.agg(total.alias("total"), *[x.alias(f"{k}_files") for k, x in parts.items()], *[percent(x).alias(f"{k}_percent") for k, x in parts.items()])


def conflict_total(groups: DataFrame, plan: DataFrame, flags: str = "review_flags", date_conflict: str = "date_conflict") -> DataFrame:
    """One row: duplicate groups, operations with a conflict of destination or date, and their sum."""
    disputed = F.coalesce(F.array_contains(flags, "REVIEW_CONFLICT"), F.lit(False)) | F.coalesce(F.col(date_conflict), F.lit(False))
    none = F.lit(0).cast("long")
    counted = plan.agg(F.count_if(disputed).alias("conflict_operations")).withColumn("duplicate_groups", none)
    both = groups.agg(F.count(F.lit(1)).alias("duplicate_groups")).withColumn("conflict_operations", none).unionByName(counted)
    return both.agg(F.sum("duplicate_groups").alias("duplicate_groups"), F.sum("conflict_operations").alias("conflict_operations")).withColumn(
        "conflicts", F.col("duplicate_groups") + F.col("conflict_operations")
    )


def outcome_of_log(line: Column) -> Column:
    """Struct of a run's log line "[LEVEL] ACTION source -> destination (notes)"; parts that are missing are blank, another line gives null.

    Runs here have typed outcomes; this reads logs written elsewhere. Brackets
    belong to the paths, except for the last " (error: " of an ERROR, the last
    " (conflict: " of a SKIP, and a closing " (note ...)" where there is neither.
    The rest is cut at its first " -> ": a source that holds one itself cannot be
    told from its destination, and ends there.
    """
    part = lambda text, shape, k: F.regexp_extract(text, "(?s)" + shape, k)
    shape = r"^\[([\w-]+)\]\s+(\S+) (.*)\z"
    level, rest = part(line, shape, 1), part(line, shape, 3)
    own = F.when(level == "ERROR", part(rest, r"^.*( \(error: .*)\z", 1)).when(level == "SKIP", part(rest, r"^.*( \(conflict: .*)\z", 1))
    tail = F.coalesce(F.nullif(own, F.lit("")), part(rest, r"^.*( \(note .*\))\z", 1))
    notes = F.regexp_replace(F.regexp_replace(tail, r"^ \((?:error: )?", ""), r"\)\z", "")
    paths = F.substring(rest, F.lit(1), F.length(rest) - F.length(tail))
    arrow = F.instr(paths, " -> ")
    source = F.when(arrow > 0, F.substring(paths, F.lit(1), arrow - 1)).otherwise(paths)
    destination = F.when(arrow > 0, F.substring(paths, arrow + 4, F.length(paths))).otherwise("")
    status = F.when(level == "INFO", "success").when(level == "SKIP", "skipped").otherwise(F.lower(level))
    observations = F.when(level == "DRY-RUN", "simulated; no filesystem changes applied").otherwise(notes)
    return F.when(
        line.rlike("(?s)" + shape),
        F.struct(status.alias("status"), part(line, shape, 2).alias("action"), source.alias("source"), destination.alias("destination"), observations.alias("observations")),
    )
