"""Content hashes and groups of identical files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotostrata.operators.lookup import skewed_lookup


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes or text, in lower-case hexadecimal digits."""
    return F.sha2(content, 256)


def _shared(files: DataFrame, path: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Known files (path, content_hash), and one row per hash of at least two of them: original, n_files."""
    known = files.where(F.col(digest).isNotNull() & F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(digest).alias("content_hash"))
    return known, known.groupBy("content_hash").agg(F.min("path").alias("original"), F.count(F.lit(1)).alias("n_files")).where("n_files > 1")


def duplicate_groups(files: DataFrame, path: str = "path", digest: str = "hash", list_up_to: int = 0) -> DataFrame:
    """(group_id, content_hash, original, duplicates, n_files) of hashes shared by at least two paths.

    The first path in order is the original; groups are numbered by it. Null
    hashes (files that could not be read) and null paths are in no group.
    duplicates lists the other paths of groups of at most ``list_up_to`` files and
    is null for larger ones, so that no list grows with the data: duplicate_members
    has a row for every file.
    """
    known, shared = _shared(files, path, digest)
    # only the groups are numbered in one task, a row each
    numbered = shared.withColumn("group_id", F.row_number().over(Window.orderBy("original", "content_hash")).cast("long"))
    small = skewed_lookup(known, shared.withColumn("weight", F.col("n_files")), ["content_hash"], "weight").where((F.col("n_files") <= list_up_to) & (F.col("path") != F.col("original")))
    lists = small.groupBy("content_hash").agg(F.array_sort(F.collect_list("path")).alias("duplicates"))
    return numbered.join(lists, "content_hash", "left").select("group_id", "content_hash", "original", "duplicates", "n_files")


def duplicate_members(files: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """(path, content_hash, original, role) of every file that shares its hash; no list of a group is ever built.

    Hashes are counted with map-side combining, and only then joined back, so a
    hash held by a third of all files is no hot key of the aggregation.
    """
    known, shared = _shared(files, path, digest)
    return skewed_lookup(known, shared, ["content_hash"], "n_files").withColumn("role", F.when(F.col("path") == F.col("original"), "original").otherwise("duplicate"))


def duplicate_summary(files: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """One row: groups, duplicates, files in groups; zeros without any."""
    sizes = files.where(F.col(digest).isNotNull() & F.col(path).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files")
    )
