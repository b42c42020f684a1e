"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotostrata.llm.canonical import map_to_canonical
from fotostrata.llm.garbled import restore_garbled
from fotostrata.llm.history import deduplicate, near_files
from fotostrata.llm.packing import pack_documents
from fotostrata.llm.quality import STATS, judge_documents
from fotostrata.llm.tokens import decode_corpus, encode_corpus, token_counts
from fotostrata.session import materialise, one_per_id, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accepted_op_id, op_id: operations of new batches whose file came before, with the first operation of that file."""
    ops = table(spark, sf_dir, "file_operations").select("op_id", "batch_id", "source", "content_hash")
    groups = table(spark, sf_dir, "duplicate_groups").select("content_hash", "original", "duplicates")
    return deduplicate(ops, table(spark, sf_dir, "import_batches"), groups)


def p1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op_id, near_op_id, distance2: for every operation whose id 50 divides, the nearest other path among all earlier operations."""
    return near_files(table(spark, sf_dir, "file_operations"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, record_id, place_id: the canonical place each odd city, country and state means, -1 if none."""
    rules = table(spark, sf_dir, "correction_rules")
    places = table(spark, sf_dir, "reverse_geocoded_locations")

    def values(df: DataFrame, key: str, column: str) -> DataFrame:
        given = one_per_id(df.where(F.col(column).isNotNull()), key, column)
        return given.select(F.lit(column).alias("field"), F.col(key).alias("record_id"), F.col(column).alias("value"))

    given = values(rules, "rule_id", "city").unionByName(values(rules, "rule_id", "country")).unionByName(values(places, "location_id", "state"))
    return map_to_canonical(given, table(spark, sf_dir, "place_names"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, record_id, restored: every garbled title, caption or event name, and its original."""
    rules = one_per_id(table(spark, sf_dir, "correction_rules").where("event_name is not null"), "rule_id", "event_name")
    prov = one_per_id(table(spark, sf_dir, "metadata_provenance").where("raw_value is not null"), "prov_id", "raw_value")
    given = rules.select(F.lit("correction_rules").alias("source_table"), F.col("rule_id").alias("record_id"), F.col("event_name").alias("value")).unionByName(
        prov.select(F.lit("metadata_provenance").alias("source_table"), F.col("prov_id").alias("record_id"), F.col("raw_value").alias("value"))
    )
    return restore_garbled(given)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: every document by byte_bpe_50k without special tokens."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: every document back from its ids."""
    return decode_corpus(encode_corpus(table(spark, sf_dir, "documents")))


def p8_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_id, doc_id, piece, tokens, sheet for every capacity of pack_limits (a table of a few rows)."""
    sizes = materialise(token_counts(table(spark, sf_dir, "documents")), "sizes")
    limits = [(r[0], r[1]) for r in table(spark, sf_dir, "pack_limits").select("limit_id", "capacity_tokens").distinct().orderBy("limit_id").collect()]
    out = None
    for limit_id, capacity in limits:
        if capacity is None or capacity <= 0:
            continue
        packed = pack_documents(sizes, capacity).select(F.lit(limit_id).cast("long").alias("limit_id"), "doc_id", "piece", "tokens", "sheet")
        out = packed if out is None else out.unionByName(packed)
    return spark.createDataFrame([], "limit_id long, doc_id long, piece long, tokens long, sheet long") if out is None else out


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: sheets, tokens and unused room."""
    sheets = p8_sheets(spark, sf_dir).groupBy("limit_id", "sheet").agg(F.sum("tokens").alias("used"))
    limits = table(spark, sf_dir, "pack_limits").select(F.col("limit_id").cast("long").alias("limit_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    return sheets.join(limits, "limit_id").groupBy("limit_id", "capacity").agg(
        F.count(F.lit(1)).alias("sheets"), F.sum("used").alias("tokens"), F.sum(F.col("capacity") - F.col("used")).alias("unused"), F.max("used").alias("fullest")
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind of every document that is no natural prose: list, table or junk."""
    return judge_documents(table(spark, sf_dir, "documents")).where("kind is not null").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, its squared distance from the prose of its language, and the statistic that contributes most."""
    judged = judge_documents(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(name) for name in STATS[1:]])
    most = F.element_at(names, F.array_position("contributions", F.array_max("contributions")).cast("int"))
    columns = [F.col("stats")[i].alias(name) for i, name in enumerate(STATS)]
    return judged.select("doc_id", F.col("lang").alias("detected_lang"), *columns, "distance2", most.alias("most_unlike"), "kind")


QUERIES = {"p1_found": p1_found, "p1_near": p1_near, "p2_found": p2_found, "p4_found": p4_found, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_sheets": p8_sheets, "p8_fill": p8_fill, "p9_found": p9_found, "p9_statistics": p9_statistics}
ORACLES = {"p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
