"""Session settings and the shared folder for persisted intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(app: str = "fotostrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent (tests on one machine) a temporary folder
    is made; on a cluster master that would lose data, so it is refused there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"fotostrata-shared-{os.getuid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def _own_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/fotostrata-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below this application's part of the shared folder; nothing is created yet."""
    return f"{_own_root(spark)}/{label}-{uuid.uuid4().hex}"


def purge(spark: SparkSession) -> None:
    """Removes everything this application wrote to the shared folder; results that still read it must be saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage without keeping a copy on executors: a lost executor costs
    nothing that has been written.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in a few tasks for every core, for rows of few bytes that are much work each, as files are.

    A number of partitions is given because adaptive execution would otherwise
    join small ones, down to a single task for the files of a whole folder.
    """
    spark = df.sparkSession
    return df.repartition(max(8, spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_id(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One row per id of a table in which whole rows are delivered repeatedly.

    Aggregates before the shuffle and spreads by the id, so neither a hot value
    nor a row delivered a million times meets in one task. Where deliveries
    differ, the least struct of ``values`` stands for the id; null ids are dropped.
    """
    from pyspark.sql import functions as F

    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias(key))
        .agg(F.min(F.struct(*values)).alias("_row"))
        .select(key, "_row.*")
    )
