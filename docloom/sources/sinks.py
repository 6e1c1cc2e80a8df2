"""Sinks: revisions published as new folders, and the view of what is current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def publish(chunks: DataFrame, root: str, file_id: int, revision: int) -> str:
    """Write a file's chunks to a new folder, then name that in the manifest; readers see all of it or none. Returns the folder.

    Publishing a revision again writes another folder and a newer manifest row; what readers have open stays. A folder
    that the manifest doesn't name is never read.
    """
    folder = f"file={file_id}/rev={revision}/write={uuid.uuid4().hex}"
    chunks.drop("file_id", "revision").write.parquet(f"{root}/chunks/{folder}")
    row = chunks.sparkSession.createDataFrame([(file_id, revision, folder)], "file_id long, revision long, folder string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifest")
    return folder


def current(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of every file's newest published revision, with file_id and revision.

    The folders are partitions, so that a join with the manifest, which is broadcast if small, prunes what is not current.
    """
    newest = Window.partitionBy("file_id").orderBy(F.desc("revision"), F.desc("at"), F.desc("folder"))
    named = spark.read.parquet(f"{root}/manifest").withColumn("n", F.row_number().over(newest)).where("n = 1")
    named = named.select(F.col("file_id").alias("file"), F.col("revision").alias("rev"), F.regexp_extract("folder", "write=(.*)$", 1).alias("write"))
    rows = spark.read.option("basePath", f"{root}/chunks").parquet(f"{root}/chunks")
    rows = rows.withColumns({"file": F.col("file").cast("long"), "rev": F.col("rev").cast("long"), "write": F.col("write").cast("string")})
    return rows.join(named, ["file", "rev", "write"], "left_semi").withColumnsRenamed({"file": "file_id", "rev": "revision"}).drop("write")


def changed_only(candidates: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Candidates that are new or differ from the stored row in any other column."""
    columns = [c for c in candidates.columns if c != key]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    old = stored.select(key, digest.alias("_d"))
    return candidates.withColumn("_d", digest).join(old, [key, "_d"], "left_anti").drop("_d")


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The state that append-only change rows describe: the newest of each key, deleted ones left out."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    rows = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return rows.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in changes.columns else rows
