"""Publications: revisions of many files written by one job, seen by readers all at once or not at all.

Three folders below a root hold them: ``chunks`` and ``files`` (which file and revision a publication holds, also those
without chunks), both by publication, and ``commits`` with one row for each publication that is whole. The commit is the last
write and a single file; a job that dies before leaves folders that no reader looks into. All is read and written by Spark,
so any store that it knows will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMMIT = "publication string, at timestamp, covers array<string>"


def publish_all(chunks: DataFrame, root: str, files: DataFrame | None = None) -> str:
    """Publishes the chunks (file_id, revision, ...) of any number of files in one job; returns the publication's name.

    ``files`` (file_id, revision) names files that are published even without chunks. Chunks are dealt to even parts, not to
    a folder for each file, and sorted so that a file's rows lie together. A revision may be published again: the newer
    publication counts, and what readers have open stays.
    """
    return _write(chunks, files, root, [], None)


def _write(chunks: DataFrame, files: DataFrame | None, root: str, covers: list[str], at) -> str:
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    chunks.hint("rebalance", "file_id").sortWithinPartitions("file_id").write.parquet(f"{root}/chunks/publication={name}")
    named = spark.read.schema(chunks.select("file_id", "revision").schema).parquet(f"{root}/chunks/publication={name}").distinct()
    named = named if files is None else named.unionByName(files.select("file_id", "revision")).distinct()
    named.write.parquet(f"{root}/files/publication={name}")
    commit = spark.createDataFrame([(name, at, covers)], COMMIT).withColumn("at", F.coalesce("at", F.current_timestamp()))
    commit.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return name


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(publication, at) of the publications that count: whole, and not covered by a compaction; a row for each."""
    rows = spark.read.schema(COMMIT).parquet(f"{root}/commits")
    return rows.join(rows.select(F.explode("covers").alias("publication")), "publication", "left_anti").select("publication", "at")


def current_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, revision, publication): each file's newest revision, of one published again the latest publication."""
    newest = Window.partitionBy("file_id").orderBy(F.desc("revision"), F.desc("at"), F.desc("publication"))
    rows = _by_publication(spark, f"{root}/files").join(commits(spark, root), "publication")
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("file_id", "revision", "publication")


def published(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of every file's newest revision; publications that hold none of them are pruned by the join."""
    return _by_publication(spark, f"{root}/chunks").join(current_files(spark, root), ["publication", "file_id", "revision"], "left_semi").drop("publication")


def _by_publication(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder).withColumn("publication", F.col("publication").cast("string"))


def compact(spark: SparkSession, root: str) -> str:
    """Writes what is current as one publication that covers all it was read from; returns its name.

    Publications that are committed meanwhile aren't covered and stay, also where they hold the same revision: the new one
    dates from the latest that it covers.
    """
    seen = commits(spark, root).collect()  # a row for each publication since the last compaction
    covered = [r["publication"] for r in seen]
    newest = Window.partitionBy("file_id").orderBy(F.desc("revision"), F.desc("at"), F.desc("publication"))
    known = spark.createDataFrame(seen, "publication string, at timestamp")
    files = _by_publication(spark, f"{root}/files").join(F.broadcast(known), "publication").withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("file_id", "revision", "publication")
    chunks = _by_publication(spark, f"{root}/chunks").join(files, ["publication", "file_id", "revision"], "left_semi").drop("publication")
    return _write(chunks, files, root, covered, max(r["at"] for r in seen))


def vacuum(spark: SparkSession, root: str, hours: float) -> list[str]:
    """Deletes the folders of publications that don't count and weren't written to for so many hours; returns their names.

    The time must be longer than any job that publishes takes, and than readers hold on to what they have open.
    """
    live = {r["publication"] for r in commits(spark, root).select("publication").collect()}
    jvm, gone = spark._jvm, set()
    for part in ("chunks", "files"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{part}")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in store.listStatus(path):
            name = found.getPath().getName().removeprefix("publication=")
            old = found.getModificationTime() <= jvm.System.currentTimeMillis() - int(hours * 3_600_000)
            if found.isDirectory() and name not in live and old:
                store.delete(found.getPath(), True)
                gone.add(name)
    return sorted(gone)
