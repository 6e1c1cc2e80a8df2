"""Publications are seen whole or not at all, by many files at once, and compaction leaves what is current."""

import pytest
from pyspark.sql import functions as F

from docloom.sources import publications as p

CHUNK = "file_id long, revision long, n int, text string"


def chunks(spark, revision, files, n=2):
    return spark.range(files).select(F.col("id").alias("file_id"), F.lit(revision).cast("long").alias("revision"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n")).withColumn("text", F.concat_ws(" ", F.lit("t"), "file_id", "revision", "n"))


def held(spark, root):
    return {r["file_id"]: (r["revision"], r["n"]) for r in p.published(spark, root).groupBy("file_id", "revision").agg(F.count("*").alias("n")).collect()}


def test_ten_thousand_files_in_one_job(spark, tmp_path):
    root = str(tmp_path)
    p.publish_all(chunks(spark, 1, 10_000), root)
    p.publish_all(chunks(spark, 2, 3), root)
    got = held(spark, root)
    assert len(got) == 10_000 and got[2] == (2, 2) and got[3] == (1, 2)
    assert len(list((tmp_path / "chunks").iterdir())) == 2 and len(list((tmp_path / "commits").glob("part-*"))) == 2


def test_a_job_that_dies_leaves_readers_where_they_were(spark, tmp_path):
    root = str(tmp_path)
    p.publish_all(chunks(spark, 1, 20), root)
    before = held(spark, root)
    broken = chunks(spark, 2, 20).withColumn("text", F.when(F.col("file_id") == 13, F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        p.publish_all(broken, root)
    assert held(spark, root) == before
    files = set((tmp_path / "commits").iterdir())
    p.publish_all(chunks(spark, 3, 20), root)
    assert held(spark, root) != before
    for f in set((tmp_path / "commits").iterdir()) - files:
        f.unlink()  # as if the job had died just before its commit
    assert held(spark, root) == before


def test_compaction_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    for revision in (1, 2, 3):
        p.publish_all(chunks(spark, revision, 5 - revision), root)
    p.publish_all(chunks(spark, 3, 2, n=4), root)  # a revision again
    p.publish_all(chunks(spark, 9, 0), root, spark.createDataFrame([(3, 9)], "file_id long, revision long"))  # a file without chunks
    open_ = p.published(spark, root)
    before = held(spark, root)
    assert before == {0: (3, 4), 1: (3, 4), 2: (2, 2)}
    name = p.compact(spark, root)
    assert held(spark, root) == before and [r["publication"] for r in p.commits(spark, root).collect()] == [name]
    assert open_.count() == 10
    p.publish_all(chunks(spark, 4, 1), root)
    assert p.vacuum(spark, root, 1) == []
    assert len(p.vacuum(spark, root, 0)) == 5 and len(list((tmp_path / "chunks").iterdir())) == 2
    assert held(spark, root) == {0: (4, 2), 1: (3, 4), 2: (2, 2)}


def test_publications_of_one_time_fall_back_to_the_later_name(spark, tmp_path):
    root = str(tmp_path)
    a, b = p.publish_all(chunks(spark, 1, 1, n=1), root), p.publish_all(chunks(spark, 1, 1, n=3), root)
    assert a != b and held(spark, root) == {0: (1, 3)}
