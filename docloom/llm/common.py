"""Helpers that several corpus operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark alone so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder in ``spark.checkpoint.dir``, else below the warehouse; never to a folder that a
    single machine sees: outside local mode one of the two must be set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder; later plans read them instead of computing them again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def private(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores before them until none is a column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def spread_join(left: DataFrame, right: DataFrame, key: str, by: list[str], how: str = "left", counts: DataFrame | None = None, least: int = 10_000, hot_keys: int = 10_000) -> DataFrame:
    """Join on ``key`` with a ``right`` that has one row for each key at most, salted for keys of many rows.

    A key is hot with more than ``least`` rows and more than one in ``hot_keys`` of all; so there are ``hot_keys`` such
    keys at most, which are broadcast. Their left rows are dealt to salts by a hash of the columns ``by``, their right rows
    are repeated for each salt. ``counts`` (key, n) spares counting where the left rows of each key are known.
    """
    spark = left.sparkSession
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts.select(key, "n")
    counts = settled(counts.where(F.col("n") > least))
    limit = max(least, int(counts.agg(F.sum("n")).first()[0] or 0) // hot_keys)
    salt, salts = private(left.join(right.limit(0), key), "salt", "salts")
    hot = {r[0]: r[1] for r in counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / F.lit(limit))).collect()}
    if not hot:
        return left.join(right, key, how)
    table = F.broadcast(spark.createDataFrame(list(hot.items()), f"{key} {right.schema[key].dataType.simpleString()}, {salts} long"))
    one = F.coalesce(salts, F.lit(1).cast("long"))
    salted = left.join(table, key, "left").withColumn(salt, F.pmod(F.xxhash64(*by), one)).drop(salts)
    spread = right.join(table, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop(salts)
    return salted.join(spread, [key, salt], how).drop(salt)


def merge_labels(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of index pairs (i, j) into ``parent``, a flat forest whose roots are the smallest members."""
    while True:
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return parent
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node that an edge touches; component is the smallest node reachable.

    ``edges`` has two columns of one orderable type. Alternates large-star and small-star steps, so the number of
    rounds grows with the logarithm of the longest path. Each round is a handful of joins on node ids, checkpointed.
    Self-loops, nulls and repeated edges add nothing; no edges give no rows.
    """
    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e, before = settled(e), None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = large.join(low, "hi")
        small = near.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(near.select("hi", F.col("m").alias("lo")))
        e = settled(small.where("hi <> lo").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
