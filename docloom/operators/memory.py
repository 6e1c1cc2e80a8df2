"""Relationship memory as change rows: upsert by fingerprint, supersede, expire, recall, hops and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PENDING_DAYS = 14


def upsert(candidates: DataFrame, keys: list[str], retention_days: int = 365) -> DataFrame:
    """One live item for each key from its candidates (confidence, active, at): best confidence, active once active.

    An active item expires after the retention, a pending one after two weeks, both from the latest candidate.
    """
    item = candidates.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.bool_or("active").alias("active"), F.count("*").alias("revision"), F.max("at").alias("confirmed_at"))
    days = F.when(F.col("active"), retention_days).otherwise(PENDING_DAYS)
    return item.withColumn("expires_on", F.date_add(F.col("confirmed_at").cast("date"), days))


def supersede(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The latest row of each key, by the given columns descending."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in newest))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def unexpired(items: DataFrame, today: str) -> DataFrame:
    return items.where(F.col("expires_on") > F.lit(today).cast("date"))


def recall(items: DataFrame, terms: list[str], text: str, order: list[str], n: int = 8) -> DataFrame:
    """The n items that hold most of the terms, then in the given order."""
    asked = F.array(*(F.lit(t.lower()) for t in terms))
    held = F.size(F.filter(asked, lambda t: F.contains(F.lower(F.col(text)), t)))
    return items.withColumn("matched", held).where("matched > 0").orderBy(F.desc("matched"), *order).limit(n)


def two_hops(edges: DataFrame, node: str, entity: str, start: DataFrame) -> DataFrame:
    """(node, shared): other nodes that share an entity with a start node, with the number of entities shared.

    ``start`` has a column named as ``node``. Two equi-joins on the entity; entities are counted once for a node.
    """
    pairs = edges.select(node, entity).distinct()
    asked = pairs.join(start.select(node).distinct(), node, "left_semi").select(entity).distinct()
    near = pairs.join(asked, entity, "left_semi").join(start.select(node), node, "left_anti")
    return near.groupBy(node).agg(F.count("*").alias("shared"))


def drift(snapshot: DataFrame, projected: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) where a projection differs from its snapshot: missing, orphan or diverged."""
    a, b = snapshot.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), projected.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "orphan").when(~F.col("_a").eqNullSafe(F.col("_b")), "diverged")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state is not null")
