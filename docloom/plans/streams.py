"""Tables of what streams end with, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.queries import read
from docloom.streaming.registry import registry_table

IDLE, LISTED = 36 * 3600, 5


def registry_items(events: DataFrame) -> DataFrame:
    """Events as items of evidence: their weeks are generations, and now and then one comes from the week before."""
    week = F.expr("datediff(ts, date'2000-01-03') div 7") - F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    kind = F.when(F.col("event_type").isin("view", "click"), "V").otherwise("W")
    return events.select(F.col("user_id").cast("string").alias("run_id"), week.cast("long").alias("generation"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.concat_ws("-", "event_type", F.col("event_id") % 9).alias("item_key"), (F.col("event_id") % 4 == 0).alias("relevant"))


def expiring_registry(spark: SparkSession, d: str) -> DataFrame:
    found = registry_table(registry_items(read(spark, d, "events")), IDLE, LISTED)
    return found.withColumn("since", F.unix_micros("since"))


QUERIES = {"expiring_registry": expiring_registry}

ORACLE_SQL = {
    "expiring_registry": f"""WITH items AS (SELECT CAST(user_id AS VARCHAR) AS run_id, datediff('day', DATE '2000-01-03', ts::DATE) // 7 - CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS generation,
  event_id AS seq, epoch_us(ts) AS at_, CASE WHEN event_type IN ('view', 'click') THEN 'V' ELSE 'W' END AS kind, event_type || '-' || event_id % 9 AS item_key, event_id % 4 = 0 AS relevant FROM events),
lives AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY at_, seq) AS life FROM
  (SELECT *, CASE WHEN at_ - lag(at_) OVER (PARTITION BY run_id ORDER BY at_, seq) < {IDLE}000000 THEN 0 ELSE 1 END AS fresh FROM items)),
live AS (SELECT *, min(at_) OVER (PARTITION BY run_id, life, generation) AS since FROM
  (SELECT * FROM lives QUALIFY generation = max(generation) OVER (PARTITION BY run_id, life ORDER BY at_, seq))),
firsts AS (SELECT run_id, life, generation, since, kind, item_key, min((at_, seq)) AS first, bool_or(relevant) AS relevant FROM live GROUP BY ALL),
kept AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY run_id, life, generation ORDER BY first) <= {LISTED})
SELECT run_id, since, kind || row_number() OVER (PARTITION BY run_id, life, generation, kind ORDER BY first) AS label, kind, item_key, relevant FROM kept""",
}
