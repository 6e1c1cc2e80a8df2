"""Changes of a library's state as folds over rows: queues, revisions, retention, trash and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def enqueue(commands: DataFrame, file: str, key: str, order: str) -> DataFrame:
    """Each command's revision: a repeated key of a file reuses its first revision, a new one gets the next."""
    first = commands.withColumn("_first", F.min(order).over(Window.partitionBy(file, key)))
    return first.withColumn("revision", F.dense_rank().over(Window.partitionBy(file).orderBy("_first"))).withColumn("reused", F.col(order) > F.col("_first")).drop("_first")


def claim_state(attempts: Column, most: Column, lease_until: Column, now: Column, cancelled: Column) -> Column:
    """cancelled, exhausted, leased or claimable."""
    return F.when(cancelled, "cancelled").when(attempts >= most, "exhausted").when(F.coalesce(lease_until > now, F.lit(False)), "leased").otherwise("claimable")


def with_retention(items: DataFrame, confirmed: str, live: Column, days: int) -> DataFrame:
    """Expiry of live items at so many days after they were confirmed; others keep theirs."""
    return items.withColumn("expires_on", F.when(live, F.date_add(F.col(confirmed).cast("date"), days)).otherwise(F.col("expires_on")))


def fenced(results: DataFrame, current: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of the current generation; late ones of an older generation are rejected, not merged."""
    return results.join(current.select(key, generation), [key, generation], "left_semi")


def summary_state(summaries: DataFrame, items: DataFrame, user: str, revision: str) -> DataFrame:
    """(user, state): fresh, stale where the items have moved on, missing, or empty without items."""
    now = items.groupBy(user).agg(F.max(revision).alias("_now"))
    both = now.join(summaries.select(user, F.col(revision).alias("_then")), user, "full_outer")
    return both.select(user, F.when(F.col("_now").isNull(), "empty").when(F.col("_then").isNull(), "missing").when(F.col("_then") < F.col("_now"), "stale").otherwise("fresh").alias("state"))


def resolve_scope(stored: Column, explicit: Column, folder: Column, allowed: Column, most: int = 50) -> Column:
    """Stored, then asked, then folder files, each once; null (the whole library) if none is left; asking for a file that isn't allowed gives an empty scope."""
    none = F.array().cast("array<long>")
    of = lambda c: F.coalesce(c, none)
    strict = F.size(F.array_except(of(explicit), allowed)) == 0
    union = F.slice(F.array_intersect(F.array_distinct(F.concat(of(stored), of(explicit), of(folder))), allowed), 1, most)
    return F.when(~strict, none).when(F.size(union) > 0, union)
