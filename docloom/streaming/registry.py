"""Evidence registries that expire: a stateful processor for streams, and the same rows from a whole table by windows.

Items of a run (run_id, generation, seq, at, kind, item_key, relevant) are numbered V1, V2, ... or W1, W2, ... by kind as
they arrive. A run forgets all after ``ttl`` without any item, or when a later generation begins; items of an earlier generation
than the one that a run remembers are refused. ``since`` is when a registry got its first item.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

TTL_SECONDS, MOST = 600, 40  # fixed values: how long a run is remembered, and how many items it has
REGISTERED = "run_id string, since timestamp, label string, kind string, item_key string, relevant boolean"


class ExpiringRegistry(StatefulProcessor):
    """State of a run: a map from item to (label, relevant), and counts, generation and end of life as one value.

    A timer at the end of life clears the run, so idle runs cost nothing; an item at or after that time, if it comes before
    the timer fires, finds the run forgotten just the same.
    """

    def __init__(self, ttl_seconds: int = TTL_SECONDS, most: int = MOST):
        self.ttl, self.most = datetime.timedelta(seconds=ttl_seconds), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "kind string, item_key string", "label string, relevant boolean")
        self.run = handle.getValueState("run", "since timestamp, generation long, n_v int, n_w int, until timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, generation, counts, until = None, None, {"V": 0, "W": 0}, None
        if self.run.exists():
            since, generation, n_v, n_w, until = self.run.get()
            counts = {"V": n_v, "W": n_w}
        out = []
        arrived = pd.concat(rows).sort_values(["at", "seq"])
        for item in arrived.itertuples(index=False):
            at = item.at.to_pydatetime()
            alive = until is not None and at < until
            until = at + self.ttl
            if alive and item.generation < generation:
                continue
            if not alive or item.generation > generation:
                self.items.clear()
                since, generation, counts = at, int(item.generation), {"V": 0, "W": 0}
            entry = (item.kind, item.item_key)
            if self.items.containsKey(entry):
                label, relevant = self.items.getValue(entry)
                if relevant or not item.relevant:
                    continue
            elif sum(counts.values()) >= self.most:
                continue
            else:
                counts[item.kind] += 1
                label = f"{item.kind}{counts[item.kind]}"
            self.items.updateValue(entry, (label, bool(item.relevant)))
            out.append((key[0], since, label, item.kind, item.item_key, bool(item.relevant)))
        self.run.update((since, generation, counts["V"], counts["W"], until))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(until.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "since", "label", "kind", "item_key", "relevant"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.items.clear()
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


def registry_stream(items: DataFrame, late: str = "10 minutes", ttl_seconds: int = TTL_SECONDS, most: int = MOST) -> DataFrame:
    """Each item when it gets its label, and again when it turns relevant; items later than the watermark are left out.

    Needs Spark's RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return items.withWatermark("at", late).groupBy("run_id").transformWithStateInPandas(ExpiringRegistry(ttl_seconds, most), REGISTERED, "Append", "eventTime")


def registry_table(items: DataFrame, ttl_seconds: int = TTL_SECONDS, most: int = MOST) -> DataFrame:
    """The labels that ``registry_stream`` ends with, if no item comes late: windows over each run in order of time."""
    order = Window.partitionBy("run_id").orderBy("at", "seq")
    idle = F.unix_micros("at") - F.unix_micros(F.lag("at").over(order)) >= ttl_seconds * 1_000_000
    lives = items.withColumn("_new", F.coalesce(idle, F.lit(True)).cast("long")).withColumn("_life", F.sum("_new").over(order))
    latest = F.max("generation").over(Window.partitionBy("run_id", "_life").orderBy("at", "seq"))
    rows = lives.withColumn("_latest", latest).where("generation = _latest")
    registry = ["run_id", "_life", "generation"]
    rows = rows.withColumn("since", F.min("at").over(Window.partitionBy(*registry)))
    first = rows.groupBy(*registry, "since", "kind", "item_key").agg(F.min(F.struct("at", "seq")).alias("_first"), F.bool_or("relevant").alias("relevant"))
    entry = F.row_number().over(Window.partitionBy(*registry).orderBy("_first"))
    number = F.row_number().over(Window.partitionBy(*registry, "kind").orderBy("_first"))
    kept = first.withColumn("_entry", entry).where(F.col("_entry") <= most)
    return kept.select("run_id", "since", F.concat("kind", number).alias("label"), "kind", "item_key", "relevant")
