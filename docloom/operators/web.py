"""Web and card evidence: merging legs, ordering, numbering, envelopes, pools; and integrity of row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_legs(rows: DataFrame, key: str, leg: str, place: str, relevant: str) -> DataFrame:
    """One row for each key: the first leg's, unless only a later one is relevant; it keeps the first place in order."""
    best = Window.partitionBy(key).orderBy(F.desc(relevant), leg, place)
    first = F.min(F.struct(leg, place)).over(Window.partitionBy(key))
    picked = rows.withColumn("_first", first).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return picked.withColumn("first_leg", F.col(f"_first.{leg}")).withColumn("first_place", F.col(f"_first.{place}")).drop("_n", "_first")


def web_order(relevant: Column, promotional: Column, generic: Column) -> list[Column]:
    """Relevant before others, plain before promotional, specific before generic."""
    return [F.when(relevant, 0).otherwise(1), F.when(promotional, 1).otherwise(0), F.when(generic, 1).otherwise(0)]


def envelopes(rows: DataFrame, file: str, rank: str) -> DataFrame:
    """Chunks grouped by file in order of the file's best rank, labelled `chunk i of n`."""
    w = Window.partitionBy(file)
    out = rows.withColumn("file_rank", F.min(rank).over(w)).withColumn("_i", F.row_number().over(w.orderBy(rank))).withColumn("_n", F.count("*").over(w))
    return out.withColumn("label", F.format_string("chunk %d of %d", "_i", "_n")).drop("_i", "_n")


def registry(rows: DataFrame, run: str, kind: str, key: str, arrival: str, most: int = 40) -> DataFrame:
    """Different items of a run, numbered V1.. or W1.. by kind in order of arrival."""
    first = rows.groupBy(run, kind, key).agg(F.min(arrival).alias("_at"))
    n = F.row_number().over(Window.partitionBy(run, kind).orderBy("_at", key))
    return first.withColumn("_n", n).where(F.col("_n") <= most).withColumn("label", F.concat(F.upper(F.left(kind, F.lit(1))), "_n")).drop("_n", "_at")


def keep_files(rows: DataFrame, group: str, file: str, rank: str, most: int) -> DataFrame:
    """The first rows of each group; of files that would vanish, the last one's best row takes the last place."""
    w = Window.partitionBy(group).orderBy(rank)
    numbered = rows.withColumn("_n", F.row_number().over(w)).withColumn("_head", F.min(F.when(F.col("_n") <= most, 0)).over(Window.partitionBy(group, file)))
    lost = numbered.where("_head is null").withColumn("_b", F.row_number().over(Window.partitionBy(group, file).orderBy(rank))).where("_b = 1")
    last = lost.withColumn("_l", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(rank)))).where("_l = 1").drop("_b", "_l")
    displaced = last.select(group).withColumn("_gone", F.lit(most))
    head = numbered.where(F.col("_n") <= most).join(displaced, group, "left").where("_gone is null or _n < _gone").drop("_gone")
    return head.unionByName(last).drop("_n", "_head")


def pool(rows: DataFrame, group: str, flag: str, place: str, most: int) -> DataFrame:
    """Flagged rows first, then the rest, cut to the pool; a group without any flagged row gives none."""
    w = Window.partitionBy(group)
    n = F.row_number().over(w.orderBy(F.desc(flag), place))
    return rows.withColumn("_any", F.max(F.col(flag).cast("int")).over(w)).withColumn("_n", n).where((F.col("_any") == 1) & (F.col("_n") <= most)).drop("_any", "_n")


def rescue(rows: DataFrame, group: str, flag: str, place: str, score: Column, n: int = 3, floor: float = 0.5) -> DataFrame:
    """The first n unflagged rows of each group become flagged where their score reaches the floor."""
    turn = F.row_number().over(Window.partitionBy(group, flag).orderBy(place))
    return rows.withColumn("_n", turn).withColumn(flag, F.col(flag) | ((F.col("_n") <= n) & (score >= floor))).drop("_n")


def representative_sample(rows: DataFrame, group: str, order: str, most: int = 12) -> DataFrame:
    """At most ``most`` rows of each group, evenly spaced from first to last; places round half to even."""
    w = Window.partitionBy(group)
    out = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / (most - 1), 0).cast("int"))
    return out.where((F.col("_n") <= most) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def lexical_scores(docs: DataFrame, key: str, words: Column, terms: list[str], k: int) -> DataFrame:
    """The k best by sum over terms of log(1 + frequency), over log(2 + words); ties by key. Term counts never leave the row."""
    rows = docs.select(key, words.alias("_w"))
    hits = [F.size(F.filter("_w", _equals(t))) for t in terms]
    score = sum((F.log1p(h.cast("double")) for h in hits), F.lit(0.0)) / F.log(F.lit(2.0) + F.size("_w"))
    return rows.select(key, F.round(score, 9).alias("lexical_score")).where("lexical_score > 0").orderBy(F.desc("lexical_score"), key).limit(k)


def _equals(term: str):
    return lambda w: w == term


def row_digest(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """A digest of each group's set of rows that doesn't depend on their order: row count and sums of row hashes.

    Sums are partial aggregates, so a group of any size is digested without being gathered.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(*group).agg(F.count("*").alias("n"), part(1).cast("string").alias("low"), part(13).cast("string").alias("high"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key names no parent; null keys are orphans."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
