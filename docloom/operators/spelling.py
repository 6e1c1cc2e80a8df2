"""Spelling against a corpus' own vocabulary: words meet by what is left when letters are deleted, then distance decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, LONG = 4, 8  # letters of a word that may be set right, and from which two edits are allowed


def allowed(word: Column) -> Column:
    """Edits that a word may be away from what it should be."""
    return F.when(F.length(word) < LEAST, 0).when(F.length(word) < LONG, 1).otherwise(2)


def deletions(word: Column) -> Column:
    """The word, and what is left of it without any one letter, or any two of a long one.

    Two words within k edits have a common string among those with up to k letters deleted. A word that is set right by two
    edits has ``LONG`` letters at least, so its neighbours may have two fewer.
    """

    def without_one(words: Column) -> Column:
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))
        return F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 0, cut(w)).otherwise(F.array().cast("array<string>"))))

    bound = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))
    one = F.array_union(F.array(word), without_one(F.array(word)))
    two = bound(one, lambda x: F.array_union(x, F.array_distinct(without_one(x))))
    return F.when(F.length(word) >= LONG - 2, two).otherwise(one)


def near_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, known, distance): the vocabulary's words within the allowed edits of each word; ``words`` and ``vocabulary`` have a column word.

    Null words and those of fewer than ``LEAST`` letters have none. An equi-join on hashes of deletions, so each word meets its neighbours alone; keys
    only choose what is compared. Words are made distinct first.
    """
    keyed = lambda df, name: df.where("word is not null").select(F.col("word").alias(name)).distinct().withColumn("_key", F.explode(F.transform(deletions(F.col(name)), lambda k: F.xxhash64(k))))
    asked = keyed(words.where(F.length("word") >= LEAST), "word")
    met = asked.join(keyed(vocabulary, "known"), "_key").select("word", "known").distinct()
    return met.withColumn("distance", F.levenshtein("word", "known")).where(F.col("distance") <= allowed(F.col("word")))


def corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, known, distance) of words outside the vocabulary that one of its words is nearest to; a tie sets nothing right."""
    unknown = words.select("word").join(vocabulary.select("word"), "word", "left_anti")
    near = near_words(unknown, vocabulary)
    best = near.groupBy("word").agg(F.min(F.struct("distance", "known")).alias("_best"), F.min("distance").alias("_least"), F.collect_list("distance").alias("_all"))
    clear = F.size(F.filter("_all", lambda d: d == F.col("_least"))) == 1
    return best.where(clear).select("word", F.col("_best.known").alias("known"), F.col("_least").alias("distance"))
