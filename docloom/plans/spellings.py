"""Queries over the spelling of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import spelling
from docloom.plans.queries import read

COMMON = 60  # documents that hold a word of the vocabulary


def corrected_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents in ASCII letters that are near one common word alone."""
    words = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return spelling.corrections(counted, counted.where((F.col("n") >= COMMON) & (F.length("word") >= spelling.LEAST)))


QUERIES = {"corrected_words": corrected_words}

ORACLE_SQL = {
    "corrected_words": f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents) GROUP BY word),
v AS (SELECT word AS known FROM w WHERE n >= {COMMON} AND len(word) >= 4),
p AS (SELECT word, known, levenshtein(word, known)::INT AS distance FROM w JOIN v ON abs(len(word) - len(known)) <= 2 WHERE len(word) >= 4 AND word NOT IN (SELECT known FROM v)),
o AS (SELECT *, min(distance) OVER (PARTITION BY word) AS least, count(*) OVER (PARTITION BY word, distance) AS same FROM p WHERE distance <= CASE WHEN len(word) < 8 THEN 1 ELSE 2 END)
SELECT word, known, distance FROM o WHERE distance = least AND same = 1""",
}
