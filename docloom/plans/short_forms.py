"""Queries over short forms of nations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import short_forms
from docloom.plans.queries import read


def nation_forms(spark: SparkSession, d: str) -> DataFrame:
    """The first two letters of nations as their codes, with the words of their region as topics; some need no context."""
    named = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.left("n_name", F.lit(2)).alias("code"), F.initcap("n_name").alias("meaning"), F.split(F.lower("r_name"), " ").alias("topics"), (F.col("n_nationkey") % 5 == 0).alias("free"))


def resolved_forms(spark: SparkSession, d: str) -> DataFrame:
    """Sentences on suppliers that name their nation by its code, some with its region, its name or a question beside it."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code, k = F.left("n_name", F.lit(2)), F.col("s_suppkey") % 5
    tail = F.when(k == 0, F.concat(F.lit(" in "), F.lower("r_name"))).when(k == 1, F.lit(", what is its meaning")).when(k == 2, F.concat(F.lit(" or "), F.initcap("n_name"))).otherwise("")
    texts = s.select("s_suppkey", F.concat(F.lit("Ships from "), code, F.lit(" and "), code, tail).alias("text"), F.when(k == 3, F.lower("r_name")).alias("history"))
    found = short_forms.resolved_short_forms(texts, nation_forms(spark, d), "s_suppkey", "text", "history")
    return found.select("s_suppkey", F.array_join("detected", ",").alias("detected"), "resolved")


def form_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return short_forms.conflicting_forms(nation_forms(spark, d))


QUERIES = {"resolved_forms": resolved_forms, "form_conflicts": form_conflicts}

FORMS = """SELECT n_name[1:2] AS code, upper(n_name[1]) || lower(n_name[2:]) AS meaning, n_name, lower(r_name) AS topic, n_nationkey % 5 = 0 AS free FROM nation JOIN region ON n_regionkey = r_regionkey"""
# Names of nations are taken word by word with capitals, as in the sentences.
CAPITALS = "list_aggregate(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"
ORACLE_SQL = {
    "resolved_forms": f"""WITH f AS ({FORMS.replace("upper(n_name[1]) || lower(n_name[2:])", CAPITALS)}),
s AS (SELECT s_suppkey, s_suppkey % 5 AS k, n_name, n_name[1:2] AS code, lower(r_name) AS region, {CAPITALS} AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT *, 'Ships from ' || code || ' and ' || code || CASE k WHEN 0 THEN ' in ' || region WHEN 1 THEN ', what is its meaning' WHEN 2 THEN ' or ' || nation ELSE '' END AS text FROM s),
m AS (SELECT t.*, f.meaning, f.n_name AS other, (k = 1 OR f.free OR (k IN (0, 3) AND list_has_any(string_split(t.region, ' '), string_split(f.topic, ' ')))
  OR (k IN (0, 2, 3) AND list_has_any(string_split(lower(CASE k WHEN 2 THEN t.nation ELSE t.region END), ' '), string_split(lower(f.meaning), ' ')))) AS quorum FROM t JOIN f ON f.code = t.code),
b AS (SELECT s_suppkey, code, k, text, nation, count(*) FILTER (quorum) AS n, max(meaning) FILTER (quorum) AS best FROM m GROUP BY ALL)
SELECT s_suppkey, code AS detected, CASE WHEN n = 1 AND NOT (k = 2 AND best = nation) THEN replace(replace(text, ' ' || code || ' and', ' ' || best || ' (' || code || ') and'), 'and ' || code, 'and ' || best || ' (' || code || ')') ELSE text END AS resolved FROM b""",
    "form_conflicts": f"""WITH f AS ({FORMS}), p AS (SELECT DISTINCT code, meaning, unnest(string_split(topic, ' ')) AS topic FROM f),
n AS (SELECT code, topic, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT code, count(DISTINCT meaning) AS meanings FROM p GROUP BY code)
SELECT code, meanings, (SELECT count(*) FROM n WHERE n.code = c.code AND n.n > 1) AS shared FROM c WHERE meanings > 1""",
}
