"""Queries of shown answers, follow-up questions, portraits and manifests, and their SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import replies, text
from docloom.operators import answers, web
from docloom.plans.rules import CONTENT, STOP_SQL, W, nth, nth_sql, read

TAILS = [" [V1, W2] .\nanswer_id: 7", "\n<metadata>x</metadata>\n20240101_0001", "\nWhat next?\nAnd then?", "\n2024-05-06", " <followups>[1]", ""]
ENTITIES = ["Ada Byron", "", "NATION_3"]
ASKS = ["Where did she go?", "is it raining", "Which port?", "Tell me all about the long way home"]
TEXTS = ["Ann sails 7 boats to Rome.", "- a list", "Ann sails 8 boats.", "Ann met Bruno there.", ""]
KNOWN = "ann sails 7 boats to rome"


def drafted(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").withColumn("draft", F.concat("text", nth(TAILS, F.col("conv_id") + F.col("turn"))))


DRAFTED = f"(SELECT *, text || {nth_sql(TAILS, 'conv_id + turn')} AS draft FROM conversations)"


def shown_answers(spark: SparkSession, d: str) -> DataFrame:
    return drafted(spark, d).select("conv_id", "turn", replies.shown_answer("draft").alias("shown"))


def split_followups(spark: SparkSession, d: str) -> DataFrame:
    return drafted(spark, d).select("conv_id", "turn", F.array_join(replies.followups("draft"), "|").alias("asked"), F.sha2(replies.without_followups("draft"), 256).alias("rest"))


def suggested_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's first words as a suggestion after the turn before, checked against it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).where("before is not null")
    return turns.select("conv_id", "turn", replies.valid_followup(F.col("text"), F.lit("short one"), F.col("before")).alias("question"))


def short_queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", replies.simplified_query("text").alias("short"))


def resolved_questions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", replies.resolved_followup(nth(ASKS, F.col("event_id")), nth(ENTITIES, F.floor(F.col("event_id") / 4))).alias("asked"))


def portraits(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", F.coalesce(replies.portrait_problem(nth(TEXTS, F.col("event_id")), F.lit(KNOWN)), F.lit("none")).alias("problem"))


def about_me(spark: SparkSession, d: str) -> DataFrame:
    """Each user's kinds of events as sentences; a user has few kinds, and three values of each are told."""
    kinds = read(spark, d, "events").select("user_id", "event_type", F.floor("value").cast("string").alias("v")).distinct()
    few = kinds.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("v"))).where("n <= 3")
    kind = F.when(F.col("event_type") == "view", "likes").when(F.col("event_type") == "signup", "name").otherwise("other")
    return few.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("v")).alias("vs")).select("user_id", "event_type", replies.about_sentence(kind, F.col("vs")).alias("sentence"))


def uncited_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Question words that a denying answer talks of and no cited text of its run holds."""
    turns = read(spark, d, "conversations")
    asked = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    said = turns.where("role = 'assistant' and conv_id % 2 = 0").withColumn("text", F.concat(F.lit("The rain is not mentioned. "), "text"))
    return answers.uncited_keywords(asked, said, turns.where("role = 'user' and turn > 1"), "conv_id", "text")


def recovery_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Row counts and order-free digests of tables, by which a restored copy is verified."""
    tables = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "customer": ["c_custkey", "c_name"], "pages": ["page_id", "url"]}
    parts = [web.row_digest(read(spark, d, t).withColumn("relation", F.lit(t)), ["relation"], columns) for t, columns in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (shown_answers, split_followups, suggested_questions, short_queries, resolved_questions, portraits, about_me, uncited_keywords, recovery_manifest)}


def shown_sql() -> str:
    out = "draft"
    for pattern in (replies.INTERNAL_TAGS, replies.OPEN_TAG, replies.MARKER_LINES, replies.CITATION, replies.TRAILING_IDS, replies.TRAILING_DAY):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({out}, '[ \t]+([,.;:!?])', '\1', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ')"


DIGEST = "SELECT '{0}' AS relation, count(*) AS n, sum(('0x' || h[1:12])::BIGINT)::HUGEINT::VARCHAR AS low, sum(('0x' || h[13:24])::BIGINT)::HUGEINT::VARCHAR AS high FROM (SELECT sha256(concat_ws(chr(31), {1})) AS h FROM {0})"

PLAIN = f"regexp_extract_all(lower({reduce(lambda x, fold: f'replace({x}, {fold[0]!r}, {fold[1]!r})', text.FOLDS.items(), '{}')}), '[a-z0-9]+')"

ORACLE_SQL = {
    "shown_answers": f"SELECT conv_id, turn, {shown_sql()} AS shown FROM {DRAFTED}",
    "split_followups": f"""
WITH l AS (SELECT conv_id, turn, draft, list_filter(string_split(draft, chr(10)), lambda x: trim(x) <> '') AS l FROM {DRAFTED}),
p AS (SELECT *, coalesce(list_max(list_transform(l, lambda x, i: CASE WHEN NOT ends_with(trim(x), '?') THEN i ELSE 0 END)), 0) AS p FROM l), n AS (SELECT *, CASE WHEN p > 0 AND len(l) - p <= 4 THEN len(l) - p ELSE 0 END AS n FROM p)
SELECT conv_id, turn, array_to_string(list_transform(l[len(l) - n + 1:], lambda x: trim(x)), '|') AS asked, sha256(CASE WHEN n = 0 THEN draft ELSE array_to_string(l[:len(l) - n], chr(10)) END) AS rest FROM n""",
    "suggested_questions": rf"""
WITH b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM conversations),
q AS (SELECT *, CASE WHEN ends_with(t, '?') THEN t ELSE regexp_replace(t, '[.!]+$', '') || '?' END AS q FROM b WHERE before IS NOT NULL)
SELECT conv_id, turn, CASE WHEN list_has_any({CONTENT.format('q')}, {CONTENT.format("('short one ' || before)")}) AND length(q) <= 160 AND len({W.format('q')}) <= 24 AND NOT regexp_matches(q, '{replies.GENERIC}')
  AND list_contains({W.format('q')}, 'short')::INT + list_contains({W.format('q')}, 'one')::INT < 1.5 THEN q END AS question FROM q""",
    "short_queries": rf"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_''-]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOP_SQL}, lower(w))) AS ws,
  regexp_extract(text, '\p{{Lu}}[\p{{L}}\p{{N}}]+(?: (?:\p{{Lu}}[\p{{L}}\p{{N}}]+|[0-9]+))+') AS name FROM conversations),
i AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(w) / 10.0::DOUBLE + CASE WHEN regexp_matches(w, '^\p{{Lu}}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(w, '[0-9]') THEN 2 ELSE 0 END DESC, i) AS r FROM i),
t AS (SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS two FROM r WHERE r <= 2 GROUP BY ALL),
s AS (SELECT conv_id, turn, ws, CASE WHEN name <> '' AND lower(name) <> lower(array_to_string(ws, ' ')) THEN name ELSE two END AS short FROM w LEFT JOIN t USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN len(ws) >= 2 AND lower(short) <> lower(array_to_string(ws, ' ')) THEN short END AS short FROM s""",
    "resolved_questions": f"""
WITH e AS (SELECT event_id, {nth_sql(ASKS, 'event_id')} AS q, {nth_sql(ENTITIES, 'event_id // 4')} AS e FROM events)
SELECT event_id, CASE WHEN e <> '' THEN CASE event_id % 4 WHEN 0 THEN 'Where did ' || e || ' go?' WHEN 2 THEN e || ' Which port?' END END AS asked FROM e""",
    "portraits": "SELECT event_id, (['none', 'list', 'invented_number', 'invented_name', 'empty'])[event_id % 5 + 1] AS problem FROM events",
    "about_me": """
WITH k AS (SELECT DISTINCT user_id, event_type, floor(value)::BIGINT::VARCHAR AS v FROM events), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY v) <= 3),
g AS (SELECT user_id, event_type, list(v ORDER BY v) AS l FROM f GROUP BY ALL), t AS (SELECT *, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE l[1] || ', ' || l[2] || ', and ' || l[3] END AS t FROM g)
SELECT user_id, event_type, CASE event_type WHEN 'view' THEN 'You like ' WHEN 'signup' THEN 'You go by ' ELSE 'You mentioned ' END || t || '.' AS sentence FROM t""",
    "uncited_keywords": f"""
WITH f AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations GROUP BY conv_id), a AS (SELECT conv_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(q, '[A-Za-z]{{5,}}'), lambda w: lower(w)), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in answers.DENIAL_STOP + answers.META_WORDS)}], w)))) AS token FROM f),
s AS (SELECT DISTINCT conv_id, unnest({PLAIN.format("('The rain is not mentioned. ' || text)")}) AS token FROM conversations WHERE role = 'assistant' AND conv_id % 2 = 0), c AS (SELECT DISTINCT conv_id, unnest({PLAIN.format('text')}) AS token FROM conversations WHERE role = 'user' AND turn > 1)
SELECT conv_id, token FROM a WHERE (conv_id, token) IN (SELECT (conv_id, token) FROM s) AND (conv_id, token) NOT IN (SELECT (conv_id, token) FROM c)""",
    "recovery_manifest": " UNION ALL ".join(DIGEST.format(t, c) for t, c in (("orders", "o_orderkey, o_custkey, o_orderstatus"), ("customer", "c_custkey, c_name"), ("pages", "page_id, url"))),
}
