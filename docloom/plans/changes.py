"""Queries of joins, rankings and changes of stored rows, and of the checks of answers; their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators import answers, library, mutations
from docloom.plans.rules import nth, read

DENY = ["The rain is not mentioned. ", "It does not state the price. ", "There is no record of the thedly. ", "Fine. "]
CLAIM = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
PRIORITY = {"PROMO": 0, "STANDARD": 1, "SMALL": 2}


def first(rows: DataFrame, by: list, *order) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def untagged_parts(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array(F.when(F.col("p_size") > 25, F.lit(" ")), F.when(F.col("p_size") > 40, F.col("p_brand")))
    return read(spark, d, "part").where(~F.exists(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.trim(t) != "")).select("p_partkey")


def best_or_null(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their dearest finished order, null where they have none."""
    o = read(spark, d, "orders").withColumn("done", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    rows = read(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return first(rows, ["c_custkey"], F.desc_nulls_last("done"), "o_orderkey").select("c_custkey", "o_orderkey", "done")


def json_key_join(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("key", F.get_json_object("props", "$.k").cast("long"))
    return e.join(read(spark, d, "nation").withColumn("key", F.col("n_nationkey").cast("long")), "key").groupBy("n_name").agg(F.count("*").alias("n"))


def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Named ids resolved to live rows in the caller's order, unknown ones left out."""
    ids = spark.createDataFrame([([90, 7, 7, 100_000_000, 33, 1],)], "ids array<long>").select(F.posexplode("ids").alias("place", "o_orderkey"))
    return ids.join(read(spark, d, "orders"), "o_orderkey").select("place", "o_orderkey", "o_orderstatus")


def resolved_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names to ids whatever their case; of equal names the folder decides, then the smallest id."""
    asked = spark.createDataFrame([("nation_3", None), ("NATION_7", 2), ("Nation_99", None)], "name string, folder int")
    n = read(spark, d, "nation").withColumn("low", F.lower("n_name"))
    rows = asked.join(n, (F.lower("name") == F.col("low")) & (F.col("folder").isNull() | (F.col("folder") == F.col("n_regionkey"))))
    return first(rows, ["name"], "n_nationkey").select("name", "n_nationkey")


def counters(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return o.join(F.broadcast(read(spark, d, "customer").agg(F.count("*").alias("customers")))).join(F.broadcast(read(spark, d, "embeddings").agg(F.count("embedding").alias("vectors"))))


def eviction_order(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("started")).orderBy("started", "user_id").limit(20)
    return s.withColumn("place", F.row_number().over(Window.orderBy("started", "user_id"))).select("user_id", "place")


def current_counts(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    newest = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    n = li.join(newest, ["l_orderkey", "l_linenumber"], "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return read(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


def gathered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines in order as JSON; an order has seven at most."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("lines"))


def engine_counts(spark: SparkSession, d: str) -> DataFrame:
    host = F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://([^/?#]*)", 1), F.lit("")), F.lit("unknown"))
    return read(spark, d, "pages").groupBy(host.alias("engine")).agg(F.count("*").alias("n"))


def engine_order(spark: SparkSession, d: str) -> DataFrame:
    kind = F.split("p_type", " ")[0]
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), kind), F.lit(99))
    return read(spark, d, "part").select("p_partkey", rank.alias("rank"), "p_retailprice").orderBy("rank", F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey", "rank")


def run_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's answers after one another, an answer's blocks in order of turn."""
    blocks = read(spark, d, "conversations").where("role = 'assistant'")
    return blocks.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 256).alias("sha"))


def history_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names of a conversation's last six turns before the newest, ranked by recency weights; names of several words first."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    turns = read(spark, d, "conversations").withColumn("back", back).where("back between 2 and 7")
    names = turns.select("conv_id", (8 - F.col("back")).alias("w"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"), F.lit(0)))).alias("name"))
    score = names.groupBy("conv_id", "name").agg(F.sum("w").alias("score")).withColumn("many", F.col("name").contains(" "))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("many"), F.desc("score"), "name"))
    return score.withColumn("place", place).where("place <= 3").select("conv_id", "name", "score", "place")


def portrait_order(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 3).otherwise(7)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(category, F.desc("value"), "event_id"))
    return read(spark, d, "events").withColumn("place", place).where("place <= 5").select("user_id", "event_id", "place")


def memory_queue(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).when(F.col("o_orderpriority").startswith("3"), 2).otherwise(3)
    rows = read(spark, d, "orders").where("o_orderstatus = 'O'")
    return library.queue_order(rows.withColumn("kind", kind), ["kind", "o_orderdate", "o_orderkey"], 60).select("o_orderkey", "position")


def candidate_budget(k: int, deep: bool, most: int = 500) -> tuple[int, int]:
    """(candidates of a leg, rows that are ranked anew) for k results."""
    return min(most, max(k * (6 if deep else 4), k)), min(max(k, 24), most)


def pinned_first(spark: SparkSession, d: str) -> DataFrame:
    """Pinned rows first, in their new rank where they have one, then the others, cut to k within the budget."""
    k = 20
    rows, ranked = candidate_budget(k, False)
    pool = read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(rows).withColumn("pinned", F.col("o_orderkey") % 9 == 0)
    return pool.orderBy(F.desc("pinned"), F.desc("o_totalprice"), "o_orderkey").limit(min(k, ranked)).select("o_orderkey", "pinned")


def files_once(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of each file among the best candidates, up to the limit."""
    limit = 12
    near = read(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(min(60, 4 * limit))
    return first(near, ["l_suppkey"], F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_suppkey").limit(limit).select("l_suppkey", "l_orderkey")


def next_numbers(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("m"))
    ids = read(spark, d, "orders").select(F.col("o_orderkey").alias("conv_id"))
    return ids.join(m, "conv_id", "left").select("conv_id", (F.coalesce("m", F.lit(-1)) + 1).alias("next"))


def related_union(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.where("l_quantity > 45").select(F.col("l_partkey").alias("k")).union(li.where("l_discount >= 0.1").select("l_partkey")).distinct()


def jobs_of(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs: attempts, times, a lease and a cancellation."""
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 3).alias("revision"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("state"), (F.col("o_orderkey") % 4).alias("attempts"), F.col("o_orderdate").alias("available_at"), F.lit("w").alias("lease_owner"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderdate")).alias("cancelled_at"), F.when(F.col("o_orderstatus") == "F", "model_down").otherwise("x").alias("error_code"))


def deferred_jobs(spark: SparkSession, d: str) -> DataFrame:
    fences = read(spark, d, "orders").where("o_custkey % 5 > 0").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 2).alias("desired_revision"))
    return mutations.released(jobs_of(spark, d), fences, ["file_id"], F.lit(90), refund=True).select("file_id", "state", "attempts", "available_at", "lease_owner")


def recovered_jobs(spark: SparkSession, d: str) -> DataFrame:
    return mutations.recoverable(jobs_of(spark, d), "model_down").select("file_id", "state", "attempts", "error_code")


def files_of(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("file_id"), F.col("c_nationkey").alias("folder_id"), (F.col("c_custkey") % 3 > 0).alias("granted"), F.when(F.col("c_custkey") % 4 > 0, 1).alias("current_revision"), F.when(F.col("c_custkey") % 4 > 0, "ready").when(F.col("c_custkey") % 8 == 0, "running").otherwise("failed").alias("status"), (F.col("c_custkey") % 11 == 0).alias("is_deleted"))


def revoked_files(spark: SparkSession, d: str) -> DataFrame:
    jobs = read(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("state"))
    gone = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("file_id"))
    files, kept, stopped = mutations.revoke(files_of(spark, d), jobs, jobs, gone)
    n = kept.groupBy("file_id").agg(F.count("*").alias("n_chunks")).join(stopped.groupBy("file_id").agg(F.count_if(F.col("state") == "cancelled").alias("n_cancelled")), "file_id", "full_outer")
    return files.join(n, "file_id", "left").select("file_id", "granted", "current_revision", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_cancelled", F.lit(0)).alias("n_cancelled"))


def trashed_files(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("parent_id"), F.col("n_name").alias("name"))
    return mutations.trashed(files_of(spark, d), library.tree_paths(r.unionByName(n)), 1002).select("file_id", "status", "is_deleted")


def scoped_chats(spark: SparkSession, d: str) -> DataFrame:
    chats = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("files"), F.lit("old"), F.lit("mode"), F.col("c_mktsegment"))).alias("scope"))
    out = mutations.with_scope(chats, F.col("c_custkey").cast("string"))
    return out.select("c_custkey", F.col("scope")["files"].alias("files"), F.col("scope")["mode"].alias("mode"))


def swapped_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").where("embedding is not null")
    fresh = e.select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    return mutations.swap_embeddings(e, fresh, "vec_id", 64).select("vec_id", "label", F.round(F.element_at("embedding", 1), 6).cast("double").alias("first"))


def expired_deleted(spark: SparkSession, d: str) -> DataFrame:
    due = read(spark, d, "orders").where("o_orderdate < '1995-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return mutations.delete_using(read(spark, d, "customer"), due, ["c_custkey"]).select("c_custkey")


def enriched_current(spark: SparkSession, d: str) -> DataFrame:
    """A later description is written only where its revision is still the current one."""
    files = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("revision"), F.lit("pending").alias("summary"))
    made = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max("l_linenumber") % 3).alias("made_for"), F.count("*").cast("string").alias("text"))
    return mutations.update_from(files, made, ["o_orderkey"], {"summary": F.col("text")}, F.col("made_for") == F.col("revision"))


def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").where("embedding is not null and size(embedding) = 64")
    claim = F.array(*(F.lit(float(x)) for x in e.where("vec_id = 0").first()["embedding"]))
    url = F.concat(F.lit("https://"), nth(["example.org", "bit.ly", "a.com"], F.col("vec_id")), F.lit("/x"))
    rows = answers.cited(e, url, F.lit("t"), F.lit("c"), F.lit("q"), F.col("embedding"), claim, ["label"])
    return rows.select("vec_id", "relevance_score")


def keyword_sources(spark: SparkSession, d: str) -> DataFrame:
    return answers.cited(read(spark, d, "benchmark"), F.lit("https://example.org/"), F.lit("t"), F.col("text"), F.lit("What did the land and sea ask?")).select("item_id")


def evidence_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(answers, evidence) of runs: each nation's customers, one file for each segment."""
    c = read(spark, d, "customer").withColumn("run", F.col("c_nationkey"))
    shown = c.where("c_custkey % 3 > 0").select("run", F.col("c_mktsegment").alias("file"), F.concat(F.lit("Seller "), F.initcap(F.lower("c_mktsegment")), F.lit(" holds "), F.col("c_custkey").cast("string"), F.lit(" rain")).alias("text"))
    said = c.where("c_custkey % 3 < 2").select("run", F.concat(nth(DENY, F.col("c_custkey")), F.lit("Owner "), F.initcap(F.lower(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("Machinery")))), F.lit(" holds "), F.col("c_custkey").cast("string"), F.lit(" now.")).alias("text"))
    return said, shown


def unattributed_numbers(spark: SparkSession, d: str) -> DataFrame:
    said, shown = evidence_of(spark, d)
    return answers.unattributed_numbers(said, shown, "run", "file", "text")


def ungrounded_numbers(spark: SparkSession, d: str) -> DataFrame:
    said, shown = evidence_of(spark, d)
    return answers.ungrounded_numbers(said, shown.where("file <> 'BUILDING'"), shown.where("file = 'BUILDING'").limit(0), "run", "text")


def false_denials(spark: SparkSession, d: str) -> DataFrame:
    said, shown = evidence_of(spark, d)
    return answers.false_denials(said, shown, "run", "file", "text")


def supported_relations(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    asked = c.select(F.col("c_nationkey").alias("run"), F.initcap(F.lower("c_mktsegment")).alias("entity"), F.concat(F.lit("holds "), F.col("c_custkey").cast("string"), F.lit(" extra more")).alias("value"))
    shown = evidence_of(spark, d)[1].withColumn("item", F.xxhash64("text"))
    return answers.supported_relations(asked, shown, "run", "item", "text")


QUERIES = {f.__name__: f for f in (
    untagged_parts, best_or_null, json_key_join, ordered_lookup, resolved_mentions, counters, eviction_order, current_counts, gathered_lines, engine_counts, engine_order, run_texts, history_entities,
    portrait_order, memory_queue, pinned_first, files_once, next_numbers, related_union, deferred_jobs, recovered_jobs, revoked_files, trashed_files, scoped_chats, swapped_embeddings, expired_deleted,
    enriched_current, cited_sources, keyword_sources, unattributed_numbers, ungrounded_numbers, false_denials, supported_relations,
)}

JOBS = "(SELECT o_orderkey AS file_id, o_custkey % 3 AS revision, CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS state, o_orderkey % 4 AS attempts, o_orderdate AS available_at, o_orderkey % 10 = 0 AS cancelled, CASE WHEN o_orderstatus = 'F' THEN 'model_down' ELSE 'x' END AS error_code, o_custkey FROM orders)"
FILES = "(SELECT c_custkey AS file_id, c_nationkey AS folder_id, c_mktsegment, c_custkey % 3 > 0 AS granted, CASE WHEN c_custkey % 4 > 0 THEN 1 END AS current_revision, CASE WHEN c_custkey % 4 > 0 THEN 'ready' WHEN c_custkey % 8 = 0 THEN 'running' ELSE 'failed' END AS status, c_custkey % 11 = 0 AS is_deleted FROM customer)"
EVIDENCE = "(SELECT c_nationkey AS run, c_mktsegment AS file, c_custkey AS n FROM customer WHERE c_custkey % 3 > 0)"
SAID = "(SELECT c_nationkey AS run, c_custkey AS n, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'MACHINERY' END AS entity FROM customer WHERE c_custkey % 3 < 2)"

ORACLE_SQL = {
    "untagged_parts": "SELECT p_partkey FROM part WHERE p_size <= 40",
    "best_or_null": """
SELECT c_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS done FROM customer LEFT JOIN orders ON c_custkey = o_custkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY done DESC NULLS LAST, o_orderkey NULLS FIRST) = 1""",
    "json_key_join": "SELECT n_name, count(*) AS n FROM events JOIN nation ON json_extract(props, '$.k')::BIGINT = n_nationkey GROUP BY n_name",
    "ordered_lookup": "SELECT p::INT AS place, o_orderkey, o_orderstatus FROM (VALUES (0, 90), (1, 7), (2, 7), (3, 100000000), (4, 33), (5, 1)) v(p, k) JOIN orders ON o_orderkey = k",
    "resolved_mentions": "SELECT v.name, min(n_nationkey) AS n_nationkey FROM (VALUES ('nation_3', NULL), ('NATION_7', 2), ('Nation_99', NULL)) v(name, folder) JOIN nation ON lower(v.name) = lower(n_name) AND (folder IS NULL OR folder = n_regionkey) GROUP BY v.name",
    "counters": "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open, (SELECT count(*) FROM customer) AS customers, (SELECT count(embedding) FROM embeddings) AS vectors",
    "eviction_order": "SELECT user_id, (row_number() OVER (ORDER BY min(ts), user_id))::INT AS place FROM events GROUP BY user_id QUALIFY place <= 20",
    "current_counts": "SELECT o_orderkey, (SELECT count(*) FROM lineitem a WHERE a.l_orderkey = o_orderkey AND a.l_linenumber = (SELECT max(b.l_linenumber) FROM lineitem b WHERE b.l_orderkey = o_orderkey)) AS n FROM orders",
    "gathered_lines": """SELECT l_orderkey, '[' || string_agg('{"n":' || l_linenumber || ',"p":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS lines FROM lineitem GROUP BY l_orderkey""",
    "engine_counts": "SELECT coalesce(nullif(regexp_extract(url, '^https?://([^/?#]*)', 1), ''), 'unknown') AS engine, count(*) AS n FROM pages GROUP BY 1",
    "engine_order": "SELECT p_partkey, (CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'SMALL' THEN 2 ELSE 99 END)::INT AS rank FROM part ORDER BY rank, p_retailprice DESC, p_partkey LIMIT 40",
    "run_texts": "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS sha FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "history_entities": r"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
n AS (SELECT conv_id, 8 - back AS w, unnest(list_distinct(regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*'))) AS name FROM t WHERE back BETWEEN 2 AND 7), s AS (SELECT conv_id, name, sum(w)::BIGINT AS score FROM n GROUP BY ALL)
SELECT conv_id, name, score, (row_number() OVER (PARTITION BY conv_id ORDER BY contains(name, ' ') DESC, score DESC, name))::INT AS place FROM s QUALIFY place <= 3""",
    "portrait_order": "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 3 ELSE 7 END, value DESC, event_id))::INT AS place FROM events QUALIFY place <= 5",
    "memory_queue": "SELECT o_orderkey, (row_number() OVER (ORDER BY CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END, o_orderdate, o_orderkey))::INT AS position FROM orders WHERE o_orderstatus = 'O' QUALIFY position <= 60",
    "pinned_first": "WITH p AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 80) SELECT o_orderkey, o_orderkey % 9 = 0 AS pinned FROM p ORDER BY pinned DESC, o_totalprice DESC, o_orderkey LIMIT 20",
    "files_once": """
WITH p AS (SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 48), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) = 1)
SELECT l_suppkey, l_orderkey FROM f ORDER BY l_extendedprice DESC, l_orderkey, l_suppkey LIMIT 12""",
    "next_numbers": "SELECT o_orderkey AS conv_id, (SELECT coalesce(max(turn), -1) + 1 FROM conversations c WHERE c.conv_id = o_orderkey) AS next FROM orders",
    "related_union": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1",
    "deferred_jobs": f"""
WITH j AS (SELECT *, NOT cancelled AND o_custkey % 5 > 0 AND o_custkey % 2 = revision AS ok FROM {JOBS})
SELECT file_id, CASE WHEN ok THEN 'queued' ELSE state END AS state, CASE WHEN ok THEN greatest(0, attempts - 1) ELSE attempts END AS attempts, CASE WHEN ok THEN available_at + INTERVAL 90 SECOND ELSE available_at END AS available_at, CASE WHEN NOT ok THEN 'w' END AS lease_owner FROM j""",
    "recovered_jobs": f"""
WITH j AS (SELECT *, state = 'failed' AND error_code = 'model_down' AS hit FROM {JOBS})
SELECT file_id, CASE WHEN hit THEN 'queued' ELSE state END AS state, CASE WHEN hit THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT hit THEN error_code END AS error_code FROM j""",
    "revoked_files": f"""
WITH f AS (SELECT *, c_mktsegment = 'BUILDING' AS gone FROM {FILES}), o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS q FROM orders GROUP BY o_custkey)
SELECT file_id, granted AND (NOT gone OR is_deleted) AS granted, CASE WHEN NOT gone OR is_deleted THEN current_revision END AS current_revision, CASE WHEN gone AND NOT is_deleted THEN 'not_granted' ELSE status END AS status,
  CASE WHEN gone THEN 0 ELSE coalesce(n, 0) END AS n_chunks, CASE WHEN gone THEN coalesce(q, 0) ELSE 0 END AS n_cancelled FROM f LEFT JOIN o ON o_custkey = file_id""",
    "trashed_files": f"""
WITH f AS (SELECT *, folder_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AS gone FROM {FILES})
SELECT file_id, CASE WHEN NOT gone THEN status WHEN NOT granted THEN 'not_granted' WHEN current_revision IS NOT NULL THEN 'ready' WHEN status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status, is_deleted OR gone AS is_deleted FROM f""",
    "scoped_chats": "SELECT c_custkey, c_custkey::VARCHAR AS files, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS mode FROM customer",
    "swapped_embeddings": "SELECT vec_id, label, round(-embedding[1], 6)::DOUBLE AS first FROM embeddings WHERE embedding IS NOT NULL",
    "expired_deleted": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1995-01-01')",
    "enriched_current": """
SELECT o_orderkey, o_orderkey % 3 AS revision, CASE WHEN m % 3 = o_orderkey % 3 THEN n::VARCHAR ELSE 'pending' END AS summary FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "cited_sources": f"""
WITH s AS (SELECT vec_id, label, round(greatest(0.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], {CLAIM}))), 4) AS relevance_score FROM embeddings WHERE vec_id % 3 <> 1)
SELECT vec_id, relevance_score FROM (SELECT *, max(relevance_score) OVER (PARTITION BY label) AS best FROM s) WHERE relevance_score >= 0.5 OR best = 0""",
    "keyword_sources": "SELECT item_id FROM benchmark WHERE regexp_matches(lower(text), 'land|sea|ask')",
    "unattributed_numbers": f"""
WITH e AS {EVIDENCE}, s AS {SAID} SELECT DISTINCT s.run, s.n::VARCHAR AS number FROM s JOIN e USING (run, n)
WHERE (SELECT count(DISTINCT file) FROM e f WHERE f.run = s.run) > 1 AND e.file <> s.entity""",
    "ungrounded_numbers": f"SELECT run, n::VARCHAR AS number FROM {SAID} WHERE (run, n) NOT IN (SELECT (run, n) FROM {EVIDENCE} WHERE file <> 'BUILDING')",
    "false_denials": f"""
SELECT DISTINCT run, 'rain' AS head FROM {SAID} s WHERE n % 4 = 0 AND (SELECT count(DISTINCT file) FROM {EVIDENCE} e WHERE e.run = s.run) > 1""",
    "supported_relations": f"""
SELECT c_nationkey AS run, c_mktsegment[1] || lower(c_mktsegment[2:]) AS entity, 'holds ' || c_custkey || ' extra more' AS value FROM customer JOIN {EVIDENCE} e ON e.run = c_nationkey AND e.n = c_custkey AND e.file = c_mktsegment WHERE c_custkey >= 100""",
}
