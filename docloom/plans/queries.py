"""The library's queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import facts, questions, scores, text
from docloom.operators import chunks, evidence, grounding, jobs, library, memory, retrieval, web
from docloom.sources import readers, sinks

HINTS = {"letter": ["the", "and"], "note": ["que", "les"], "report": ["der", "und"], "sheet": ["%%%", "***"]}
PHRASE, RARE = "license", ["copyright", "license", "general", "loser", "zebra"]
STATES = [("click", "view"), ("view", "click"), ("view", "purchase"), ("click", "purchase"), ("signup", "view"), ("purchase", "view"), ("view", "view")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(vectors: DataFrame) -> list[float]:
    return [float(x) for x in vectors.where("vec_id = 0").select("embedding").first()[0]]


def vector_leg(spark: SparkSession, d: str, k: int = 500) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    return retrieval.vector_leg(vectors, query_vector(vectors), ["vec_id"], k)


def hybrid_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector_leg(spark, d, 20).withColumn("vector_score", F.round("vector_score", 6))


def hybrid_blend(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    near = vector_leg(spark, d, 100).withColumnRenamed("vec_id", "doc_id")
    literal = retrieval.literal_leg(docs, PHRASE, "source", ["doc_id"]).select("doc_id", "literal_match")
    rows = retrieval.blend([near, literal], ["doc_id"])
    top = rows.orderBy(F.desc("literal_match"), F.desc(F.round("score", 6)), "doc_id").limit(50)
    return top.select("doc_id", "literal_match", F.round("score", 6).alias("score"))


def literal_pin(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.literal_leg(read(spark, d, "documents"), PHRASE, "source", ["doc_id"]).select("source", "doc_id")


def rare_term_pin(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rare_term_leg(read(spark, d, "documents"), RARE, "doc_id", most=60)


def file_scope_cap(spark: SparkSession, d: str) -> DataFrame:
    near = vector_leg(spark, d, 200).join(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("vector_score"), "vec_id"))).withColumn("q", F.lit(1))
    return retrieval.file_scope_cap(ranked, ["q"], "label", "rank", 3).select("vec_id", "label", "rank")


def scoped_representation(spark: SparkSession, d: str) -> DataFrame:
    near = vector_leg(spark, d).join(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id").withColumn("score", F.round("vector_score", 6)).select("vec_id", "label", "score")
    kept = near.orderBy(F.desc("score"), "vec_id").limit(5)
    return retrieval.scoped_representation(kept, near, "label", "score", ["vec_id"])


def discovery_floor(spark: SparkSession, d: str) -> DataFrame:
    rows = vector_leg(spark, d).withColumn("score", F.round("vector_score", 6))
    return retrieval.discovery_floor(rows, F.col("score"), F.col("vec_id") % 97 == 0).select("vec_id", "score")


def rerank_floor(spark: SparkSession, d: str) -> DataFrame:
    near = vector_leg(spark, d).join(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    scored = near.withColumn("rerank_score", F.when(F.col("vec_id") % 3 > 0, F.round("vector_score", 6)))
    return retrieval.rerank_floor(scored, ["label"]).select("vec_id", "label", "rerank_score")


def eligible_chunks(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    files = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).cast("int").alias("user_id"), (F.col("o_orderpriority") < "3").alias("user_granted_ai_access"), (F.col("o_orderstatus") == "F").alias("is_deleted"), F.lit(1).alias("current_revision"))
    parts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("revision"), F.col("l_partkey").alias("chunk_id"))
    owners = files.select(F.col("id").alias("file_id"), "user_id")
    rows = parts.join(owners, "file_id")
    revisions = rows.select("file_id", "revision", "user_id").distinct().withColumn("status", F.when(F.col("revision") == 1, "current").otherwise("old"))
    return retrieval.eligible(rows, revisions, files, 3).select("file_id", "revision", "chunk_id")


def account_counts(spark: SparkSession, d: str) -> DataFrame:
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("open", F.lit(0)).alias("n_open"))


def storage_rollup(spark: SparkSession, d: str) -> DataFrame:
    live = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.coalesce(F.sum(live), F.lit(0.0)), 2).alias("used"), F.count(live).alias("n_live"))


def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("parent_id"), F.col("n_name").alias("name"))
    found = library.tree_rollup(r.unionByName(n), read(spark, d, "customer"), "c_nationkey", "c_acctbal")
    return found.select("id", "n_items", F.round("total_size", 2).alias("total_size"))


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("parent_id"), F.col("n_name").alias("name"))
    return library.tree_paths(r.unionByName(n)).select("id", F.concat(F.lit("/"), "path").alias("path")).distinct()


def tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    tags = read(spark, d, "documents").select(F.explode(F.array_distinct(text.normalized_words("text"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def paged_list(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return library.page_with_total(rows, [F.desc("o_orderdate"), "o_orderkey"], 3, 100).select("o_orderkey", "total")


def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return memory.supersede(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def semi_has_reply(spark: SparkSession, d: str) -> DataFrame:
    return library.with_reply(read(spark, d, "conversations")).select("conv_id", "turn")


def pair_complete_turns(spark: SparkSession, d: str) -> DataFrame:
    return library.paired_turns(read(spark, d, "conversations")).select("conv_id", "turn", "role")


def history_budget(spark: SparkSession, d: str) -> DataFrame:
    return library.history_budget(read(spark, d, "conversations"), 1500, 3).select("conv_id", "turn", "text")


def heal_stale(spark: SparkSession, d: str) -> DataFrame:
    late = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(late, "o_orderkey", "left_anti").select("o_orderkey")


def diverse_pick(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").withColumn("engine", F.regexp_extract("url", r"^https?://([a-z]+)\.", 1))
    return retrieval.diverse_pick(pages, "engine", ["page_id"], 30).select("page_id", "engine", "turn")


def canonical_url_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return evidence.source_cards(read(spark, d, "pages").withColumn("s", F.lit(1.0)), "url", "page_id", "s").select("canonical", "rank", "n_rows")


def boilerplate_flags(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    title, body = readers.page_title(F.col("html")), readers.page_text(F.col("html"))
    return pages.select("page_id", text.furniture_hits("html").alias("hits"), text.is_promotional(title, "url").alias("promotional"), text.is_generic(title, body).alias("generic"))


def page_elements(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", readers.page_title(F.col("html")).alias("title"), readers.page_text(F.col("html")).alias("body"))


def keyword_gate(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*(F.lit(w) for w in ("license", "version", "works")))
    return read(spark, d, "documents").where(evidence.keyword_gate("text", words)).select("doc_id")


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    plain = docs.select("doc_id", text.redact_credentials("text").alias("plain"))
    return plain.select("doc_id", F.sha2("plain", 256).alias("redacted_sha"), F.sha2(text.redact_quoted("plain"), 256).alias("quoted_sha"))


def sensitive_screen(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.sensitive_kind("text").alias("kind")).where("kind is not null")


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.token_count("text").cast("long").alias("n_tokens"))


def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(text.normalize_text("text"), 256).alias("sha"))


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    made = chunks.chunk_documents(read(spark, d, "documents"))
    return made.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").cast("long").alias("n_tokens"), F.max("token_count").alias("most"))


def text_elements(spark: SparkSession, d: str) -> DataFrame:
    found = readers.text_elements(read(spark, d, "documents"))
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.sha2("text", 256).alias("sha"), "line_start", "line_end")


def doc_classify(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", evidence.classify("text", HINTS).alias("kind"))


def ngram_topics(spark: SparkSession, d: str) -> DataFrame:
    found = evidence.ranked_topics(evidence.document_topics(read(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return found.withColumn("width", F.col("width").cast("long"))


def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.extractive_summary("text").alias("summary"))


def fingerprint_upsert(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select(scores.fingerprint(F.lit("fact"), "role", F.lit("said"), "text").alias("fp"), (F.col("turn") / 8).alias("confidence"), (F.col("turn") > 2).alias("active"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn") % 28).cast("int")).alias("at"))
    return memory.upsert(turns, ["fp"], 90).select("fp", "confidence", "active", "revision", "expires_on")


def supersede_latest(spark: SparkSession, d: str) -> DataFrame:
    return memory.supersede(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def drift_report(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("k"), F.lit("R").alias("v"))
    li = read(spark, d, "lineitem").where("l_linenumber = 1 and l_orderkey % 5 > 0").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("v"))
    return memory.drift(o, li, "k", "v")


def two_hop_related(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return memory.two_hops(li, "l_orderkey", "l_partkey", li.where("l_orderkey = 1"))


def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    return memory.recall(read(spark, d, "benchmark"), ["the", "of", "le", "der"], "text", ["item_id"], 8).select("item_id", "matched")


def session_activity(spark: SparkSession, d: str) -> DataFrame:
    return library.sessions(read(spark, d, "events"), "user_id", "ts", "120 minutes")


def queue_order(spark: SparkSession, d: str) -> DataFrame:
    jobs = read(spark, d, "orders")
    return library.queue_order(jobs, ["o_orderpriority", F.asc_nulls_last("o_totalprice"), "o_orderdate", "o_orderkey"], 50).select("o_orderkey", "position")


def job_state_fold(spark: SparkSession, d: str) -> DataFrame:
    found = library.fold_states(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", STATES)
    return found.select("event_id", "previous", "valid")


def date_math(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    moved = [scores.shifted_date(day, n, u).alias(f"plus_{u}") for n, u in ((3, "day"), (2, "week"), (5, "month"), (1, "year"))]
    return o.select("o_orderkey", *moved, scores.date_side(day, F.lit("1996-06-01")).alias("side"))


def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", scores.evidence_score(F.col("value") / 100, F.lit(None)).alias("score"), text.match_percentage(F.floor("value") + 0.5).alias("percent"))


def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.array_join(text.iso_dates("text"), ",").alias("dates"), F.array_join(text.canonical_numbers("text"), ",").alias("numbers"))


def ungrounded_claims(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", F.explode(text.normalized_words("text")).alias("atom")).distinct()
    return evidence.ungrounded(asked, turns.where("role = 'assistant'"), "conv_id", "atom", "text")


def mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("doc"), "l_suppkey", "l_partkey").agg(F.min("l_quantity").alias("distance"))
    return evidence.mutual_pairs(rows, "doc", "l_suppkey", "l_partkey", "distance").select("doc", "l_suppkey", "l_partkey")


def word_stems(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "documents").select(F.explode(text.normalized_words("text")).alias("w")).distinct()
    return words.select("w", text.singular("w").alias("variant"), text.plural_stem("w").alias("stem"), text.consonants("w").alias("bones"))


def route_files(spark: SparkSession, d: str) -> DataFrame:
    names = F.concat(F.lit("f."), F.element_at(F.array(*(F.lit(x) for x in ("pdf", "txt", "csv", "docx", "zzz", "mp3"))), (F.col("page_id") % 6 + 1).cast("int")))
    media = F.element_at(F.array(*(F.lit(x) for x in ("application/pdf", "text/plain", "application/octet-stream", "audio/mpeg", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", readers.route(names, media).alias("parser"))


def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    old = c.where("c_custkey % 3 > 0").withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.col("c_name")))
    return sinks.changed_only(c, old, "c_custkey").select("c_custkey")


def lexical_leg(spark: SparkSession, d: str) -> DataFrame:
    return web.lexical_scores(read(spark, d, "documents"), "doc_id", text.normalized_words("text"), ["license", "version", "the"], 40)


def merge_legs(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pages").select(text.canonical_url("url").alias("key"), (F.col("page_id") % 3).alias("leg"), F.col("page_id").alias("place"), (F.col("page_id") % 4 == 0).alias("relevant"))
    return web.merge_legs(rows, "key", "leg", "place", "relevant").select("key", "leg", "place", "relevant", "first_leg", "first_place")


def web_order(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").withColumn("host", F.lower(F.regexp_extract("url", r"^https?://([^/?#]*)", 1)))
    flags = (F.col("page_id") % 2 == 0), F.col("url").contains("utm_"), text.furniture_hits("html") >= 2
    top = pages.orderBy(*web.web_order(*flags), "page_id").limit(25)
    return top.select("page_id", "host")


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    return web.envelopes(rows, "l_suppkey", "rank").select("l_suppkey", "rank", "file_rank", "label")


def evidence_registry(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("kind", F.when(F.col("event_id") % 2 == 0, "vault").otherwise("web")).withColumn("item", F.floor("value"))
    return web.registry(rows, "user_id", "kind", "item", "event_id").select("user_id", "item", "label")


def keep_files(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("place"))
    return web.keep_files(rows, "l_orderkey", "l_returnflag", "place", 3)


def relevance_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("place"), (F.col("l_returnflag") == "R").alias("flag"))
    return web.pool(rows, "l_orderkey", "flag", "place", 3)


def rescue_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("place"), (F.col("l_returnflag") == "R").alias("flag"), "l_quantity")
    return web.rescue(rows, "l_orderkey", "flag", "place", F.col("l_quantity") / 50).select("l_orderkey", "place", "flag")


def representative_sample(spark: SparkSession, d: str) -> DataFrame:
    return web.representative_sample(read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 12)


def row_digests(spark: SparkSession, d: str) -> DataFrame:
    return web.row_digest(read(spark, d, "orders"), ["o_orderstatus"], ["o_orderkey", "o_custkey"])


def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer").where("c_custkey % 4 > 0")
    lost = web.orphans(o.select(F.col("o_custkey").alias("k")), c, "k", "c_custkey").agg(F.count("*").alias("n"))
    twice = web.duplicates(o, ["o_custkey", "o_orderstatus"]).agg(F.count("*").alias("n"))
    return lost.select(F.lit("orphans").alias("what"), "n").unionByName(twice.select(F.lit("duplicates").alias("what"), "n"))


def identity_facts(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("my name is ", "maybe call me ", "i prefer metric units ", "my wife said my name is ", "hello "))), (F.col("turn") % 5 + 1).cast("int")), F.col("role"))
    return read(spark, d, "conversations").select("conv_id", "turn", facts.identity_fact(said).alias("f")).where("f is not null").select("conv_id", "turn", "f.predicate", "f.value")


def memory_verdicts(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("said", F.concat(F.element_at(F.array(*(F.lit(x) for x in ("he ", "I think ", "password: abcdef ", "I like "))), (F.col("turn") % 4 + 1).cast("int")), F.left("text", F.lit(5))))
    return turns.select("conv_id", "turn", facts.memory_verdict("said", F.col("turn") / 6, F.col("role") == "user").alias("verdict"))


def exact_calculator(spark: SparkSession, d: str) -> DataFrame:
    whole = lambda c: F.col(c).cast("long").cast("string")
    asked = F.concat(F.lit("What is ("), whole("l_quantity"), F.lit(" + "), whole("l_linenumber"), F.lit(") * 3 - "), whole("l_partkey"), F.lit(" / 4 ?"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", facts.calculated(facts.expression_in(asked)).alias("value"))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    ready, fit = F.col("o_orderstatus") == "O", F.col("o_orderpriority") < "4"
    rows = o.groupBy((F.col("o_custkey") % 50).alias("owner")).agg(F.count("*").alias("n_files"), F.count_if(fit).alias("eligible"), F.count_if(fit & ready).alias("ready"), F.count_if(~fit & (F.col("o_orderstatus") == "F")).alias("failed"))
    return rows.withColumn("percent", F.when(F.greatest("eligible", "ready") > 0, F.floor(F.col("ready") * 100 / F.greatest("eligible", "ready"))).otherwise(0).cast("long"))


def sentence_union(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    key = F.lower(F.regexp_replace("line", "[.!?]+$", ""))
    return lines.groupBy(F.sha2(key, 256).alias("key")).agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def nearest_dates(spark: SparkSession, d: str) -> DataFrame:
    o, day = read(spark, d, "orders"), F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", scores.nearest_year_date(F.month(day), F.day(day), F.lit("2023-03-01"), True).alias("ahead"), scores.nearest_year_date(F.month(day), F.day(day), F.lit("2023-03-01"), False).alias("back"))


def grade_report(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") >= 20).cast("double")) * 100, 4).alias("rate"))
    return e.withColumn("grade", F.when(F.col("rate") >= 90, "A").when(F.col("rate") >= 75, "B").when(F.col("rate") >= 60, "C").otherwise("D"))


def claim_atoms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(grounding.claim_atoms("text"), "|").alias("atoms"))


def grounding_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(grounding.grounding_text("text"), 256).alias("sha"))


def folded_tags(spark: SparkSession, d: str) -> DataFrame:
    """The names and numbers of each turn, and the names' words, folded to tags."""
    names = read(spark, d, "conversations").select("conv_id", "turn", grounding.claim_atoms("text").alias("a"))
    tags = F.concat("a", F.flatten(F.transform("a", lambda x: F.split(x, " "))))
    return names.select("conv_id", "turn", F.array_join(grounding.fold_tags(tags), "|").alias("tags"))


def tags_evidenced(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "conversations").withColumn("w", text.normalized_words("text"))
    return t.where(grounding.tag_is_evidenced(F.lit("is the"), F.col("w"))).select("conv_id", "turn")


def pairing_mismatches(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    shown = li.where("l_linenumber > 1").select((F.col("l_orderkey") % 40).alias("file"), F.col("l_suppkey").alias("entity"), F.col("l_quantity").alias("number"))
    said = li.where("l_linenumber = 1").select((F.col("l_orderkey") % 40).alias("file"), F.col("l_suppkey").alias("entity"), F.col("l_quantity").alias("number")).distinct()
    return grounding.pairing_mismatches(said, shown, "file")


def recall_terms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(questions.recall_terms("text")), " ").alias("terms"), F.array_join(F.array_sort(questions.rare_words("text", 1_000_000)), " ").alias("rare"))


def enqueue_revisions(spark: SparkSession, d: str) -> DataFrame:
    found = jobs.enqueue(read(spark, d, "events").withColumn("key", F.floor("value")), "user_id", "key", "event_id")
    return found.select("event_id", F.col("revision").cast("long").alias("revision"), "reused")


def claim_states(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    state = jobs.claim_state(F.col("o_custkey") % 4, F.lit(3), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")), F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderstatus") == "P")
    return o.select("o_orderkey", state.alias("state"))


def summary_states(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    seen = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("rev")).where("user_id % 5 > 0")
    return jobs.summary_state(seen, e.where("user_id % 7 > 0").select("user_id", F.col("event_id").alias("rev")), "user_id", "rev")


def fenced_results(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("generation", F.to_date("ts"))
    current = e.groupBy("user_id").agg(F.max("generation").alias("generation"))
    return jobs.fenced(e, current, "user_id", "generation").select("event_id")


def resolved_scopes(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = read(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("n")).where("n <= 5")  # all that the scopes below name
    per = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("files"))
    allowed = F.filter("files", lambda x: x % 3 > 0)
    scope = jobs.resolve_scope(F.slice("files", 1, 2), F.filter(F.slice("files", 3, 1), lambda x: x % 3 > 0), F.slice("files", 4, 2), allowed)
    return per.select("o_custkey", F.array_join(scope, ",").alias("scope"))


QUERIES = {f.__name__: f for f in (
    hybrid_vector_topk, hybrid_blend, literal_pin, rare_term_pin, file_scope_cap, scoped_representation, discovery_floor, rerank_floor, eligible_chunks,
    account_counts, storage_rollup, tree_rollup, tree_paths, tag_histogram, paged_list, latest_per_group, semi_has_reply, pair_complete_turns, history_budget,
    heal_stale, diverse_pick, canonical_url_dedupe, boilerplate_flags, page_elements, keyword_gate, exact_duplicates, redact_text, sensitive_screen, token_counts,
    normalized_texts, chunk_counts, text_elements, doc_classify, ngram_topics, extractive_summary, fingerprint_upsert, supersede_latest, drift_report, two_hop_related,
    memory_recall, session_activity, queue_order, job_state_fold, date_math, evidence_scores, extracted_facts, ungrounded_claims, mutual_pairs, word_stems, route_files, changed_rows, lexical_leg, merge_legs, web_order, envelopes,
    evidence_registry, keep_files, relevance_pool, rescue_rows, representative_sample, row_digests, integrity_report, identity_facts, memory_verdicts, exact_calculator,
    index_stats, sentence_union, nearest_dates, grade_report, claim_atoms, grounding_texts, folded_tags, tags_evidenced, pairing_mismatches, recall_terms,
    enqueue_revisions, claim_states, summary_states, fenced_results, resolved_scopes,
)}
