"""Queries of the rules on texts, tags, URLs and cells, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import rules, text
from docloom.functions.rules import words_of
from docloom.operators import grounding

PRESETS = [("en", "query: ", 1800), ("de", "passage: ", 300)]
MARKS = ["scanned by camscanner", "camscanner"]
LEADS = ["Ask who. ", "It rained on 3 March 2021! ", "How so? ", "U. S. rules. ", "see @docs / a.txt and @b.md. ", "Local Purchase Order ", "annual report ", "annual report menu ", "pitch deck ", ""]
ENDS = ["/a/b", "/intent/tweet?u=1", "/shop/cart", "/submit", "/x?price=1", "/share?u=2"]
HOSTS = ["www.bit.ly", "store.apple.com", "example.org", "Samsung.com", "t.me", "news.example.com"]
QUESTIONS = ["Write a short poem", "what is the time", "how tall is it", "sorry, I cannot say", "the for and"]
KINDS = ["letter", "report", "invoice", "blob"]
SUMMARIES = ["A letter on rain.", "", "The content is unclear.", "Numbers."]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nth(values: list[str], key: Column) -> Column:
    """One of the values for each row, in turn by a whole-number key."""
    return F.element_at(words_of(values), (key % len(values) + 1).cast("int"))


def nth_sql(values: list[str], key: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[({key}) % {len(values)} + 1]"


def said(d: DataFrame) -> DataFrame:
    """Turns behind a lead of their own, so that every rule has something to find."""
    return d.withColumn("said", F.concat(nth(LEADS, F.col("conv_id") + F.col("turn")), "text"))


SAID = f"(SELECT *, {nth_sql(LEADS, 'conv_id + turn')} || text AS said FROM conversations)"
URLS = f"(SELECT page_id, 'https://' || {nth_sql(HOSTS, 'page_id')} || {nth_sql(ENDS, 'page_id // 7')} AS u FROM pages)"


def rewrite_stems(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "documents").select(F.explode(text.normalized_words("text")).alias("w")).distinct()
    return w.select("w", rules.rewrite_stem("w").alias("stem"))


def merged_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return said(read(spark, d, "conversations")).select("conv_id", "turn", F.sha2(rules.merged_abbreviations("said"), 256).alias("sha"))


def prose_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    shapes = F.concat_ws(" ; ", F.date_format(day, "d/M/yy"), F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "dd MMM yyyy"), F.lit("99.99.2020"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(rules.prose_dates(shapes), ",").alias("dates"))


def blanked_dates(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at "), F.col("o_custkey"))
    return read(spark, d, "orders").select("o_orderkey", rules.blanked_dates(shown).alias("blanked"))


def script_counts(spark: SparkSession, d: str) -> DataFrame:
    found = rules.script_evidence("text")
    return read(spark, d, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["script"], x["n"].cast("string"))), ",").alias("scripts"))


def plain_pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.sha2(rules.without_directives("html", "div"), 256).alias("sha"))


def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(rules.embedding_input("text", F.col("lang"), PRESETS, 1000), 256).alias("sha"))


def url_verdicts(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("https://"), nth(HOSTS, F.col("page_id")), nth(ENDS, F.floor(F.col("page_id") / 7)))
    return read(spark, d, "pages").select("page_id", F.coalesce(rules.drop_reason(made), F.lit("keep")).alias("made"), F.coalesce(rules.drop_reason("url"), F.lit("keep")).alias("own"))


def public_addresses(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("event_id")
    ip = F.concat_ws(".", nth(["10", "8", "172", "192", "100", "224", "169", "300"], id_), (id_ % 256).cast("string"), ((id_ * 7) % 256).cast("string"), (id_ % 3).cast("string"))
    return read(spark, d, "events").select("event_id", rules.is_public_ipv4(ip).alias("public"))


def document_cues(spark: SparkSession, d: str) -> DataFrame:
    return said(read(spark, d, "conversations")).select("conv_id", "turn", rules.raster_kind("said").alias("kind"), rules.text_shape("said").alias("shape"))


def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", rules.text_shape("text").alias("shape"))


def sensitive_tags(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "customer").select(F.col("c_name").alias("tag")).union(read(spark, d, "part").select(F.concat_ws(" ", nth(["road", "road safety", "iso 9001", "1 town", "x"], F.col("p_partkey")), "p_name"))).union(read(spark, d, "pages").select("url"))
    return names.distinct().select("tag", rules.is_sensitive_tag("tag").alias("sensitive"))


def declared(spark: SparkSession, d: str) -> DataFrame:
    turns = said(read(spark, d, "conversations")).select("conv_id", "turn", rules.declarative_spans("said").alias("spans"))
    span = rules.best_span(F.col("spans"), words_of(["rain", "rules", "the", "and"]))
    return turns.select("conv_id", "turn", F.array_join("spans", "|").alias("spans"), span.alias("best"))


def searchable_queries(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("turn") % 2 == 0, nth(QUESTIONS, F.col("conv_id"))).otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", rules.is_searchable(asked).alias("searchable"), rules.evidence_requirement(asked, F.col("turn") == 3, F.col("conv_id") % 5 == 0, F.col("turn") % 3 == 0).alias("requirement"))


def evidence_gates(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("asked"))
    held = F.exists(rules.content_words("asked"), lambda w: rules.word_in_text(w, F.col("text")))
    rows = turns.where("role = 'assistant'").join(first, "conv_id").withColumn("held", held)
    return rows.groupBy("conv_id").agg(F.bool_or("held").alias("relevant"), F.bool_or(F.length("text") >= 150).alias("sufficient"))


def echo_shares(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = read(spark, d, "conversations").withColumn("before", before).where("before is not null")
    return turns.select("conv_id", "turn", F.round(rules.echo_share("text", "before"), 6).alias("share"))


def mentioned(spark: SparkSession, d: str) -> DataFrame:
    return said(read(spark, d, "conversations")).select("conv_id", "turn", F.array_join(rules.mentions("said"), "|").alias("files"))


def listed_nations(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").where("n_nationkey % 3 > 0 or n_regionkey = 2")
    return n.groupBy("n_regionkey").agg(rules.listed(F.array_sort(F.collect_list("n_name"))).alias("names"))  # a region has few nations


def tag_matches(spark: SparkSession, d: str) -> DataFrame:
    tags, query = F.array("p_brand", "p_type"), nth(["#brand#11", "  Brand#1 ", "# ", "brass"], F.col("p_partkey"))
    target = rules.tag_target(F.col("p_size") > 5, F.col("p_partkey") % 2 == 0)
    return read(spark, d, "part").select("p_partkey", rules.tags_match(tags, query).alias("matched"), target.alias("verdict"))


def watermarked(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(nth(["Scanned by CamScanner ", "scan ", "CamScanner -- "], F.col("event_id")), F.when(F.col("event_id") % 5 < 2, F.lit("")).otherwise(F.col("props")))
    return read(spark, d, "events").select("event_id", rules.only_watermark(page, MARKS).alias("only_mark"))


def cell_grids(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of a table: each line a cell at its number, spanning two columns where it was returned."""
    cell = F.struct(F.col("l_linenumber").alias("column"), F.when(F.col("l_returnflag") == "R", 2).alias("span"), F.col("l_partkey").cast("string").alias("text"))
    rows = read(spark, d, "lineitem").where("l_linenumber <> 2").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cell)).alias("cells"))  # an order has seven lines at most
    return rows.select("l_orderkey", F.array_join(rules.expanded_cells(F.col("cells")), " | ").alias("row_text"))


def null_safe_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey")).alias("folder"), F.col("c_mktsegment").alias("name"))
    first = c.groupBy("folder", "name").agg(F.min("c_custkey").alias("first"))
    return c.alias("a").join(first.alias("b"), F.col("a.folder").eqNullSafe(F.col("b.folder")) & (F.col("a.name") == F.col("b.name"))).select("c_custkey", "first")


def optional_filter(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows that have each value asked for; a value of None asks for nothing."""
    for name, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(name) == F.lit(value))
    return rows


def optional_predicates(spark: SparkSession, d: str) -> DataFrame:
    return optional_filter(read(spark, d, "orders"), o_orderstatus="F", o_custkey=None).select("o_orderkey")


def tag_or_summary_hits(spark: SparkSession, d: str) -> DataFrame:
    words = words_of(["brass", "ring", "azure"])
    held = lambda c, w: F.like(F.lower(c), F.concat(F.lit("%"), w, F.lit("%")))
    hit = F.exists(words, lambda w: held(F.col("p_name"), w) | F.exists(F.array("p_type", "p_brand"), lambda t: held(t, w)))
    return read(spark, d, "part").where(hit).select("p_partkey")


def json_members(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    keys = F.to_json(F.array(F.col("k"), F.col("k") + 1))
    return e.where(F.array_contains(F.from_json(keys, "array<long>"), F.lit(7).cast("long"))).select("event_id")


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber")
    key = rules.boundary_key(F.when(k % 4 == 0, k), F.when(k % 4 == 1, F.col("l_returnflag")), F.when(k % 4 == 2, F.col("l_partkey")), F.array("l_returnflag", "l_linestatus"))
    name = rules.element_id(F.sha2(F.col("l_orderkey").cast("string"), 256), F.lit("p1"), F.lit("row"), F.concat_ws("  ", "l_returnflag", "l_linestatus"), key, k)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("boundary"), name.alias("element_id"))


def distinct_places(spark: SparkSession, d: str) -> DataFrame:
    """Each order's places (flag, status) once, in order of first appearance; an order has seven lines at most."""
    place = F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("p"))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("s"))
    return rows.select("l_orderkey", F.array_join(F.array_distinct(F.transform("s", lambda x: x["p"])), ",").alias("places"))


def date_differences(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.min(days).cast("long").alias("first"), F.max(days).cast("long").alias("last"))


def model_results(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id")
    tags = F.when(key % 3 > 0, F.array(F.lit(" "), F.when(key % 2 == 0, F.lit("rain")).otherwise(F.lit(""))))
    problem = rules.model_result_problem(nth(KINDS, key), KINDS[:3], nth(SUMMARIES, F.floor(key / 4)), tags, F.col("value") > 10)
    return read(spark, d, "events").select("event_id", F.coalesce(problem, F.lit("none")).alias("problem"))


def decimal_forms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.format_number("l_extendedprice", 2).alias("shown")).distinct().select("shown", grounding.decimal_form("shown").alias("form"))


QUERIES = {f.__name__: f for f in (
    rewrite_stems, prose_dates, blanked_dates, script_counts, plain_pages, embedding_inputs, url_verdicts, public_addresses, document_cues, text_shapes, sensitive_tags, declared, searchable_queries,
    evidence_gates, echo_shares, mentioned, listed_nations, tag_matches, watermarked, cell_grids, null_safe_pairs, optional_predicates, tag_or_summary_hits, json_members, boundaries, distinct_places,
    date_differences, model_results, decimal_forms,
)}

W = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}+#]+'), lambda w: w <> '')"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in rules.QUERY_STOP) + "]"
CONTENT = rf"list_filter(regexp_extract_all(lower({{}}), '[\p{{{{L}}}}\p{{{{N}}}}_''-]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOP_SQL}, w))"
LEAD_SQL = rules.QUESTION_LEAD.replace(r"\b", r"(?:[^\p{L}\p{N}_]|$)")  # RE2 sees boundaries of ASCII words only
REFUSALS_SQL = "(?i)" + "|".join(rules.REFUSALS).replace("'", "''")


def shape_sql(c: str) -> str:
    score = lambda shapes: " + ".join(f"len(list_filter(ls, lambda x: regexp_matches(x, '{p}')))" for p in shapes)
    return f"CASE WHEN {score(rules.MARKUP_LINES)} >= 3 THEN 'headed' WHEN {score(rules.CODE_LINES)} >= 3 THEN 'code' ELSE 'prose' END"


ASKED = f"CASE WHEN turn % 2 = 0 THEN {nth_sql(QUESTIONS, 'conv_id')} ELSE text END"
HOST = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
VERDICT = (
    f"CASE WHEN {HOST} IN ({', '.join(repr(h) for h in rules.NO_CONTENT_HOSTS)}) THEN 'blocklist' WHEN regexp_matches({{0}}, '(?i){'|'.join(rules.SHARING_PATHS).replace('{', '{{').replace('}', '}}')}') OR (regexp_matches({{0}}, '(?i){rules.SHOP_PATHS}')"
    f" AND NOT regexp_matches({HOST}, '(^|\\.)({'|'.join(s.replace('.', chr(92) + '.') for s in rules.STORES)})$')) THEN 'suspicious' ELSE 'keep' END"
)
SCRIPT_ROWS = ", ".join(f"{{'n': len(regexp_extract_all(text, '\\p{{{s.title()}}}')), 'script': '{s}'}}" for s in rules.SCRIPTS)
# A report's cue at p counts if the 50 characters on both sides hold no word of a menu.
REPORT_AT = "regexp_extract(said[p + 1:], '(?i)^(?:annual|business|financial|inspection|progress|status|technical)\\s+report\\b')"
KIND_SQL = (
    f"CASE WHEN regexp_matches(said, '{rules.PURCHASE_ORDER}') THEN 'purchase_order' WHEN regexp_matches(said, '{rules.DECK}') THEN 'presentation'"
    f" WHEN regexp_matches(said, '{rules.REPORT}') AND len(list_filter(range(length(said)), lambda p: {REPORT_AT} <> '' AND (p = 0 OR NOT regexp_matches(said[p:p], '\\w'))"
    f" AND NOT regexp_matches(said[greatest(p - 50, 0) + 1:p + length({REPORT_AT}) + 50], '(?i)\\b(?:button|click|dashboard|generate|menu|select)\\b'))) > 0 THEN 'report' END"
)

ORACLE_SQL = {
    "rewrite_stems": f"WITH w AS (SELECT DISTINCT unnest({W.format('text')}) AS w FROM documents) SELECT w, CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END AS stem FROM w",
    "prose_dates": "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 2000 THEN strftime(o_orderdate, '%Y-%m-%d') || ',' || strftime(o_orderdate + INTERVAL 100 YEAR, '%Y') || strftime(o_orderdate, '-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dates FROM orders",
    "blanked_dates": "SELECT o_orderkey, 'on ' || year(o_orderdate) || '       at ' || o_custkey AS blanked FROM orders",
    "script_counts": f"""
WITH c AS (SELECT doc_id, [{SCRIPT_ROWS}] AS c FROM documents), t AS (SELECT doc_id, unnest(c) AS s, list_sum(list_transform(c, lambda x: x.n)) AS total FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s.n DESC, s.script) AS k FROM t)
SELECT doc_id, coalesce(string_agg(s.script || ':' || s.n, ',' ORDER BY k) FILTER (k <= 3 AND total >= 12 AND s.n >= 8 AND s.n >= 0.05 * total), '') AS scripts FROM r GROUP BY doc_id""",
    "plain_pages": r"SELECT page_id, sha256(regexp_replace(regexp_replace(html, '(?i)\[\s*div\b[^\]]*\]', '', 'g'), '(?i)</?\s*div\b[^>]*>', '', 'g')) AS sha FROM pages",
    "embedding_inputs": r"""
WITH t AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, sha256(CASE WHEN contains(lang, 'en') THEN 'query: ' || left(t, 1800) WHEN contains(lang, 'de') THEN 'passage: ' || left(t, 300) ELSE left(t, 1000) END) AS sha FROM t""",
    "url_verdicts": f"SELECT page_id, {VERDICT.format('u')} AS made, {VERDICT.format('url')} AS own FROM {URLS} JOIN pages USING (page_id)",
    "public_addresses": """
WITH a AS (SELECT event_id, (['10', '8', '172', '192', '100', '224', '169', '300'])[event_id % 8 + 1]::INT AS a, event_id % 256 AS b, (event_id * 7) % 256 AS c FROM events)
SELECT event_id, CASE a WHEN 8 THEN true WHEN 172 THEN NOT b BETWEEN 16 AND 31 WHEN 192 THEN NOT (b = 168 OR (b = 0 AND c IN (0, 2))) WHEN 100 THEN NOT b BETWEEN 64 AND 127 WHEN 169 THEN b <> 254 ELSE false END AS public FROM a""",
    "document_cues": f"WITH s AS (SELECT *, (string_split(said, chr(10)))[1:50] AS ls FROM {SAID}) SELECT conv_id, turn, {KIND_SQL} AS kind, {shape_sql('said')} AS shape FROM s",
    "text_shapes": f"WITH s AS (SELECT doc_id, (string_split(text, chr(10)))[1:50] AS ls FROM documents) SELECT doc_id, {shape_sql('text')} AS shape FROM s",
    "sensitive_tags": rf"""
WITH t AS (SELECT c_name AS tag FROM customer UNION SELECT {nth_sql(['road', 'road safety', 'iso 9001', '1 town', 'x'], 'p_partkey')} || ' ' || p_name FROM part UNION SELECT url FROM pages),
w AS (SELECT tag, lower(tag) AS t, {W.format('tag')} AS ws, length(regexp_replace(tag, '[^0-9]', '', 'g')) AS digits FROM t)
SELECT tag, contains(t, '@') OR contains(t, '://') OR starts_with(t, 'www.') OR regexp_matches(t, '\b[a-z0-9._%+-]+\.(?:com|net|org|io|in|co|edu|gov)\b')
  OR (regexp_matches(t, '\b\d{{5,6}}\b') AND NOT regexp_full_match(trim(t), 'iso[\s_-]*\d{{4,6}}'))
  OR (list_has_any(ws, ['avenue', 'colony', 'lane', 'nagar', 'road', 'street']) AND NOT list_has_any(ws, [{', '.join(repr(x) for x in rules.ADDRESS_TOPICS)}]))
  OR (digits >= 1 AND regexp_matches(t, '\b(?:address|avenue|colony|district|lane|nagar|road|street|town|village)\b')) OR digits >= 7 AS sensitive FROM w""",
    "declared": rf"""
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(said, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT ends_with(x, '?') AND NOT regexp_matches(x, '{LEAD_SQL}')) AS spans FROM {SAID}),
h AS (SELECT *, list_transform(spans, lambda x: (contains(lower(x), 'rain')::INT + contains(lower(x), 'rules')::INT + contains(lower(x), 'the')::INT + contains(lower(x), 'and')::INT)) AS n FROM s)
SELECT conv_id, turn, array_to_string(spans, '|') AS spans, CASE WHEN list_max(n) > 0 THEN left(spans[list_position(n, list_max(n))], 500) END AS best FROM h""",
    "searchable_queries": rf"""
WITH a AS (SELECT conv_id, turn, {ASKED} AS q FROM conversations)
SELECT conv_id, turn, NOT regexp_matches(q, '{REFUSALS_SQL}') AND len({CONTENT.format('q')}) > 0 AS searchable,
  CASE WHEN q IN ('Write a short poem', 'what is the time') OR regexp_matches(q, '(?i)^\s*(?:please\s+)?(?:write|compose|invent|imagine|brainstorm)\b.*\b(?:poem|story|song|joke|haiku|slogan|limerick)s?\b') THEN 'exempt'
  WHEN turn = 3 OR conv_id % 5 = 0 OR turn % 3 = 0 THEN 'refuse' ELSE 'label' END AS requirement FROM a""",
    "evidence_gates": f"""
WITH f AS (SELECT conv_id, arg_min(text, turn) AS asked FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, unnest({CONTENT.format('asked')}) AS w FROM f),
a AS (SELECT conv_id, lower(text) AS t, length(text) AS n FROM conversations WHERE role = 'assistant')
SELECT conv_id, EXISTS (SELECT 1 FROM w JOIN a b USING (conv_id) WHERE w.conv_id = a.conv_id AND (contains(b.t, w.w) OR (length(w.w) > 4 AND ends_with(w.w, 's') AND contains(b.t, w.w[:-2])))) AS relevant, bool_or(n >= 150) AS sufficient FROM a GROUP BY conv_id""",
    "echo_shares": f"""
WITH b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), w AS (SELECT conv_id, turn, {W.format('text')} AS q, {W.format('before')} AS o FROM b WHERE before IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(o) > 0 THEN round(len(list_filter(o, lambda x: list_contains(q, x))) / len(o)::DOUBLE, 6) ELSE 0.0 END AS share FROM w""",
    "mentioned": rf"""
WITH m AS (SELECT conv_id, turn, regexp_extract_all(said, '(?:^|\s)@([\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.\-]*(?:\s*/\s*[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.\-]*)*)', 1) AS m FROM {SAID}),
l AS (SELECT conv_id, turn, list_filter(list_transform(m, lambda x: regexp_replace(trim(string_split(x, '/')[-1]), '\.+$', '')), lambda x: x <> '') AS l FROM m)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS files FROM l""",
    "listed_nations": """
WITH g AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation WHERE n_nationkey % 3 > 0 OR n_regionkey = 2 GROUP BY n_regionkey)
SELECT n_regionkey, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[:-2], ', ') || ', and ' || l[-1] END AS names FROM g""",
    "tag_matches": """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) = 'brand#11' OR lower(p_type) = 'brand#11' WHEN 1 THEN contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'brand#1') WHEN 2 THEN false
  ELSE contains(lower(p_brand), 'brass') OR contains(lower(p_type), 'brass') END AS matched, CASE WHEN p_size <= 5 THEN 'unsupported' WHEN p_partkey % 2 > 0 THEN 'unindexed' ELSE 'ok' END AS verdict FROM part""",
    "watermarked": """
WITH p AS (SELECT event_id, event_id % 3 <> 1 AS marked, CASE WHEN event_id % 5 < 2 THEN '' ELSE props END AS rest FROM events)
SELECT event_id, marked AND length(regexp_replace(rest, '[^\\p{L}\\p{N}]', '', 'g')) < 12 AS only_mark FROM p""",
    "null_safe_pairs": """
WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey END AS folder, c_mktsegment AS name FROM customer) SELECT c_custkey, min(c_custkey) OVER (PARTITION BY folder, name) AS first FROM c""",
    "optional_predicates": "SELECT o_orderkey FROM orders WHERE ('F' IS NULL OR o_orderstatus = 'F') AND (NULL IS NULL OR o_custkey = NULL)",
    "tag_or_summary_hits": "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type || ' ' || p_brand), 'brass|ring|azure')",
    "json_members": "SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT IN (6, 7)",
    "boundaries": """
WITH b AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'slide:' || l_linenumber WHEN 1 THEN 'sheet:' || l_returnflag WHEN 2 THEN 'page:' || l_partkey ELSE 'section:' || l_returnflag || '/' || l_linestatus END AS boundary FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, boundary, 'el_' || sha256(concat_ws(chr(31), 'element', sha256(l_orderkey::VARCHAR), 'p1', 'row', l_returnflag || ' ' || l_linestatus, boundary, l_linenumber)) AS element_id FROM b""",
    "distinct_places": """
WITH p AS (SELECT l_orderkey, l_returnflag || l_linestatus AS p, min((l_linenumber, l_partkey)) AS f FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(p, ',' ORDER BY f, p) AS places FROM p GROUP BY l_orderkey""",
    "date_differences": """
SELECT l_orderkey, min(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS first, max(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS last FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""",
    "model_results": """
WITH e AS (SELECT event_id, value, event_id % 4 AS k, event_id // 4 % 4 AS s FROM events)
SELECT event_id, CASE WHEN k = 3 THEN 'invalid_type' WHEN s = 1 THEN 'missing_summary' WHEN s = 2 THEN 'evasive_summary' WHEN value <= 10 THEN 'ungrounded_summary' WHEN event_id % 6 NOT IN (2, 4) THEN 'missing_tags' ELSE 'none' END AS problem FROM e""",
    "decimal_forms": """
SELECT DISTINCT format('{:,.2f}', l_extendedprice) AS shown, regexp_replace(regexp_replace(replace(format('{:,.2f}', l_extendedprice), ',', ''), '0+$', ''), '\\.$', '') AS form FROM lineitem""",
}
