"""DuckDB SQL that gives each query's rows, over views named as the tables."""

from __future__ import annotations

from docloom.functions.questions import STOP
from docloom.functions.text import ENTRY_BODY, ENTRY_TITLE, FURNITURE, PROMO_TITLES, PROMO_URL_PARTS, SECRET_LABELS
from docloom.plans.queries import HINTS, PHRASE, RARE, STATES

WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}+#]+'), lambda w: w <> '')"
COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
NEAR = f"(SELECT vec_id, label, {COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT {{}})"
FOLDERS = "(SELECT r_regionkey + 1000 AS id, NULL::INT AS parent_id, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_regionkey + 1000, n_name FROM nation)"

words = lambda c: WORDS.format(c)
quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
hits = lambda c, xs: " + ".join(f"contains({c}, '{x}')::INT" for x in xs)


def plural_stem(w: str) -> str:
    return f"""CASE WHEN length({w}) > 5 AND {w} LIKE '%ies' AND {w}[-4] NOT IN ('a','e','i','o','u') THEN {w}[:-4] || 'y'
      WHEN length({w}) > 5 AND {w} LIKE '%s' AND {w}[-2] NOT IN ('a','e','i','o','u') THEN {w}[:-2] ELSE {w} END"""


def redacted(quoted_too: bool) -> str:
    keys = "(?:PRIVATE KEY|RSA PRIVATE KEY|OPENSSH PRIVATE KEY|DSA PRIVATE KEY|EC PRIVATE KEY)-----"
    steps = [
        (rf"(?is)-----BEGIN {keys}.*?-----END {keys}", "[REDACTED]"),
        (r"(?im)^.*\bssh-(?:rsa|ed25519|ecdsa|dss)\s+[A-Za-z0-9+/=]+.*$", "[REDACTED]"),
        (r"(?i)\b([a-z][a-z0-9+.-]*)://([^/\s:@]+):([^/\s@]+)@", r"\1://\2:[REDACTED]@"),
        (r"(?i)\bbearer\s+[A-Za-z0-9_.\-~+/=]+", "Bearer [REDACTED]"),
        (r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.\-/+=]+", "[REDACTED]"),
        (r"(?i)\b(password\s+for\s+\S+\s*:\s+)(\S+)", r"\1[REDACTED]"),
        (rf"(?i)\b({SECRET_LABELS})(\s*(?:is|=|:)\s*|\s+)([A-Za-z0-9_./+@=~$-]{{4,}})", r"\1\2[REDACTED]"),
    ]
    if quoted_too:
        steps.append((rf"""(?i)\b({SECRET_LABELS})(\s*(?:is|=|:)\s*)(["''])([^"'']{{4,}})""", r"\1\2\3[REDACTED]"))
    out = "coalesce(text, '')"
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


def classified(hints: dict[str, list[str]]) -> str:
    rows = ", ".join(f"{{'n': {hits('lower(text)', ws)}, 'kind': '{k}'}}" for k, ws in hints.items())
    return f"list_max([{rows}])"


CANONICAL = r"""
u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
v AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM u),
x AS (SELECT page_id, scheme, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host, regexp_extract(rest, '^[^/?]*(/[^?]*)?', 1) AS path, regexp_extract(rest, '\?(.*)$', 1) AS query FROM v),
y AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')), '&') AS kept FROM x),
z AS (SELECT page_id, scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
      || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical FROM y WHERE scheme <> '' AND host <> '' AND NOT contains(host, '@'))"""

CLEAN_PAGE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<head\b.*?</head\s*>|<aside\b.*?</aside\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _entity, _mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    CLEAN_PAGE = f"replace({CLEAN_PAGE}, '{_entity}', '{_mark}')"

ATOMS = r"""list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)+'), lambda x: lower(x)),
  list_transform(regexp_extract_all(text, '\b[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.') THEN regexp_replace(replace(x, ',', ''), '\.?0+$', '') ELSE replace(x, ',', '') END))))"""

PAGE_ELEMENTS = rf"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, trim(regexp_replace({CLEAN_PAGE}, '\s+', ' ', 'g')) AS body FROM pages"""

ORACLE_SQL = {
    "hybrid_vector_topk": f"SELECT vec_id, round(s, 6) AS vector_score FROM {NEAR.format(20)}",
    "hybrid_blend": f"""
WITH n AS {NEAR.format(100)}, l AS (SELECT source, min(doc_id) AS doc_id FROM documents WHERE contains(lower(text), '{PHRASE}') GROUP BY source),
b AS (SELECT coalesce(n.vec_id, l.doc_id) AS doc_id, l.doc_id IS NOT NULL AS literal_match, round(0.68 * coalesce(n.s, 0), 6) AS score FROM n FULL JOIN l ON n.vec_id = l.doc_id)
SELECT * FROM b ORDER BY literal_match DESC, score DESC, doc_id LIMIT 50""",
    "literal_pin": f"SELECT source, min(doc_id) AS doc_id FROM documents WHERE contains(lower(text), '{PHRASE}') GROUP BY source",
    "rare_term_pin": f"""
WITH h AS (SELECT w.word, doc_id FROM documents, (SELECT unnest([{quoted(RARE)}]) AS word) w WHERE contains(lower(text), w.word)),
d AS (SELECT word, count(DISTINCT doc_id) AS df FROM h GROUP BY word HAVING count(DISTINCT doc_id) BETWEEN 1 AND 60)
SELECT DISTINCT word, df, doc_id FROM h JOIN d USING (word)""",
    "file_scope_cap": f"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM {NEAR.format(200)}),
f AS (SELECT label FROM n GROUP BY label ORDER BY min(rank), label LIMIT 3) SELECT vec_id, label, rank::INT AS rank FROM n SEMI JOIN f USING (label)""",
    "scoped_representation": f"""
WITH n AS (SELECT vec_id, label, round(s, 6) AS score FROM {NEAR.format(500)}), k AS (SELECT * FROM n ORDER BY score DESC, vec_id LIMIT 5),
m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM n WHERE score >= 0.15 AND label NOT IN (SELECT label FROM k))
SELECT * FROM k UNION ALL SELECT vec_id, label, score FROM m WHERE r = 1""",
    "discovery_floor": f"SELECT vec_id, round(s, 6) AS score FROM {NEAR.format(500)} WHERE vec_id % 97 = 0 OR round(s, 6) >= 0.35",
    "rerank_floor": f"""
WITH n AS (SELECT vec_id, label, CASE WHEN vec_id % 3 > 0 THEN round(s, 6) END AS rerank_score FROM {NEAR.format(500)}),
b AS (SELECT *, max(rerank_score) OVER (PARTITION BY label) AS best FROM n)
SELECT vec_id, label, rerank_score FROM b WHERE coalesce(best, -1) < 0.15 OR rerank_score IS NULL OR rerank_score >= 0.15""",
    "eligible_chunks": """
SELECT l_orderkey AS file_id, l_linenumber AS revision, l_partkey AS chunk_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey % 10 = 3 AND o_orderpriority < '3' AND o_orderstatus <> 'F' AND l_linenumber = 1""",
    "account_counts": """
SELECT c_custkey, count(o_orderkey) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "storage_rollup": """
SELECT o_custkey, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 0.0), 2) AS used, count(*) FILTER (o_orderstatus <> 'F') AS n_live FROM orders GROUP BY o_custkey""",
    "tree_rollup": f"""
WITH RECURSIVE f AS {FOLDERS}, t AS (SELECT id, id AS top FROM f UNION ALL SELECT f.id, t.top FROM f JOIN t ON f.parent_id = t.id)
SELECT t.top AS id, count(c_custkey) AS n_items, round(coalesce(sum(c_acctbal), 0.0), 2) AS total_size FROM t LEFT JOIN customer ON c_nationkey = t.id GROUP BY t.top""",
    "tree_paths": f"""
WITH RECURSIVE f AS {FOLDERS}, t AS (SELECT id, '/' || name AS path FROM f WHERE parent_id IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name FROM f JOIN t ON f.parent_id = t.id)
SELECT id, path FROM t""",
    "tag_histogram": f"SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct({words('text')})) AS tag FROM documents) GROUP BY tag",
    "paged_list": "SELECT o_orderkey, total FROM (SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200",
    "latest_per_group": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "semi_has_reply": """
SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn > c.turn)""",
    "pair_complete_turns": """
SELECT conv_id, turn, role FROM (SELECT *, lead(role) OVER w AS n, lag(role) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE (role = 'user' AND n = 'assistant') OR (role = 'assistant' AND p = 'user')""",
    "history_budget": """
WITH b AS (SELECT *, row_number() OVER w AS n, 1500 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, CASE WHEN length(text) > room THEN right(text, room::INT) ELSE text END AS text FROM b WHERE n <= 3 AND room > 0""",
    "heal_stale": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "diverse_pick": r"""
WITH e AS (SELECT page_id, regexp_extract(url, '^https?://([a-z]+)\.', 1) AS engine FROM pages)
SELECT page_id, engine, (row_number() OVER (PARTITION BY engine ORDER BY page_id))::INT AS turn FROM e ORDER BY turn, engine LIMIT 30""",
    "canonical_url_dedupe": f"WITH {CANONICAL} SELECT canonical, min(page_id) AS rank, count(*) AS n_rows FROM z GROUP BY canonical",
    "boilerplate_flags": f"""SELECT page_id, ({hits('lower(html)', FURNITURE)})::INT AS hits, ({hits('lower(url)', PROMO_URL_PARTS)}) + ({hits('lower(title)', PROMO_TITLES)}) > 0 AS promotional,
  (regexp_matches(title, '{ENTRY_TITLE}') AND regexp_matches(lower(title || chr(10) || body), '{ENTRY_BODY}')) OR ({hits('lower(title || chr(10) || body)', FURNITURE)}) >= 2 AS generic
FROM pages JOIN ({PAGE_ELEMENTS}) USING (page_id)""",
    "page_elements": PAGE_ELEMENTS,
    "keyword_gate": f"""
WITH s AS (SELECT DISTINCT doc_id, {plural_stem('w')} AS stem FROM (SELECT doc_id, unnest({words('text')}) AS w FROM documents))
SELECT doc_id FROM s WHERE stem IN ('license', 'version', 'works') GROUP BY doc_id HAVING count(*) >= 2""",
    "exact_duplicates": "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
    "redact_text": f"SELECT doc_id, sha256({redacted(False)}) AS redacted_sha, sha256({redacted(True)}) AS quoted_sha FROM documents",
    "sensitive_screen": rf"""
SELECT * FROM (SELECT doc_id, CASE WHEN {redacted(False)} <> text THEN 'secret' WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') THEN 'email'
  WHEN regexp_matches(text, '(?:^|[^0-9])[0-9]{{13,19}}(?:[^0-9]|$)') THEN 'card' WHEN regexp_matches(text, '(?:^|[^0-9.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?:[^0-9.]|$)') THEN 'ip'
  WHEN regexp_matches(text, '\+[0-9]{{1,3}} \([0-9]{{3}}\) [0-9]{{3}}-[0-9]{{4}}') THEN 'phone' END AS kind FROM documents) WHERE kind IS NOT NULL""",
    "token_counts": r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::BIGINT AS n_tokens FROM documents",
    "normalized_texts": r"""
SELECT doc_id, sha256(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\t \f\v]+', ' ', 'g'), ' ')), chr(10)), '^\n+|\n+$', '', 'g')) AS sha FROM documents""",
    "text_elements": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
f AS (SELECT *, trim(line, ' ') = '' AS blank FROM l), g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM f),
p AS (SELECT doc_id, grp, string_agg(line, chr(10) ORDER BY n) AS text, min(n)::INT AS line_start, max(n)::INT AS line_end FROM g WHERE NOT blank GROUP BY doc_id, grp)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS ordinal, sha256(text) AS sha, line_start, line_end FROM p""",
    "doc_classify": f"SELECT doc_id, CASE WHEN b.n > 0 THEN b.kind ELSE 'other' END AS kind FROM (SELECT doc_id, {classified(HINTS)} AS b FROM documents)",
    "ngram_topics": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
w AS (SELECT doc_id, line, {words('body')} AS ws FROM l), i AS (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w),
g AS ({' UNION ALL '.join(f"SELECT DISTINCT doc_id, line, array_to_string(ws[k:k + {n - 1}], ' ') AS gram, {n} AS width FROM i WHERE k + {n - 1} <= len(ws)" for n in range(1, 6))}),
h AS (SELECT doc_id, gram, width, count(*) AS hits FROM g GROUP BY ALL HAVING count(*) >= 3 OR (width > 1 AND count(*) >= 2))
SELECT doc_id, gram, width::BIGINT AS width, hits, (row_number() OVER (PARTITION BY doc_id ORDER BY hits * width DESC, width DESC, gram))::INT AS rank FROM h QUALIFY rank <= 12""",
    "fingerprint_upsert": r"""
WITH t AS (SELECT lower(trim(regexp_replace(text, '[\s_]+', ' ', 'g'))) AS v, role, turn FROM conversations),
f AS (SELECT sha256(concat_ws(chr(31), 'fact', role, role, 'said', v)) AS fp, turn / 8 AS c, turn > 2 AS a, DATE '2024-01-01' + (turn % 28)::INT AS day FROM t),
g AS (SELECT fp, max(c) AS confidence, bool_or(a) AS active, count(*) AS revision, max(day) AS day FROM f GROUP BY fp)
SELECT fp, confidence, active, revision, day + CASE WHEN active THEN 90 ELSE 14 END AS expires_on FROM g""",
    "supersede_latest": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "drift_report": """
WITH a AS (SELECT o_orderkey AS k, 'R' AS v FROM orders WHERE o_orderkey % 7 > 0), b AS (SELECT l_orderkey AS k, l_returnflag AS v FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 5 > 0),
j AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'orphan' WHEN a.v IS DISTINCT FROM b.v THEN 'diverged' END AS state FROM a FULL JOIN b ON a.k = b.k)
SELECT * FROM j WHERE state IS NOT NULL""",
    "two_hop_related": """
SELECT l_orderkey, count(DISTINCT l_partkey) AS shared FROM lineitem WHERE l_orderkey <> 1 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 1) GROUP BY l_orderkey""",
    "memory_recall": f"SELECT item_id, ({hits('lower(text)', ['the', 'of', 'le', 'der'])})::INT AS matched FROM benchmark WHERE matched > 0 ORDER BY matched DESC, item_id LIMIT 8",
    "session_activity": """
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS n_events FROM s GROUP BY user_id, n""",
    "queue_order": """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderpriority, o_totalprice NULLS LAST, o_orderdate, o_orderkey))::INT AS position FROM orders QUALIFY position <= 50""",
    "job_state_fold": f"""
WITH p AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, previous, previous IS NULL OR (previous || '>' || event_type) IN ({quoted([f'{a}>{b}' for a, b in STATES])}) AS valid FROM p""",
    "date_math": """
SELECT o_orderkey, o_orderdate::DATE + 3 AS plus_day, o_orderdate::DATE + 14 AS plus_week, o_orderdate::DATE + 150 AS plus_month, o_orderdate::DATE + 365 AS plus_year,
  CASE WHEN o_orderdate::DATE < DATE '1996-06-01' THEN 'past' WHEN o_orderdate::DATE > DATE '1996-06-01' THEN 'future' ELSE 'today' END AS side FROM orders""",
    "evidence_scores": """
SELECT event_id, round(greatest(0.0, least(1.0, value / 100)), 6) AS score,
  round_even(least(100.0, greatest(0.0, CASE WHEN floor(value) + 0.5 <= 1 THEN (floor(value) + 0.5) * 100 ELSE floor(value) + 0.5 END))::DOUBLE, 0)::INT AS percent FROM events""",
    "extracted_facts": r"""
SELECT doc_id, coalesce(array_to_string(regexp_extract_all(text, '\b((?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))\b'), ','), '') AS dates,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9][0-9,]*'), lambda x: ltrim(replace(x, ',', ''), '0')), lambda x: length(x) >= 2))), ','), '') AS numbers FROM documents""",
    "ungrounded_claims": f"""
WITH w AS (SELECT DISTINCT conv_id, role, unnest({words('text')}) AS atom FROM conversations)
SELECT conv_id, atom FROM w a WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM w e WHERE e.conv_id = a.conv_id AND e.role = 'assistant' AND e.atom = a.atom)""",
    "mutual_pairs": """
WITH g AS (SELECT l_returnflag AS doc, l_suppkey, l_partkey, min(l_quantity) AS d FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, l_suppkey ORDER BY d, l_partkey) AS a, row_number() OVER (PARTITION BY doc, l_partkey ORDER BY d, l_suppkey) AS b FROM g)
SELECT doc, l_suppkey, l_partkey FROM r WHERE a = 1 AND b = 1""",
    "word_stems": f"""
WITH w AS (SELECT DISTINCT unnest({words('text')}) AS w FROM documents)
SELECT w, CASE WHEN length(w) <= 4 THEN w WHEN w LIKE '%ies' THEN w[:-4] || 'y' WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%is' THEN w[:-2] ELSE w END AS variant,
  {plural_stem('w')} AS stem, translate(lower(w), 'aeiouy', '') AS bones FROM w""",
    "route_files": """
WITH f AS (SELECT page_id, (['pdf', 'txt', 'csv', 'docx', 'zzz', 'mp3'])[page_id % 6 + 1] AS ext, (['application/pdf', 'text/plain', 'application/octet-stream', 'audio/mpeg', ''])[page_id % 5 + 1] AS kind FROM pages)
SELECT page_id, CASE WHEN kind LIKE 'audio/%' THEN 'unsupported' WHEN kind = 'text/plain' AND ext = 'csv' THEN 'table' WHEN kind = 'text/plain' THEN 'text' WHEN kind = 'application/pdf' THEN 'pdf'
  ELSE CASE ext WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'csv' THEN 'table' WHEN 'docx' THEN 'office' ELSE 'unsupported' END END AS parser FROM f""",
    "changed_rows": "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 5 = 0 AND c_name <> 'other')",
    "lexical_leg": f"""
WITH w AS (SELECT doc_id, {words('text')} AS ws FROM documents),
s AS (SELECT doc_id, round(({' + '.join(f"ln(1.0::DOUBLE + len(list_filter(ws, lambda w: w = '{t}')))" for t in ('license', 'version', 'the'))}) / ln(2.0::DOUBLE + len(ws)), 9) AS lexical_score FROM w)
SELECT * FROM s WHERE lexical_score > 0 ORDER BY lexical_score DESC, doc_id LIMIT 40""",
    "merge_legs": f"""
WITH {CANONICAL}, r AS (SELECT canonical AS key, page_id % 3 AS leg, page_id AS place, page_id % 4 = 0 AS relevant FROM z),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY relevant DESC, leg, place) AS n, min((leg, place)) OVER (PARTITION BY key) AS f FROM r)
SELECT key, leg, place, relevant, f[1] AS first_leg, f[2] AS first_place FROM n WHERE n = 1""",
    "web_order": rf"""
SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages
ORDER BY page_id % 2, contains(url, 'utm_'), ({hits('lower(html)', FURNITURE)}) >= 2, page_id LIMIT 25""",
    "envelopes": """
WITH r AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS rank FROM lineitem)
SELECT l_suppkey, rank, min(rank) OVER (PARTITION BY l_suppkey) AS file_rank,
  'chunk ' || row_number() OVER (PARTITION BY l_suppkey ORDER BY rank) || ' of ' || count(*) OVER (PARTITION BY l_suppkey) AS label FROM r""",
    "evidence_registry": """
WITH r AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'V' ELSE 'W' END AS kind, floor(value)::BIGINT AS item, min(event_id) AS first FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY first, item) AS n FROM r) SELECT user_id, item, kind || n AS label FROM n WHERE n <= 40""",
    "keep_files": """
WITH li AS (SELECT *, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS place FROM lineitem), n AS (SELECT l_orderkey, l_returnflag, place, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS n FROM li),
h AS (SELECT * FROM n WHERE n <= 3), b AS (SELECT l_orderkey, l_returnflag, min(place) AS place FROM n GROUP BY ALL),
v AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.l_orderkey = b.l_orderkey AND h.l_returnflag = b.l_returnflag)),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY place DESC) = 1)
SELECT l_orderkey, l_returnflag, place FROM h WHERE n < 3 OR l_orderkey NOT IN (SELECT l_orderkey FROM l) UNION ALL SELECT * FROM l""",
    "relevance_pool": """
WITH li AS (SELECT *, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS place FROM lineitem), n AS (SELECT l_orderkey, place, l_returnflag = 'R' AS flag, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS a,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, place) AS n FROM li) SELECT l_orderkey, place, flag FROM n WHERE a AND n <= 3""",
    "rescue_rows": """
WITH li AS (SELECT *, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS place FROM lineitem), n AS (SELECT *, l_returnflag = 'R' AS f, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY place) AS n FROM li)
SELECT l_orderkey, place, f OR (n <= 3 AND l_quantity / 50 >= 0.5) AS flag FROM n""",
    "representative_sample": """
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM n WHERE n <= 12 OR i IN (SELECT round_even(k * (n.n - 1) / 11.0::DOUBLE, 0)::BIGINT FROM range(12) r(k))""",
    "row_digests": """
WITH h AS (SELECT o_orderstatus, sha256(concat_ws(chr(31), o_orderkey, o_custkey)) AS h FROM orders)
SELECT o_orderstatus, count(*) AS n, sum(('0x' || h[1:12])::BIGINT)::HUGEINT::VARCHAR AS low, sum(('0x' || h[13:24])::BIGINT)::HUGEINT::VARCHAR AS high FROM h GROUP BY o_orderstatus""",
    "integrity_report": """
SELECT 'orphans' AS what, (SELECT count(*) FROM orders WHERE o_custkey % 4 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1))""",
    "identity_facts": """
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'name' ELSE 'units' END AS predicate, CASE turn % 5 WHEN 0 THEN role ELSE 'metric' END AS value FROM conversations WHERE turn % 5 IN (0, 2)""",
    "memory_verdicts": """
WITH t AS (SELECT *, turn % 4 AS k, left(text, 5) AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 2 THEN 'sensitive' WHEN right(trim(s), 1) = '?' THEN 'question' WHEN k = 1 THEN 'uncertain' WHEN role <> 'user' THEN 'not_explicit' WHEN k = 0 THEN 'third_party'
  WHEN turn / 6 < 0.55 THEN 'low_confidence' WHEN turn / 6 >= 0.88 THEN 'active' ELSE 'pending' END AS verdict FROM t""",
    "index_stats": """
WITH g AS (SELECT o_custkey % 50 AS owner, count(*) AS n_files, count(*) FILTER (o_orderpriority < '4') AS eligible, count(*) FILTER (o_orderpriority < '4' AND o_orderstatus = 'O') AS ready,
  count(*) FILTER (o_orderpriority >= '4' AND o_orderstatus = 'F') AS failed FROM orders GROUP BY 1)
SELECT *, CASE WHEN greatest(eligible, ready) > 0 THEN floor(ready * 100 / greatest(eligible, ready)) ELSE 0 END::BIGINT AS percent FROM g""",
    "sentence_union": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, lower(regexp_replace(line, '[.!?]+$', '')) AS k FROM l WHERE line <> '')
SELECT sha256(k) AS key, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM k GROUP BY k""",
    "nearest_dates": """
WITH d AS (SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders),
y AS (SELECT o_orderkey, make_date(2022, m, least(d, day(last_day(make_date(2022, m, 1))))) AS a, make_date(2023, m, least(d, day(last_day(make_date(2023, m, 1))))) AS b, make_date(2024, m, least(d, day(last_day(make_date(2024, m, 1))))) AS c FROM d)
SELECT o_orderkey, CASE WHEN b >= DATE '2023-03-01' THEN b ELSE c END AS ahead, CASE WHEN b <= DATE '2023-03-01' THEN b ELSE a END AS back FROM y""",
    "grade_report": """
WITH r AS (SELECT event_type, round(avg((value >= 20)::INT::DOUBLE) * 100, 4) AS rate FROM events GROUP BY event_type)
SELECT *, CASE WHEN rate >= 90 THEN 'A' WHEN rate >= 75 THEN 'B' WHEN rate >= 60 THEN 'C' ELSE 'D' END AS grade FROM r""",
    "claim_atoms": f"SELECT doc_id, array_to_string({ATOMS}, '|') AS atoms FROM documents",
    "folded_tags": f"""
WITH w AS (SELECT conv_id, turn, {ATOMS} AS w FROM conversations),
t AS (SELECT conv_id, turn, unnest(list_concat(w, flatten(list_transform(w, lambda x: string_split(x, ' '))))) AS t, unnest(range(len(list_concat(w, flatten(list_transform(w, lambda x: string_split(x, ' '))))))) AS i FROM w),
u AS (SELECT conv_id, turn, trim(lower(t)) AS t, min(i) AS i FROM t GROUP BY conv_id, turn, trim(lower(t)) HAVING trim(lower(t)) <> '' AND length(trim(lower(t))) <= 40),
k AS (SELECT a.*, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY a.i) AS r FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.conv_id = a.conv_id AND b.turn = a.turn AND b.t <> a.t
  AND list_has_all(string_split(b.t, ' '), string_split(a.t, ' ')) AND len(string_split(b.t, ' ')) > len(string_split(a.t, ' '))))
SELECT w.conv_id, w.turn, coalesce(string_agg(k.t, '|' ORDER BY k.i), '') AS tags FROM w LEFT JOIN k ON k.conv_id = w.conv_id AND k.turn = w.turn AND k.r <= 6 GROUP BY w.conv_id, w.turn""",
    "tags_evidenced": f"""
WITH w AS (SELECT conv_id, turn, ' ' || array_to_string({words('text')}, ' ') || ' ' AS t FROM conversations) SELECT conv_id, turn FROM w WHERE contains(t, ' is the ')""",
    "pairing_mismatches": """
WITH s AS (SELECT DISTINCT l_orderkey % 40 AS file, l_suppkey AS entity, l_quantity AS number FROM lineitem WHERE l_linenumber > 1),
a AS (SELECT DISTINCT l_orderkey % 40 AS file, l_suppkey AS entity, l_quantity AS number FROM lineitem WHERE l_linenumber = 1)
SELECT file, entity, number FROM a WHERE (file, entity) IN (SELECT (file, entity) FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.file = a.file AND s.entity = a.entity AND s.number = a.number)""",
    "enqueue_revisions": """
WITH f AS (SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id, floor(value)) AS first FROM events)
SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS revision, event_id > first AS reused FROM f""",
    "claim_states": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_custkey % 4 >= 3 THEN 'exhausted' WHEN o_orderkey % 2 = 0 AND o_orderdate > TIMESTAMP '1996-01-01' THEN 'leased' ELSE 'claimable' END AS state FROM orders""",
    "summary_states": """
WITH n AS (SELECT user_id, max(event_id) AS now FROM events WHERE user_id % 7 > 0 GROUP BY user_id), t AS (SELECT user_id, max(event_id) AS old FROM events WHERE event_id % 3 = 0 AND user_id % 5 > 0 GROUP BY user_id)
SELECT coalesce(n.user_id, t.user_id) AS user_id, CASE WHEN now IS NULL THEN 'empty' WHEN old IS NULL THEN 'missing' WHEN old < now THEN 'stale' ELSE 'fresh' END AS state FROM n FULL JOIN t ON n.user_id = t.user_id""",
    "fenced_results": "SELECT event_id FROM events QUALIFY ts::DATE = max(ts::DATE) OVER (PARTITION BY user_id)",
    "resolved_scopes": """
WITH p AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS f FROM orders GROUP BY o_custkey), s AS (SELECT o_custkey, list_filter(f[1:5], lambda x: x % 3 > 0) AS s FROM p)
SELECT o_custkey, CASE WHEN len(s) > 0 THEN array_to_string(s, ',') END AS scope FROM s""",
    "recall_terms": f"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter({words('text')}, lambda w: length(w) >= 3 AND regexp_full_match(w, '[\\p{{L}}]+') AND NOT list_contains([{quoted(STOP)}], w)))), ' ') AS terms,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3))), ' ') AS rare FROM conversations""",
    "exact_calculator": "SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity::BIGINT + l_linenumber) * 3 - l_partkey / 4 AS value FROM lineitem",
}
