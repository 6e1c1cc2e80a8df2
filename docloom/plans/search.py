"""Lexical queries over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.stems import DOUBLED, DROPPED, REPLACED, REPLACED_NEXT, stem
from docloom.operators import lexical
from docloom.plans.queries import read

SEARCHES = {
    "phrase and word": '"apache license" version',
    "absence": "license -gnu",
    "alternatives": '"general public license" or "released under the MIT license"',
    "stems": "licenses works",
    "common words": "thatin ononst inoran",
    "absent phrase": 'licensed -"apache license" -"mit license"',
    "open quote": 'version or "cc by',
}
RARE_WORDS = ["licenses", "tokens", "releasing", "thentionly", "works", "publicness", "apache"]
LISTED = 50


def web_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(read(spark, d, "documents"), "doc_id", F.col("text"), SEARCHES, LISTED)


def phrase_places(spark: SparkSession, d: str) -> DataFrame:
    asked = lexical.search_table(spark, {k: v for k, v in SEARCHES.items() if '"' in v}).where("n > 1")
    index = lexical.build_index(read(spark, d, "documents"), "doc_id", F.col("text"), lexical.asked_terms(asked))
    return lexical.occurrences(index, asked, "doc_id").select("query", "alt", "atom", "absent", "doc_id", "begin", "end")


def rare_stems(spark: SparkSession, d: str) -> DataFrame:
    named = spark.createDataFrame([(w,) for w in RARE_WORDS], "word string").select(stem("word").alias("term"))
    index = lexical.build_index(read(spark, d, "documents"), "doc_id", F.col("text"), lexical.asked_terms(named))
    return lexical.rare_terms(index, RARE_WORDS, "doc_id", 40)


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """The whole index of the benchmark's items by term: items, places and the first item."""
    index = lexical.build_index(read(spark, d, "benchmark"), "item_id", F.col("text"))
    return index.groupBy("term").agg(F.count("*").alias("n_items"), F.sum(F.size("positions")).alias("n_places"), F.min("item_id").alias("first_item"))


QUERIES = {"web_search": web_search, "phrase_places": phrase_places, "rare_stems": rare_stems, "term_frequencies": term_frequencies}


def stems_sql(source: str, name: str = "stems") -> str:
    """CTEs that end in ``name`` (word, term) for the distinct words of ``source``."""
    one, two = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'", "'^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]'"

    def table(endings, before):
        ordered = sorted(endings.items(), key=lambda x: -len(x[0]))
        whens = " ".join(f"WHEN suffix(w, '{old}') THEN CASE WHEN regexp_matches(left(w, len(w) - {len(old)}), {before}) THEN left(w, len(w) - {len(old)}) || '{new}' ELSE w END" for old, new in ordered)
        return f"CASE {whens} ELSE w END"

    doubled = " OR ".join(f"suffix(w, '{x}')" for x in DOUBLED)
    return f"""
{name}0 AS (SELECT DISTINCT word, word AS w FROM {source}),
{name}1 AS (SELECT word, CASE WHEN suffix(w, 'sses') OR regexp_matches(w, '..ies$') THEN left(w, len(w) - 2) WHEN regexp_matches(w, '[aeiouy].*[^su]s$') THEN left(w, len(w) - 1) ELSE w END AS w FROM {name}0),
{name}2 AS (SELECT word, CASE WHEN regexp_matches(w, '[aeiouy].*ing$') THEN left(w, len(w) - 3) WHEN suffix(w, 'eed') THEN CASE WHEN regexp_matches(left(w, len(w) - 3), {one}) THEN left(w, len(w) - 1) ELSE w END WHEN regexp_matches(w, '[aeiouy].*ed$') THEN left(w, len(w) - 2) ELSE w END AS w, w AS was FROM {name}1),
{name}3 AS (SELECT word, CASE WHEN len(was) - len(w) < 2 THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN {doubled} THEN left(w, len(w) - 1) ELSE w END AS w FROM {name}2),
{name}4 AS (SELECT word, CASE WHEN len(w) > 2 AND regexp_matches(w, '.[^aeiouy]y$') THEN left(w, len(w) - 1) || 'i' ELSE w END AS w FROM {name}3),
{name}5 AS (SELECT word, {table(REPLACED, one)} AS w FROM {name}4),
{name}5b AS (SELECT word, {table(REPLACED_NEXT, one)} AS w FROM {name}5),
{name}6 AS (SELECT word, CASE WHEN regexp_matches(w, '[st]ion$') THEN CASE WHEN regexp_matches(left(w, len(w) - 3), {two}) THEN left(w, len(w) - 3) ELSE w END ELSE {table(dict.fromkeys(DROPPED, ""), two)} END AS w FROM {name}5b),
{name} AS (SELECT word, CASE WHEN len(word) <= 2 THEN word WHEN regexp_matches(w, '[^e]e$') AND regexp_matches(left(w, len(w) - 1), {two}) THEN left(w, len(w) - 1) ELSE w END AS term FROM {name}6)"""


# What the searches ask for, by the grammar's rules: query, alternative, atom, absent, words in the alternative that must be there, word, distance.
ASKED = """VALUES
('phrase and word', 0, 0, false, 2, 'apache', 0), ('phrase and word', 0, 0, false, 2, 'license', 1), ('phrase and word', 0, 1, false, 2, 'version', 0),
('absence', 0, 0, false, 1, 'license', 0), ('absence', 0, 1, true, 1, 'gnu', 0),
('alternatives', 0, 0, false, 1, 'general', 0), ('alternatives', 0, 0, false, 1, 'public', 1), ('alternatives', 0, 0, false, 1, 'license', 2),
('alternatives', 1, 0, false, 1, 'released', 0), ('alternatives', 1, 0, false, 1, 'under', 1), ('alternatives', 1, 0, false, 1, 'mit', 3), ('alternatives', 1, 0, false, 1, 'license', 4),
('stems', 0, 0, false, 2, 'licenses', 0), ('stems', 0, 1, false, 2, 'works', 0),
('common words', 0, 0, false, 3, 'thatin', 0), ('common words', 0, 1, false, 3, 'ononst', 0), ('common words', 0, 2, false, 3, 'inoran', 0),
('absent phrase', 0, 0, false, 1, 'licensed', 0), ('absent phrase', 0, 1, true, 1, 'apache', 0), ('absent phrase', 0, 1, true, 1, 'license', 1), ('absent phrase', 0, 2, true, 1, 'mit', 0), ('absent phrase', 0, 2, true, 1, 'license', 1),
('open quote', 0, 0, false, 1, 'version', 0), ('open quote', 1, 0, false, 1, 'cc', 0)"""

PLACES = f"""
asked0(query, alt, atom, absent, atoms, word, off) AS ({ASKED}),
lists AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM lists),
vocabulary AS (SELECT word FROM words WHERE left(word, 2) IN (SELECT left(word, 2) FROM asked0) UNION SELECT word FROM asked0), {stems_sql("vocabulary")},
asked AS (SELECT a.*, s.term, count(*) OVER (PARTITION BY query, alt, atom) AS n, max(off) OVER (PARTITION BY query, alt, atom) AS size FROM asked0 a JOIN stems s ON a.word = s.word),
post AS (SELECT w.doc_id, w.pos, s.term FROM words w JOIN stems s ON w.word = s.word WHERE s.term IN (SELECT term FROM asked)),
occ AS (SELECT query, alt, atom, absent, atoms, n, doc_id, (pos - off)::INT AS b, (pos - off + size)::INT AS e FROM post JOIN asked USING (term) GROUP BY ALL HAVING count(DISTINCT off) = n)"""

ORACLE_SQL = {
    "phrase_places": f"WITH {PLACES} SELECT query, alt, atom, absent, doc_id, b AS begin, e AS \"end\" FROM occ WHERE n > 1",
    "web_search": f"""WITH {PLACES},
live AS (SELECT * FROM occ o WHERE NOT absent AND NOT EXISTS (SELECT 1 FROM occ x WHERE x.absent AND x.query = o.query AND x.alt = o.alt AND x.doc_id = o.doc_id)),
full_ AS (SELECT query, alt, doc_id FROM live GROUP BY query, alt, doc_id, atoms HAVING count(DISTINCT atom) = atoms),
ends AS (SELECT DISTINCT query, alt, doc_id, atoms, e FROM live JOIN full_ USING (query, alt, doc_id)),
last_ AS (SELECT x.query, x.alt, x.doc_id, x.atoms, x.e, o.atom, max(o.b) AS b FROM ends x JOIN live o ON o.query = x.query AND o.alt = x.alt AND o.doc_id = x.doc_id AND o.e <= x.e GROUP BY ALL),
spans AS (SELECT DISTINCT query, doc_id, min(b) AS b, e FROM last_ GROUP BY query, alt, doc_id, atoms, e HAVING count(*) = atoms),
covers AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans x WHERE x.query = s.query AND x.doc_id = s.doc_id AND x.b >= s.b AND x.e <= s.e AND (x.b > s.b OR x.e < s.e))),
told AS (SELECT DISTINCT a.query, p.doc_id, p.pos FROM post p JOIN asked a ON a.term = p.term WHERE NOT a.absent),
sized AS (SELECT c.query, c.doc_id, c.b, c.e, count(*) AS n FROM covers c JOIN told t ON t.query = c.query AND t.doc_id = c.doc_id AND t.pos BETWEEN c.b AND c.e GROUP BY ALL),
scores AS (SELECT query, doc_id, round(sum(0.1 / (1 + (e - b + 1 - n))), 6) AS lexical_score FROM sized GROUP BY query, doc_id)
SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY lexical_score DESC, doc_id)::INT AS rank, lexical_score FROM scores QUALIFY rank <= {LISTED}""",
    "rare_stems": f"""WITH lists AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS ws FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, unnest(ws) AS word FROM lists), asked(word) AS (VALUES {', '.join(f"('{w}')" for w in RARE_WORDS)}),
vocabulary AS (SELECT word FROM words UNION SELECT word FROM asked), {stems_sql("vocabulary")},
hits AS (SELECT DISTINCT a.word, w.doc_id FROM asked a JOIN stems s ON s.word = a.word JOIN stems t ON t.term = s.term JOIN words w ON w.word = t.word)
SELECT word, count(*) OVER (PARTITION BY word) AS df, doc_id FROM hits QUALIFY df <= 40""",
    "term_frequencies": f"""WITH lists AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM benchmark WHERE text IS NOT NULL),
words AS (SELECT item_id, unnest(ws) AS word FROM lists), {stems_sql("words")}
SELECT term, count(DISTINCT item_id) AS n_items, count(*) AS n_places, min(item_id) AS first_item FROM words JOIN stems USING (word) GROUP BY term""",
}
