"""Lexical retrieval: a positional inverted index, web-search queries over it, and ranks by the density of covers.

The index has a row for each term and document, so no term, however common, is one large row; queries read the rows of
their own terms alone. All queries of a call are answered together: what they ask for is a small table, joined by term.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.stems import LEADING, SEARCH_STOP, stem, sure_begin

BUCKETS = 64
FEW = 64  # terms that are looked for in a text one by one
COVER_WEIGHT = 0.1  # of a cover without any other word in it
WORD = r"[\p{L}\p{M}\p{N}_]+"


@dataclass(frozen=True)
class Atom:
    """A word or phrase of a query: its words with their distances from the first, and whether it must be absent."""

    words: tuple[tuple[str, int], ...]
    absent: bool


def parse_search(query: str) -> list[list[Atom]]:
    """Alternatives of a web search, each a list of words and phrases that must all be there, or be absent.

    Quotes make phrases, ``or`` parts alternatives, a minus before a word or phrase means absence. Words that say nothing
    are left out, also from phrases, which keep their gaps; several words between other marks, as in `a-b`, are a phrase.
    An open quote ends with the query. Nothing but such marks gives no alternative.
    """
    found: list[list[Atom]] = [[]]
    for sign, phrase, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        text = phrase or plain
        if plain.lower() == "or" and not sign:
            found.append([])
            continue
        words = [w.lower() for w in re.findall(r"[^\W]+", text)]
        told = [(w, k) for k, w in enumerate(words) if w not in SEARCH_STOP]
        if told:
            found[-1].append(Atom(tuple((w, k - told[0][1]) for w, k in told), bool(sign)))
    return [a for a in found if a]


def search_table(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    """(query, alt, atom, absent, size, n, atoms, term, offset): what the queries ask for, a row for each word.

    ``size`` is the distance from the first to the last word of an atom, ``n`` its number of words, ``atoms`` how many of an
    alternative must be there. Terms are stemmed as the index's are.
    """
    rows = []
    for name, text in queries.items():
        for alt, atoms in enumerate(parse_search(text)):
            there = [a for a in atoms if not a.absent]
            for k, a in enumerate([*there, *(a for a in atoms if a.absent)]):
                rows += [(name, alt, k, a.absent, a.words[-1][1], len(a.words), len(there), w, off) for w, off in a.words]
    table = spark.createDataFrame(rows, "query string, alt int, atom int, absent boolean, size int, n int, atoms int, word string, offset int")
    return table.withColumn("term", stem("word")).drop("word")


def word_positions(docs: DataFrame, key: str, text: Column, asked: list[str] | None = None) -> DataFrame:
    """(term, key, pos) of each word; of asked terms alone, if given, which are told by what their words begin with before any stemming.

    A text that holds none of these beginnings is not taken apart, unless more terms are asked for than are worth a look each.
    """
    told = None
    if asked is not None and len(asked) <= FEW:
        begins = sorted({sure_begin(t) for t in asked})
        begins = [b for b in begins if not any(b != x and b.startswith(x) for x in begins)]
        of = lambda hits: reduce(lambda a, b: a | b, hits, F.lit(False))
        docs = docs.where(F.exists(F.array(F.lower(text)), lambda t: of(t.contains(b) for b in begins)))
        told = of(F.col("word").startswith(b) for b in begins)
    elif asked is not None:
        told = F.left("word", F.lit(LEADING)).isin(sorted({t[:LEADING] for t in asked}))
    words = docs.select(F.col(key), F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("pos", "word"))
    if told is None:
        return words.select(stem("word").alias("term"), key, "pos")
    # Spark works out what several conditions share before any of them, so the stem itself waits for what tells its words.
    return words.where(told).select(F.when(told, stem("word")).alias("term"), key, "pos").where(F.col("term").isin(sorted(asked)))


def build_index(docs: DataFrame, key: str, text: Column, asked: list[str] | None = None) -> DataFrame:
    """(term, key, positions): the sorted places of each term in each document. Null and empty texts have none.

    A key names one document: rows that repeat it have their positions together, in no order of texts.
    """
    return word_positions(docs, key, text, asked).groupBy("term", key).agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, folder: str, key: str, buckets: int = BUCKETS, salts: int = 4) -> None:
    """Writes an index as Parquet by bucket of terms, sorted by term; a bucket is written by several tasks."""
    rows = index.withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows = rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(salts))).sortWithinPartitions("bucket", "term")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_terms(spark: SparkSession, folder: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of some terms: the buckets of others are not listed, and row groups of other terms are passed over."""
    named = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), buckets)).distinct()
    wanted = [r[0] for r in named.collect()]  # as many as terms are asked for, at most
    return spark.read.parquet(folder).where(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).drop("bucket")


def asked_terms(asked: DataFrame) -> list[str]:
    return sorted(r[0] for r in asked.select("term").distinct().collect())  # of the caller's own queries


def occurrences(index: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(query, alt, atom, absent, atoms, key, begin, end): the places where the words of an atom stand at their distances."""
    hits = index.join(F.broadcast(asked), "term").select("query", "alt", "atom", "absent", "size", "n", "atoms", key, "offset", F.explode("positions").alias("pos"))
    placed = hits.withColumn("begin", F.col("pos") - F.col("offset"))
    one = placed.where("n = 1")
    several = placed.where("n > 1").groupBy("query", "alt", "atom", "absent", "size", "n", "atoms", key, "begin").agg(F.countDistinct("offset").alias("got")).where("got = n")
    columns = ["query", "alt", "atom", "absent", "atoms", key, "begin", (F.col("begin") + F.col("size")).alias("end")]
    return one.select(*columns).unionByName(several.select(*columns))


def covers(found: DataFrame, key: str, most_atoms: int) -> DataFrame:
    """(query, key, begin, end): the shortest stretches that satisfy some alternative and hold no shorter one.

    For each place where an atom ends, an alternative's stretch begins at the least of its atoms' last begins until there.
    Documents that hold an absent atom of an alternative don't satisfy it.
    """
    barred = found.where("absent").select("query", "alt", key).distinct()
    live = found.where("not absent").join(barred, ["query", "alt", key], "left_anti")
    until = Window.partitionBy("query", "alt", key).orderBy("end").rangeBetween(Window.unboundedPreceding, 0)
    begins = [F.when(F.col("atoms") > a, F.coalesce(F.max(F.when(F.col("atom") == a, F.col("begin"))).over(until), F.lit(-1))) for a in range(most_atoms)]
    least = F.array_min(F.array(*begins))
    spans = live.select("query", key, "end", least.alias("begin")).where("begin >= 0").groupBy("query", key, "begin").agg(F.min("end").alias("end"))
    inner = F.min("end").over(Window.partitionBy("query", key).orderBy(F.desc("begin")).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("inner", inner).where("inner is null or end < inner").drop("inner")


def ranked(index: DataFrame, asked: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """(query, key, rank, lexical_score): documents by the sum over covers of ``COVER_WEIGHT`` / (1 + other words in the cover).

    Other words are all of a cover's but those that the query's present atoms are made of. Ties go by key. A query without
    present words finds nothing.
    """
    most = asked.agg(F.max("atoms")).first()[0] or 0
    found = covers(occurrences(index, asked, key), key, most)
    told = asked.where("not absent").select("query", "term").distinct()
    words = index.join(F.broadcast(told), "term").select("query", key, F.explode("positions").alias("pos"))
    number = words.withColumn("number", F.dense_rank().over(Window.partitionBy("query", key).orderBy("pos"))).distinct()
    at = lambda edge: number.select("query", key, F.col("pos").alias(edge), F.col("number").alias(f"{edge}_number"))
    sized = found.join(at("begin"), ["query", key, "begin"]).join(at("end"), ["query", key, "end"])
    other = (F.col("end") - F.col("begin")) - (F.col("end_number") - F.col("begin_number"))
    scores = sized.groupBy("query", key).agg(F.round(F.sum(COVER_WEIGHT / (1 + other)), 6).alias("lexical_score"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lexical_score"), key))
    out = scores.withColumn("rank", order)
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select("query", key, "rank", "lexical_score")


def search(docs: DataFrame, key: str, text: Column, queries: dict[str, str], k: int | None = None) -> DataFrame:
    """``ranked`` over documents without a stored index: one pass over the texts, of which only asked words go on."""
    asked = search_table(docs.sparkSession, queries)
    terms = asked_terms(asked)
    return ranked(build_index(docs, key, text, terms), asked, key, k)


def rare_terms(index: DataFrame, words: list[str], key: str, most: int) -> DataFrame:
    """(word, df, key) of the documents of each word whose stem 1 to ``most`` documents hold."""
    named = index.sparkSession.createDataFrame([(w,) for w in words], "word string").withColumn("term", stem(F.lower("word")))
    hits = index.join(F.broadcast(named), "term").select("word", key)
    df = hits.groupBy("word").agg(F.countDistinct(key).alias("df")).where(F.col("df") <= most)
    return hits.join(F.broadcast(df), "word").select("word", "df", key).distinct()
