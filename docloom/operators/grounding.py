"""Grounding of answers: claim atoms, entities paired with numbers, relations and tags, checked against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.rules import bound
from docloom.functions.text import canonical_numbers, col, normalized_words, sentences, singular
from docloom.operators.evidence import mutual_pairs

NAME = r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)+"
ENTITY = r"\b\p{Lu}[\p{L}\p{N}]{2,}"
NUMBER = r"\b[0-9][0-9,]*(?:\.[0-9]+)?"


def grounding_text(c: Column | str) -> Column:
    """Lower case, no thousands commas, percent signs or ordinal endings, single spaces."""
    t = F.regexp_replace(F.lower(col(c)), r"(\d),(?=\d{3})", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"(\d)(?:st|nd|rd|th)\b", "$1"), r"%", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def decimal_form(c: Column | str) -> Column:
    """A number without separators, trailing zeros after the point or a bare point: 142.70 is 142.7."""
    bare = F.replace(col(c), F.lit(","), F.lit(""))
    return F.when(bare.contains("."), F.regexp_replace(bare, r"\.?0+$", "")).otherwise(bare)


def claim_atoms(c: Column | str) -> Column:
    """The names of several words and the numbers that a text states, normalized, each once and sorted."""
    names = F.transform(F.regexp_extract_all(col(c), F.lit(NAME), F.lit(0)), lambda x: F.lower(x))
    numbers = F.transform(F.regexp_extract_all(col(c), F.lit(NUMBER), F.lit(0)), decimal_form)
    return F.array_sort(F.array_distinct(F.concat(names, numbers)))


def relation_triples(c: Column | str) -> Column:
    """`X is Y`, `X was Y` statements as strings subject|object, one for a sentence."""
    of = lambda s: F.when(F.regexp_extract(s, r"^(\p{Lu}[\p{L} ]{1,40}) (?:is|was|are|were) ([^.,;!?]{2,60})", 1) != "", F.concat_ws("|", F.regexp_extract(s, r"^(\p{Lu}[\p{L} ]{1,40}) (?:is|was|are|were) ([^.,;!?]{2,60})", 1), F.trim(F.regexp_extract(s, r"^(\p{Lu}[\p{L} ]{1,40}) (?:is|was|are|were) ([^.,;!?]{2,60})", 2))))
    return F.filter(F.transform(sentences(c), of), lambda x: x.isNotNull())


def entity_numbers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity, number) of each row's entities and numbers that are mutually nearest by place in the text."""
    at = rows.select(key, F.explode(sentences(text)).alias("s")).withColumn("sid", F.xxhash64("s"))
    words = at.select(key, "sid", F.posexplode(F.split("s", " ")).alias("p", "w"))
    entity = words.where(F.col("w").rlike(rf"^{ENTITY}")).select(key, "sid", F.col("p").alias("pe"), F.regexp_extract("w", ENTITY, 0).alias("entity"))
    number = words.where(F.col("w").rlike(rf"^{NUMBER}")).select(key, "sid", F.col("p").alias("pn"), decimal_form(F.regexp_extract("w", NUMBER, 0)).alias("number"))
    near = entity.join(number, [key, "sid"]).groupBy(key, "sid", "entity", "number").agg(F.min(F.abs(F.col("pe") - F.col("pn"))).alias("distance"))
    paired = mutual_pairs(near.withColumn("doc", F.struct(key, "sid")), "doc", "entity", "number", "distance")
    return paired.select(key, "entity", "number").distinct()


def pairing_mismatches(answers: DataFrame, shown: DataFrame, file: str) -> DataFrame:
    """Pairs of answers whose entity a file pairs with other numbers only."""
    same = shown.select(file, "entity", "number").distinct()
    known = answers.join(same.select(file, "entity").distinct(), [file, "entity"], "left_semi")
    return known.join(same, [file, "entity", "number"], "left_anti")


def summary_is_grounded(summary: Column | str, evidence: Column | str) -> Column:
    """All numbers are in the evidence, and half of each sentence's content words or more."""
    held = F.array_distinct(F.transform(normalized_words(evidence), singular))
    numbers = F.size(F.array_except(canonical_numbers(summary), canonical_numbers(evidence))) == 0

    def enough(s: Column) -> Column:
        words = F.array_distinct(F.transform(F.filter(normalized_words(s), lambda w: F.length(w) > 3), singular))
        return 2 * F.size(F.array_intersect(words, held)) >= F.size(words)

    return numbers & F.forall(sentences(summary), enough)


def tag_is_evidenced(tag: Column, words: Column) -> Column:
    """The tag's words, singular or plural, stand in a row among the words."""
    asked, held = F.transform(normalized_words(tag), singular), F.transform(words, singular)
    starts = F.when((F.size(asked) > 0) & (F.size(held) >= F.size(asked)), F.sequence(F.lit(1), F.size(held) - F.size(asked) + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(held, i, F.size(asked)) == asked)


def fold_tags(tags: Column) -> Column:
    """Tags in order without those whose words another, earlier or longer, tag holds all; six at most, of 40 characters."""
    short = F.filter(F.array_distinct(F.transform(tags, lambda t: F.trim(F.lower(t)))), lambda t: (t != "") & (F.length(t) <= 40))

    def folded(parts: Column) -> Column:
        over = lambda t: F.exists(parts, lambda o: (F.size(o["w"]) > F.size(t["w"])) & (F.size(F.array_except(t["w"], o["w"])) == 0))
        return F.transform(F.slice(F.filter(parts, lambda t: ~over(t)), 1, 6), lambda t: t["t"])

    return bound(F.transform(short, lambda t: F.struct(t.alias("t"), F.split(t, " ").alias("w"))), folded)


def refuses_number(question: Column, kept: Column, total: Column) -> Column:
    """A question for a number is refused if any claim fell; any other if half of them or more did."""
    asks = F.lower(question).rlike(r"\b(?:how (?:many|much)|what (?:number|percent\w*|amount|price|total))\b")
    return F.when(total == 0, False).when(asks, kept < total).otherwise(kept / total < 0.5)
