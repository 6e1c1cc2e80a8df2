"""Query understanding as column expressions: recall terms, topics, parts, web needs and turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.facts import PRIVATE
from docloom.functions.text import col, consonants, holds_credentials, normalized_words, plural_stem

# Our own list: English function words that say nothing about a question's subject.
STOP = ["a", "about", "an", "and", "are", "at", "be", "by", "can", "did", "do", "does", "for", "from", "has", "have", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "that", "the", "this", "to", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your"]


def recall_terms(c: Column | str) -> Column:
    """Different words of three letters or more that aren't stop words."""
    stop = F.array(*(F.lit(w) for w in STOP))
    return F.array_distinct(F.filter(normalized_words(c), lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{L}+$") & ~F.array_contains(stop, w)))


def rare_words(c: Column | str, n: int = 10) -> Column:
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)), 1, n)


def literal_phrase(c: Column | str) -> Column:
    """The query in lower case where it may be looked for as it stands: three characters, and a space or no mere letters."""
    t = F.trim(F.lower(col(c)))
    return F.when((F.length(t) >= 3) & (t.contains(" ") | ~t.rlike(r"^\p{L}+$")), t)


def topics(c: Column | str, n: int = 5) -> Column:
    """Quoted phrases, then capitalized phrases, then acronyms; different ones, n at most.

    None of a question of under eight characters, or one that holds credentials or private matters of a person.
    """
    found = F.concat(F.regexp_extract_all(col(c), F.lit('"([^"]{2,60})"'), F.lit(1)), F.regexp_extract_all(col(c), F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"), F.lit(0)), F.regexp_extract_all(col(c), F.lit(r"\b\p{Lu}{2,6}\b"), F.lit(0)))
    kept = (F.length(F.trim(col(c))) >= 8) & ~holds_credentials(c) & ~col(c).rlike(PRIVATE)
    return F.when(kept, F.slice(F.array_distinct(found), 1, n)).otherwise(F.array().cast("array<string>"))


def needs_web(c: Column | str) -> Column:
    """Asks for news, prices or versions, or names years to come; arithmetic and units don't."""
    t = F.lower(col(c))
    sums = t.rlike(r"^[\s0-9+*/().^%-]+\??$") | t.rlike(r"\bconvert\b.*\b(?:km|miles|kg|pounds|celsius|fahrenheit)\b")
    return ~sums & t.rlike(r"\b(?:latest|today|news|current|price|stock|weather|release[sd]?|version|20[2-9][0-9]|v?[0-9]+\.[0-9]+\.[0-9]+)\b")


def parts(c: Column | str, n: int = 4) -> Column:
    """A compound question cut at `and then`, `; ` and question marks, n parts at most."""
    return F.slice(F.filter(F.transform(F.split(col(c), r"(?i)\?\s*|;\s+|\s+and then\s+"), lambda x: F.trim(x)), lambda x: x != ""), 1, n)


def turn_kind(question: Column | str, before: Column | str) -> Column:
    """follow_up where a pronoun points back or half of the terms are shared, new_topic without shared terms, else ambiguous."""
    now, old = recall_terms(question), recall_terms(before)
    shared = F.size(F.array_intersect(F.transform(now, plural_stem), F.transform(old, plural_stem)))
    points = F.lower(col(question)).rlike(r"^(?:and|also|what about|how about)\b|\b(?:it|they|them|that|those|these|he|she|his|her|their)\b")
    return F.when(col(before).isNull(), "new_topic").when(points | ((F.size(now) > 0) & (2 * shared >= F.size(now))), "follow_up").when(shared == 0, "new_topic").otherwise("ambiguous")


def word_is_known(word: Column, vocabulary: Column) -> Column:
    """A vocabulary word has the same stem, is within two edits, or has the same consonants."""
    return F.exists(vocabulary, lambda v: (plural_stem(v) == plural_stem(word)) | (F.levenshtein(v, word, 2) >= 0) | ((F.length(consonants(word)) >= 3) & (consonants(v) == consonants(word))))
