"""Replies as column expressions: what of a drafted answer is shown, its follow-up questions, and queries made from turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.rules import content_words, echo_share, listed
from docloom.functions.text import col, normalized_words, sentences

CITATION = r"[ \t]*\[[VW][0-9]+(?:\s*,\s*[VW][0-9]+)*\]"
INTERNAL_TAGS = r"(?is)<(?:metadata|thinking|scratchpad)\b[^>]*>.*?</(?:metadata|thinking|scratchpad)\s*>"
OPEN_TAG = r"(?is)<(?:metadata|thinking|scratchpad|followups)\b.*$"
MARKER_LINES = r"(?im)^[ \t]*(?:metadata|answer_id|run-scope)[ \t]*[:=].*$"
TRAILING_IDS = r"(?:\n[ \t]*[0-9_]{6,}[ \t]*)+\s*$"
TRAILING_DAY = r"\n[ \t]*[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9:]{5,8}Z?)?\s*$"
MOST_FOLLOWUPS, FOLLOWUP_CHARS, FOLLOWUP_WORDS, MOST_ECHO = 4, 160, 24, 0.75
GENERIC = r"(?i)^(?:tell me more|what else|anything else|can you (?:explain|elaborate)(?: more| further)?|would you like to know more)\s*\??$"
PRONOUN = r"\b(?:he|she|they|it|him|her|them|his|hers|their|theirs|its)\b"
WEATHER_IT = r"(?i)\b(?:is|was|will) it (?:raining|snowing|hot|cold|sunny|late|early|time)\b|\bit (?:rains|snows|is raining|is snowing)\b"
PORTRAIT_CHARS, PORTRAIT_WORDS, PORTRAIT_SENTENCES = 800, 90, 4


def shown_answer(c: Column | str) -> Column:
    """An answer as it is shown: no citation marks, internal tags, marker lines, or ids and bare dates at its end."""
    out = F.coalesce(col(c), F.lit(""))
    for pattern in (INTERNAL_TAGS, OPEN_TAG, MARKER_LINES, CITATION, TRAILING_IDS, TRAILING_DAY):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+([,.;:!?])", "$1"), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def followups(c: Column | str, most: int = MOST_FOLLOWUPS) -> Column:
    """The questions that end an answer, line by line, ``most`` at most; none if nothing else would be left."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    place = F.transform(lines, lambda x, i: F.when(~x.endswith("?"), i + 1).otherwise(0))
    last = F.coalesce(F.array_max(place), F.lit(0))  # lines up to the last one that asks nothing
    tail = F.slice(lines, last + 1, F.lit(most))
    return F.when((last > 0) & (F.size(lines) - last <= most), tail).otherwise(F.array().cast("array<string>"))


def without_followups(c: Column | str, most: int = MOST_FOLLOWUPS) -> Column:
    """An answer without the questions that followups() takes from its end."""
    n = F.size(followups(c, most))
    lines = F.filter(F.split(col(c), "\n"), lambda x: F.trim(x) != "")
    return F.when(n == 0, col(c)).otherwise(F.array_join(F.slice(lines, F.lit(1), F.size(lines) - n), "\n"))


def valid_followup(question: Column, message: Column, answer: Column) -> Column:
    """A suggested question, tidied, if it is short, says something of its own and stays on the topic; else null."""
    q = F.trim(F.regexp_replace(question, r"\s+", " "))
    q = F.when(q.endswith("?"), q).otherwise(F.concat(F.regexp_replace(q, "[.!]+$", ""), F.lit("?")))
    topics, context = content_words(q), content_words(F.concat_ws(" ", message, answer))
    fits = (F.length(q) <= FOLLOWUP_CHARS) & (F.size(normalized_words(q)) <= FOLLOWUP_WORDS) & ~q.rlike(GENERIC) & (echo_share(q, message) < MOST_ECHO)
    return F.when((F.size(topics) > 0) & F.arrays_overlap(topics, context) & fits, q)


def simplified_query(c: Column | str) -> Column:
    """The first name of several words in a query, else its two most specific words in order; null if that is all it says.

    A word is the more specific the longer it is, and with capitals or digits.
    """
    words = F.filter(F.regexp_extract_all(col(c), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)), lambda w: F.size(content_words(w)) > 0)
    name = F.regexp_extract(col(c), r"\p{Lu}[\p{L}\p{N}]+(?: (?:\p{Lu}[\p{L}\p{N}]+|[0-9]+))+", 0)
    worth = lambda w: F.length(w) / 10 + F.when(w.rlike(r"^\p{Lu}"), 2).otherwise(0) + F.when(w.rlike("[0-9]"), 2).otherwise(0)
    ranked = F.transform(words, lambda w, i: F.struct(worth(w).alias("s"), (-i).alias("i"), w.alias("w")))
    two = F.sort_array(F.transform(F.slice(F.sort_array(ranked, asc=False), 1, 2), lambda x: F.struct((-x["i"]).alias("i"), x["w"].alias("w"))))
    short = F.when((name != "") & (F.lower(name) != F.lower(F.array_join(words, " "))), name).otherwise(F.array_join(F.transform(two, lambda x: x["w"]), " "))
    return F.when((F.size(words) >= 2) & (F.lower(short) != F.lower(F.array_join(words, " "))), short)


def resolved_followup(question: Column, entity: Column) -> Column:
    """A follow-up with its first pronoun replaced by the entity talked about; in front of it where it has none and fewer than five words; else null.

    `It` of weather and time stands for nothing. Without an entity nothing is resolved.
    """
    named = F.coalesce(entity, F.lit("")) != ""
    replaced = F.concat(F.regexp_extract(question, rf"(?is)^(.*?){PRONOUN}", 1), entity, F.regexp_extract(question, rf"(?is)^.*?{PRONOUN}(.*)$", 1))
    return F.when(named & ~question.rlike(WEATHER_IT), F.when(question.rlike(f"(?i){PRONOUN}"), replaced).when(F.size(normalized_words(question)) < 5, F.concat_ws(" ", entity, question)))


def portrait_problem(portrait: Column, sources: Column) -> Column:
    """The first thing wrong with a portrait in prose of what is known of a person: empty, too_long, list, invented_number or invented_name; null if nothing is.

    Names are capitalized words of four letters or more that don't begin a sentence.
    """
    text, held = F.trim(F.coalesce(portrait, F.lit(""))), F.lower(F.coalesce(sources, F.lit("")))
    words = F.size(F.split(text, r"\s+"))
    numbers = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    names = F.flatten(F.transform(sentences(text), lambda s: F.regexp_extract_all(F.regexp_replace(s, r"^\S+", ""), F.lit(r"\b\p{Lu}[\p{L}'-]{3,}"), F.lit(0))))
    return (
        F.when(text == "", "empty")
        .when((F.length(text) > PORTRAIT_CHARS) | (words > PORTRAIT_WORDS) | (F.size(sentences(text)) > PORTRAIT_SENTENCES), "too_long")
        .when(text.contains("\n") | text.rlike(r"^\s*(?:[-•*]|[0-9]+[.)])\s"), "list")
        .when(F.exists(numbers, lambda n: ~F.contains(F.replace(held, F.lit(","), F.lit("")), F.replace(n, F.lit(","), F.lit("")))), "invented_number")
        .when(F.exists(names, lambda n: ~F.contains(held, F.lower(n))), "invented_name")
    )


def about_sentence(kind: Column, values: Column) -> Column:
    """One sentence for a group of facts of a kind, in fixed words."""
    return F.when(kind == "name", F.concat(F.lit("You go by "), listed(values), F.lit("."))).when(kind == "likes", F.concat(F.lit("You like "), listed(values), F.lit("."))).when(kind == "units", F.concat(F.lit("You prefer "), listed(values), F.lit(" units."))).otherwise(F.concat(F.lit("You mentioned "), listed(values), F.lit(".")))
