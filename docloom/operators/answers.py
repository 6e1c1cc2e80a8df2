"""Checks of a drafted answer against its evidence: citations, relations, numbers by file, denials and draft numbers.

Evidence is taken apart into distinct (run, file, token) rows, so that no run's texts ever meet in one row; checks are joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.rules import content_words, drop_reason
from docloom.functions.scores import cosine
from docloom.functions.text import normalized_words, plain_words, sentences
from docloom.operators.grounding import claim_atoms, grounding_text

CITED_FROM = 0.5  # fixed value: the cosine from which a source supports a claim

# How an answer denies that its sources hold something.
DENIALS = [
    r"(?i)([A-Za-z][A-Za-z' \-]{2,80}?)\s+is\s+not\s+(?:explicitly\s+|clearly\s+|directly\s+)?(?:mentioned|stated|found|specified|listed|included|provided|covered|discussed)\b",
    r"(?i)(?:doesn'?t|does not|didn'?t|did not|don'?t|do not|can'?t|cannot|unable to|couldn'?t|could not)\s+(?:explicitly\s+|clearly\s+)?(?:mention|state|contain|list|include|specify|determine|find|show)\s+([A-Za-z][A-Za-z' \-]{2,80}?)(?:\s+in\s+th[eo](?:se| )|\s*[.,;]|$)",
    r"(?i)\bno\s+(?:mention of|information (?:on|about)|evidence of|record of|details? (?:on|about))\s+([A-Za-z][A-Za-z' \-]{2,80}?)(?:\s*[.,;]|$)",
]

# Words of a denial that don't tell what is denied, and words that questions and answers are made of.
DENIAL_STOP = ["the", "a", "an", "any", "this", "that", "these", "those", "of", "on", "in", "for", "about", "and", "or", "with", "from", "its", "their"]
META_WORDS = [
    "topic", "topics", "document", "documents", "file", "files", "detail", "details", "information", "info", "question", "questions", "summary", "overview", "report", "reports",
    "data", "evidence", "context", "subject", "subjects", "answer", "answers", "list", "lists", "thing", "things", "item", "items", "aspect", "aspects", "part", "parts", "section",
    "sections", "chapter", "content", "text", "texts", "page", "pages", "line", "lines", "word", "words", "kind", "kinds", "type", "types", "sort", "sorts", "form", "forms", "example", "examples",
]


def cited(sources: DataFrame, url: Column, title: Column, content: Column, query: Column, vector: Column | None = None, claim: Column | None = None, run: list[str] | None = None) -> DataFrame:
    """Sources that may be cited, with relevance_score.

    Pages without content go by their URL. Without a claim a source must hold a content word of the query; with one its
    cosine with the claim must reach ``CITED_FROM``, whatever its words. Where no source of a ``run`` has any cosine above
    0, vectors are taken as missing and all of the run's sources stay.
    """
    rows = sources.where(drop_reason(F.coalesce(url, F.lit(""))).isNull())
    if claim is None:
        text = F.lower(F.concat_ws(" ", title, content))
        return rows.where((F.size(content_words(query)) == 0) | F.exists(content_words(query), lambda w: F.contains(text, w))).withColumn("relevance_score", F.lit(None).cast("double"))
    scored = rows.withColumn("relevance_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(vector, claim))), 4))
    alive = scored.groupBy(*(run or [])).agg(F.bool_or(F.col("relevance_score") > 0).alias("_alive"))
    joined = scored.join(alive, run) if run else scored.join(F.broadcast(alive))  # one row, if there are no runs
    return joined.where((F.col("relevance_score") >= CITED_FROM) | ~F.col("_alive")).drop("_alive")


def tokens_by(evidence: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct (keys, token): the words, names and numbers of each evidence text."""
    words = F.array_union(normalized_words(grounding_text(text)), claim_atoms(text))
    return evidence.select(*keys, F.explode(words).alias("token")).distinct()


def supported_relations(relations: DataFrame, evidence: DataFrame, run: str, item: str, text: str) -> DataFrame:
    """``relations`` (run, entity, value) that one evidence item supports: it holds the entity, and half or more of the value's words.

    Of m words that occur beside the entity an item must hold t, so it holds one of the m - t + 1 that the fewest items hold:
    these alone choose items to look at, and a word that all items hold pairs nothing. Where one word is enough, its
    occurrence beside the entity decides. Values of the same words are asked once, items of the same words looked at once.
    """
    words = F.array_sort(F.array_distinct(F.filter(normalized_words("value"), lambda w: (w != F.lower("entity")) & (F.length(w) >= 3))))
    named = relations.select(run, "entity", "value", F.lower("entity").alias("_entity"), words.alias("_words"))
    asked = named.select(run, "_entity", "_words").where(F.size("_words") > 0).distinct()
    tokens = asked.select(run, "_entity", "_words", F.explode("_words").alias("token"))

    held = tokens_by(evidence, [run, item], text).where(F.col(item).isNotNull())
    beside = held.join(asked.select(run, F.col("_entity").alias("token")).distinct(), [run, "token"]).withColumnRenamed("token", "_entity").join(held, [run, item])
    told = beside.join(tokens.select(run, "_entity", "token").distinct(), [run, "_entity", "token"], "left_semi")
    bags = told.groupBy(run, "_entity", item).agg(F.array_sort(F.collect_list("token")).alias("_bag")).groupBy(run, "_entity", "_bag").agg(F.min(item).alias(item))
    places = bags.select(run, "_entity", item, F.explode("_bag").alias("token"))
    counts = places.groupBy(run, "_entity", "token").agg(F.count("*").alias("_df"))

    least = F.floor((F.size("_words") + 1) / 2).cast("int")
    known = tokens.join(counts, [run, "_entity", "token"]).groupBy(run, "_entity", "_words").agg(F.array_sort(F.collect_list(F.struct("_df", "token"))).alias("_known")).withColumn("_least", least).where(F.size("_known") >= F.col("_least"))
    several = known.where("_least > 1")
    choosing = several.select(run, "_entity", "_words", "_least", F.explode(F.slice("_known", F.lit(1), F.size("_known") - F.col("_least") + 1)).alias("_by"))
    looked = choosing.withColumn("token", F.col("_by.token")).join(places, [run, "_entity", "token"]).select(run, "_entity", "_words", "_least", item).distinct()
    full = looked.join(bags, [run, "_entity", item]).where(F.size(F.array_intersect("_words", "_bag")) >= F.col("_least"))
    enough = known.where("_least = 1").select(run, "_entity", "_words").union(full.select(run, "_entity", "_words")).distinct()

    free = named.where(F.size("_words") == 0).select(run, "entity", "value")
    good = named.join(enough, [run, "_entity", "_words"], "left_semi").select(run, "entity", "value").union(free).distinct()
    return relations.join(good, [run, "entity", "value"], "left_semi")


def unattributed_numbers(answers: DataFrame, evidence: DataFrame, run: str, file: str, text: str) -> DataFrame:
    """(run, number) of answers, that some file holds but none together with an entity of the number's sentence.

    Runs of one file and sentences without entities are left out, as are numbers that no file holds.
    """
    held = tokens_by(evidence, [run, file], text)
    several = evidence.groupBy(run).agg(F.countDistinct(file).alias("_n")).where("_n > 1").select(run)
    said = answers.join(several, run, "left_semi").select(run, F.explode(sentences(text)).alias("_s")).withColumn("_sid", F.xxhash64("_s"))
    atoms = said.select(run, "_sid", F.explode(claim_atoms("_s")).alias("token")).where(F.col("token").rlike("^[0-9]"))
    entities = said.select(run, "_sid", F.explode(F.transform(F.regexp_extract_all("_s", F.lit(r"\b\p{Lu}[\p{L}\p{N}]{2,}"), F.lit(0)), lambda x: F.lower(x))).alias("_entity")).distinct()
    known = atoms.join(held.select(run, "token").distinct(), [run, "token"], "left_semi").join(entities.select(run, "_sid").distinct(), [run, "_sid"], "left_semi")
    owned = known.join(held, [run, "token"]).join(entities, [run, "_sid"]).join(held.withColumnRenamed("token", "_entity"), [run, file, "_entity"], "left_semi")
    return known.join(owned.select(run, "_sid", "token").distinct(), [run, "_sid", "token"], "left_anti").select(run, F.col("token").alias("number")).distinct()


def denials(answer: Column | str) -> Column:
    c = F.col(answer) if isinstance(answer, str) else answer
    return reduce(F.array_union, (F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in DENIALS))


def denied_heads(answer: Column | str) -> Column:
    """The last word of what each sentence denies to find, in lower case."""
    return F.array_distinct(F.transform(denials(answer), lambda x: F.element_at(F.split(F.trim(F.lower(x)), r"\s+"), -1)))


def denied_subjects(answer: Column | str) -> Column:
    """The first telling word of what each sentence denies to find, in lower case; denials of nothing telling have none.

    What an answer denies is checked by these: `the seller on the invoice` is about the seller.
    """
    telling = lambda x: F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(DENIAL_STOP))
    return F.array_distinct(F.filter(F.transform(denials(answer), lambda x: F.get(telling(x), F.lit(0))), lambda w: w.isNotNull()))


def question_keywords(question: Column | str) -> Column:
    """The words of a question that tell what it is about: five letters or more, no word about documents or answers."""
    c = F.col(question) if isinstance(question, str) else question
    words = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]{5,}"), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(DENIAL_STOP) & ~w.isin(META_WORDS)))


def uncited_keywords(questions: DataFrame, answers: DataFrame, cited: DataFrame, run: str, text: str) -> DataFrame:
    """(run, token): telling words of a question that an answer which denies something talks of, and no cited text of the run holds.

    Question words are of letters a to z, so answers and cited texts are taken apart at all other letters too: of `Universität`
    a question asks `universit`, and both hold it. Whatever is denied, if only `this`, makes an answer a denial.
    """
    words = lambda rows: rows.select(run, F.explode(plain_words(text)).alias("token")).distinct()
    asked = questions.select(run, F.explode(question_keywords(text)).alias("token")).distinct()
    denying = answers.where(F.size(denials(text)) > 0)
    return asked.join(words(denying), [run, "token"], "left_semi").join(words(cited), [run, "token"], "left_anti")


def false_denials(answers: DataFrame, evidence: DataFrame, run: str, file: str, text: str) -> DataFrame:
    """(run, head) of answers that deny what their evidence, of two files or more, holds."""
    several = evidence.groupBy(run).agg(F.countDistinct(file).alias("_n")).where("_n > 1").select(run)
    denied = answers.select(run, F.explode(denied_subjects(text)).alias("token")).distinct()
    return denied.join(tokens_by(evidence, [run], text), [run, "token"], "left_semi").join(several, run, "left_semi").withColumnRenamed("token", "head")


def ungrounded_numbers(drafts: DataFrame, evidence: DataFrame, history: DataFrame, run: str, text: str) -> DataFrame:
    """(run, number) of drafts, that neither the evidence nor the conversation before holds outside of dates, whose years count."""
    numbers = lambda rows: rows.select(run, F.explode(claim_atoms(text)).alias("number")).where(F.col("number").rlike("^[0-9]")).distinct()
    dates = r"\b((?:19|20)[0-9]{2})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b"
    years = lambda rows: rows.withColumn(text, F.regexp_replace(text, dates, "$1"))
    return numbers(years(drafts)).join(numbers(years(evidence)).union(numbers(years(history))), [run, "number"], "left_anti")
