"""The lexical index: grammar, stems, stored postings, and ranks against brute force on small texts."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.functions.stems import SEARCH_STOP, stem
from docloom.operators import lexical


def atoms(query):
    return [[("-" if a.absent else "") + " ".join(f"{w}{k}" for w, k in a.words) for a in alt] for alt in lexical.parse_search(query)]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("red apples", [["red0", "apples0"]]),
        ('"red apples" or -pears', [["red0 apples1"], ["-pears0"]]),
        ('a "house of cards" -"the green door"', [["house0 cards2", "-green0 door1"]]),
        ("state-of-art or", [["state0 art2"]]),
        ('open "quote here', [["open0", "quote0 here1"]]),
        ("the of or and", []),
        ("", []),
        ("OR or ' - \"\"", []),
        ("-or x", [["x0"]]),
    ],
)
def test_grammar(query, expected):
    assert atoms(query) == expected


@pytest.mark.parametrize(
    ("word", "expected"),
    [("licenses", "licens"), ("licensed", "licens"), ("license", "licens"), ("running", "run"), ("ponies", "poni"), ("caresses", "caress"), ("relational", "relat"), ("hopefulness", "hope"), ("bus", "bus"), ("sky", "ski"), ("happy", "happi"), ("agreed", "agree"), ("hopeful", "hope"), ("feed", "feed"), ("adoption", "adopt"), ("is", "is"), ("größe", "größe"), ("conditional", "condit")],
)
def test_stems(spark, word, expected):
    assert spark.range(1).select(stem(F.lit(word))).first()[0] == expected


def test_words_of_one_stem_begin_alike(spark):
    rows = [(w,) for w in ["abilities", "sexes", "flying", "going", "bed", "oddly", "yes", "ties", "dying"]]
    for w, s in spark.createDataFrame(rows, "w string").select("w", stem("w")).collect():
        assert w[: lexical.LEADING] == s[: lexical.LEADING]


def brute_force(texts, query):
    """Scores by document: every stretch of words that satisfies an alternative and holds no shorter one."""
    found = {}
    for doc, words in texts.items():
        alts = [alt for alt in lexical.parse_search(query) if not any(places(words, a) for a in alt if a.absent) and any(not a.absent for a in alt)]
        stretches = [(b, e) for b, e in itertools.combinations_with_replacement(range(len(words)), 2) if any(all(any(b <= x and x + a.words[-1][1] <= e for x in places(words, a)) for a in alt if not a.absent) for alt in alts)]
        least = [s for s in stretches if not any(t != s and t[0] >= s[0] and t[1] <= s[1] for t in stretches)]
        asked = {w for alt in lexical.parse_search(query) for a in alt if not a.absent for w, _ in a.words}
        if least:
            found[doc] = round(sum(0.1 / (1 + sum(words[k] not in asked for k in range(b, e + 1))) for b, e in least), 6)
    return found


def places(words, atom):
    return [k for k in range(len(words) - atom.words[-1][1]) if all(words[k + off] == w for w, off in atom.words)]


def test_ranks_equal_brute_force(spark):
    rng = random.Random(3)
    texts = {k: [rng.choice(["red", "tin", "cup", "lid", "xx", "yy"]) for _ in range(rng.randint(0, 14))] for k in range(120)}
    queries = {q: q for q in ["red", "red tin", '"red tin"', '"red tin" cup', "red or cup -lid", '-"red tin" cup lid', '"red of tin" or "cup lid" xx', "red red", "-red", "missing", "red missing or tin cup lid"]}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()] + [(900, None), (901, "")], "id long, text string")
    got = defaultdict(dict)
    for r in lexical.search(df, "id", F.col("text"), queries).collect():
        got[r["query"]][r["id"]] = r["lexical_score"]
    assert {q: got.get(q, {}) for q in queries} == {q: brute_force(texts, q) for q in queries}
    top = lexical.search(df, "id", F.col("text"), {"q": "red tin"}, 5).orderBy("rank").collect()
    best = sorted(brute_force(texts, "red tin").items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r["id"], r["lexical_score"]) for r in top] == best and [r["rank"] for r in top] == [1, 2, 3, 4, 5]


def test_a_stored_index_is_read_by_term(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"common word{k} words licensing {'tail' * (k % 3)}") for k in range(300)], "id long, text string")
    index = lexical.build_index(docs, "id", F.col("text"))
    lexical.write_index(index, str(tmp_path), "id", buckets=16)
    found = lexical.read_terms(spark, str(tmp_path), ["licens", "word7", "common"], buckets=16)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket") and "PushedFilters: [In(term" in plan.replace("PushedFilters: [IsNotNull(term), ", "PushedFilters: [")
    assert {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()} == {"licens": 300, "word7": 1, "common": 300}
    asked = lexical.search_table(spark, {"q": '"common word7" licensed'})
    assert [tuple(r) for r in lexical.ranked(lexical.read_terms(spark, str(tmp_path), lexical.asked_terms(asked), 16), asked, "id").collect()] == [("q", 7, 1, 0.05)]
    assert lexical.read_terms(spark, str(tmp_path), [], 16).count() == 0


def test_rare_terms_count_documents_by_stem(spark):
    docs = spark.createDataFrame([(1, "License licenses"), (2, "licensing"), (3, "tin cups"), (4, "tin"), (5, "tin")], "id long, text string")
    got = lexical.rare_terms(lexical.build_index(docs, "id", F.col("text")), ["LICENSED", "tin", "cup", "none"], "id", 2)
    assert sorted(map(tuple, got.collect())) == [("LICENSED", 2, 1), ("LICENSED", 2, 2), ("cup", 1, 3)]


def test_searches_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert lexical.search(docs, "id", F.col("text"), {"q": "the"}).collect() == []
    assert lexical.search(docs.limit(0), "id", F.col("text"), {"q": "tin"}).collect() == []
    assert "or" in SEARCH_STOP
