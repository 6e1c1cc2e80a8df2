"""Operators on inputs where a step that pairs or carries too much shows: rows made, rows looked at and memory held."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import unicode
from docloom.functions.stems import DOUBLED, DROPPED, REPLACED, REPLACED_NEXT, stem, sure_begin
from docloom.operators import answers, lexical


def most_rows(df):
    """The most rows that a node of the plan made while ``df`` was collected."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
    return most


def supported(relations, evidence):
    words = lambda t: {w for w in re.split(r"[^\w+#]+", t.lower()) if w}
    found = set()
    for run, entity, value in relations:
        asked = {w for w in words(value) if w != entity.lower() and len(w) >= 3}
        if not asked or any(r == run and entity.lower() in words(t) and 2 * len(asked & words(t)) >= len(asked) for r, _, t in evidence):
            found.add((run, entity, value))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_supported_relations_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["rain", "snow", "wind", "hail", "mist", "Ann", "Bob", "of", *(f"word{k}" for k in range(6))]
    text = lambda most: " ".join(rng.choice(pool) for _ in range(rng.randint(0, most)))
    relations = [(rng.randint(0, 2), rng.choice(["Ann", "Bob", "Cid"]), text(6)) for _ in range(150)]
    evidence = [(rng.randint(0, 2), k, text(6)) for k in range(60)]
    evidence += [(r, k + 100, t) for r, k, t in evidence[:20]]
    odd = [(0, None, "rain snow"), (0, "Ann", None), (None, "Ann", "rain")]
    asked = spark.createDataFrame(relations + odd, "run int, entity string, value string")
    shown = spark.createDataFrame([*evidence, (0, None, "Ann rain snow wind"), (0, 7, None)], "run int, item long, text string")
    got = answers.supported_relations(asked, shown, "run", "item", "text").collect()
    assert {tuple(r) for r in got} == supported(relations, evidence)
    assert len(got) == sum(r in supported(relations, evidence) for r in relations)


def test_a_word_of_all_items_pairs_nothing(spark):
    n = 1500
    asked = spark.range(n).select(F.lit(1).alias("run"), F.lit("Seller").alias("entity"), F.concat(F.lit("holds "), F.col("id") + 1000, F.lit(" extra more")).alias("value"))
    shown = spark.range(n).select(F.lit(1).alias("run"), "id", F.concat(F.lit("Seller holds "), F.col("id") + 1500).alias("text"))
    found = answers.supported_relations(asked, shown, "run", "id", "text")
    assert most_rows(found) <= 10 * n
    assert found.count() == n - 500


def test_texts_without_asked_words_are_not_taken_apart(spark):
    docs = spark.range(200).select("id", F.when(F.col("id") == 7, F.repeat(F.lit("x licenses "), 3)).otherwise(F.repeat(F.lit("listed lines "), 100)).alias("text"))
    index = lexical.build_index(docs, "id", F.col("text"), ["licens"])
    assert most_rows(index) <= 200
    assert [tuple(r) for r in index.collect()] == [("licens", 7, [1, 3, 5])]


def test_words_begin_with_the_sure_begin_of_their_stem(spark, sf_dir):
    rng = random.Random(5)
    endings = [*REPLACED, *REPLACED_NEXT, *DROPPED, *DOUBLED, "ing", "ed", "eed", "s", "sses", "ies", "y", "ion", "sion", "tion", "e", "bly", "bilities", "ating", "bling", "izing", "ably", "ency", "le", "l", "ly", ""]
    made = {"".join(rng.choice("abeilnrstuyz") for _ in range(rng.randint(0, 5))) + rng.choice(endings) + rng.choice(endings) for _ in range(6000)}
    words = spark.createDataFrame([(w,) for w in made if w], "word string").union(lexical.word_positions(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", F.col("text")).select("term").distinct())
    bad = [(w, t) for w, t in words.select("word", stem("word")).collect() if not w.startswith(sure_begin(t))]
    assert bad == []


def test_many_asked_terms_find_what_few_do(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Abilities, ably; ponies"), (2, "happiness relating"), (3, None), (4, "none")], "id long, text string")
    asked = ["abl", "abili", "poni", "happi", "relat", "relate"]
    found = lambda: sorted(map(tuple, lexical.word_positions(docs, "id", F.col("text"), asked).collect()))
    few = found()
    monkeypatch.setattr(lexical, "FEW", 0)
    assert few == found() == sorted(tuple(r) for r in lexical.word_positions(docs, "id", F.col("text")).where(F.col("term").isin(asked)).collect())
    assert len(few) >= 3


def test_long_texts_go_to_python_by_rows(spark):
    docs = spark.createDataFrame([("a\u0308" * 5000,), ("plain",), (None,)], "text string")
    composed = docs.select(unicode.nfc("text").alias("t"))
    decoded = docs.select(unicode.decoded_text(F.encode("text", "UTF-16"))["text"].alias("t"))
    for df in (composed, decoded):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [r[0] for r in composed.collect()] == ["\u00e4" * 5000, "plain", None]
    assert [r[0] for r in decoded.collect()] == ["a\u0308" * 5000, "plain", None]
