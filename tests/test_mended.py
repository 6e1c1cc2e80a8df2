"""Rules and changes of rows against what they are meant to say, on rows that once gave something else."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.operators import answers, library, mutations
from docloom.sources import readers


def value(spark, column):
    return spark.range(1).select(column).first()[0]


FAR = "x" * 60


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (f"Annual report 2020 {'word ' * 120} select", "report"),
        ("Press the button for the annual report", None),
        (f"Click: status report {FAR} Status Report 3", "report"),
        (f"select {FAR} business report {FAR} menu", "report"),
        ("annual report, progress report: menu", None),
        ("Slide deck of the annual report", "presentation"),
        ("P.O. number 7 and annual report", "purchase_order"),
        ("", None),
        (None, None),
    ],
)
def test_raster_kind_looks_around_each_cue(spark, text, kind):
    assert value(spark, rules.raster_kind(F.lit(text))) == kind


@pytest.mark.parametrize(
    ("text", "dates"),
    [("12 10 2020 11 2021", ["2020-10-12"]), ("may 5 99; 5-May-1999", ["1999-05-05", "2099-05-05"]), ("1. 2. 03 4", ["2003-02-01"]), ("99.99.2020 1/1/2020", ["2020-01-01"]), ("1 (2) 2020", []), ("mayor 5 2020", []), ("", [])],
)
def test_dates_are_read_by_parts(spark, text, dates):
    assert value(spark, rules.prose_dates(F.lit(text))) == dates


@pytest.mark.parametrize(
    ("tag", "sensitive"),
    [("see a.com", True), ("a.community", False), ("12345", True), ("ISO 27001", False), ("iso 27001 x", True), ("road", True), ("road safety", False), ("town", False), ("4 town", True), ("1-2-3-4-5-6-7", True), ("www.x", True), ("code 1234", False), ("rain", False)],
)
def test_sensitive_tags_by_classes(spark, tag, sensitive):
    assert value(spark, rules.is_sensitive_tag(F.lit(tag))) is sensitive


@pytest.mark.parametrize(
    ("address", "public"),
    [
        ("2606:4700:4700::1111", True), ("2001:4860:4860:0:0:0:0:8888", True), ("::1", False), ("::", False), ("fe80::1", False), ("FC00::1", False), ("ff02::1", False), ("2001:db8::1", False), ("2002::1", False),
        ("::ffff:808:808", True), ("::ffff:a00:1", False), ("1::2::3", False), ("1:2:3:4:5:6:7:8:9", False), ("1:2:3:4:5:6:7", False), (":1::2", False), ("12345::", False), ("g::1", False), ("8.8.8.8", True), ("10.0.0.1", False), (None, False),
    ],
)
def test_public_addresses_of_both_kinds(spark, address, public):
    assert value(spark, F.coalesce(rules.is_public_address(F.lit(address).cast("string")), F.lit(False))) is public


@pytest.mark.parametrize(
    ("text", "heads"),
    [("The seller on the invoice is not mentioned.", ["seller"]), ("This is not mentioned.", []), ("There is no information about the GDP of Qatar.", ["gdp"]), ("I cannot find the total in the file", ["total"]), ("All fine.", [])],
)
def test_denials_name_the_first_telling_word(spark, text, heads):
    assert value(spark, answers.denied_subjects(F.lit(text))) == heads


def test_question_keywords(spark):
    assert value(spark, answers.question_keywords(F.lit("Which documents about those Sellers list rain, sellers and totals?"))) == ["which", "sellers", "totals"]


@pytest.mark.parametrize(
    ("question", "answer", "cited", "uncited"),
    [
        ("Welche Universität?", "The Universität: its rain is not mentioned.", "Berlin.", ["universit"]),
        ("Welche Universität?", "The Universität: its rain is not mentioned.", "Die Universität.", []),
        ("Sellers of steel?", "Prices are not known; the rain is not mentioned. Sellers+steel#", "Steel+iron", ["sellers"]),
        ("Which sellers?", "This is not mentioned by sellers.", "Rain.", ["sellers"]),
        ("Which sellers?", "The sellers are known.", "Rain.", []),
        ("Wo ßenheit?", "The ßenheit: its rain is not mentioned.", "Rain.", []),
        ("The İstanbul office?", "The İstanbul oﬃce: its rain is not mentioned.", "Rain.", ["office", "stanbul"]),
    ],
)
def test_question_keywords_are_found_beside_letters_with_marks(spark, question, answer, cited, uncited):
    asked, said, shown = (spark.createDataFrame([(1, t)], "run long, text string") for t in (question, answer, cited))
    assert sorted(r["token"] for r in answers.uncited_keywords(asked, said, shown, "run", "text").collect()) == uncited


def test_layout_trees_with_odd_numbers(spark):
    tree = {"kids": [
        {"type": "heading", "heading level": "Doctitle", "content": "Top", "page number": "2"}, {"type": "heading", "heading level": "2", "content": "Sub", "page number": 0},
        {"type": "table", "rows": [{"cells": [{"column number": "1", "content": "a"}, {"column number": "x", "content": "b"}]}, {"cells": [{"column span": "2", "content": "v"}, 5]}]},
        {"content": "Text", "page number": [1]}, 7,
    ]}
    rows = spark.createDataFrame([(1, json.dumps(tree)), (2, "nonsense"), (3, None)], "doc_id long, layout string")
    got = [tuple(r)[1:] for r in readers.layout_elements(rows).collect()]
    assert got == [(0, "heading", 1, "Top", 2, "Top"), (1, "heading", 2, "Sub", None, "Top > Sub"), (2, "table_row", 0, "a: v | b: v", None, "Top > Sub"), (3, "paragraph", 0, "Text", None, "Top > Sub")]


def test_a_swap_refuses_infinite_components(spark):
    chunks = spark.createDataFrame([(1, [0.0])], "id long, embedding array<double>")
    with pytest.raises(ValueError):
        mutations.swap_embeddings(chunks, spark.createDataFrame([(1, [float("inf")])], chunks.schema), "id", 1)


def test_updates_of_rows_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "id long, name string, _match int")
    other = spark.createDataFrame([(1, "new", 9), (None, "x", 1)], "id long, fresh string, __match int")
    got = mutations.update_from(rows, other, ["id"], {"name": F.col("fresh")}).orderBy("_match").collect()
    assert [tuple(r) for r in got] == [(1, "new", 5), (2, "b", 6), (None, "c", 7)]


FILES = "file_id long, folder_id long, granted boolean, current_revision long, desired_revision long, status string, is_deleted boolean"


def test_a_tree_comes_back_from_the_trash(spark):
    rows = [(1, 11, True, 3, 3, "ready", True), (2, 11, True, None, 1, "cancelled", True), (3, 12, False, None, None, "not_granted", True), (4, 99, True, None, 1, "cancelled", True), (5, 11, True, None, 4, "running", False)]
    tree = spark.createDataFrame([(11, 10), (12, 10), (10, 10), (99, 99)], "id long, ancestor long")
    files, jobs = mutations.restored(spark.createDataFrame(rows, FILES), tree, 10)
    got = {r["file_id"]: (r["status"], r["is_deleted"], r["desired_revision"]) for r in files.collect()}
    assert got == {1: ("ready", False, 3), 2: ("queued", False, 2), 3: ("not_granted", False, None), 4: ("cancelled", True, 1), 5: ("running", False, 4)}
    assert [tuple(r) for r in jobs.collect()] == [(2, 2, "queued", 0)]


def test_only_the_holder_of_a_lease_finishes_a_job(spark):
    jobs = spark.createDataFrame([(1, "running", "a", None, None), (2, "running", "b", None, None), (3, "running", "c", "2024", None), (4, "queued", "d", None, None), (5, "running", "e", None, None)], "id long, state string, lease_owner string, cancelled_at string, error_code string")
    done = spark.createDataFrame([(1, "a", None), (2, "old", None), (3, "c", None), (4, "d", None), (5, "e", "timeout")], "id long, lease_owner string, error_code string")
    got = {r["id"]: (r["state"], r["error_code"]) for r in mutations.finished(jobs, done, ["id"]).collect()}
    assert got == {1: ("succeeded", None), 2: ("running", None), 3: ("running", None), 4: ("queued", None), 5: ("failed", "timeout")}


@pytest.mark.parametrize("depth", [1, 2, 9])
def test_trees_of_any_depth(spark, depth):
    nodes = spark.createDataFrame([(k, k - 1 if k else None, f"n{k}") for k in range(depth)], "id long, parent_id long, name string")
    got = {(r["id"], r["ancestor"]): r["path"] for r in library.tree_paths(nodes).collect()}
    assert got == {(k, a): "/".join(f"n{x}" for x in range(k + 1)) for k in range(depth) for a in range(k + 1)}
    with pytest.raises(ValueError):
        library.tree_paths(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], nodes.schema), 8)
