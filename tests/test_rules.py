"""Rules and checks of answers on small cases, and the chunker on texts of each shape."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.operators import answers, chunks, mutations


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("The U.S. rules", "The US rules"), ("U. S. rules", "US rules"), ("U.S.A.", "USA"), ("by A. Smith", "by A. Smith"), ("end. Go", "end. Go"), ("e.g. this", "eg this")],
)
def test_merged_abbreviations(spark, given, expected):
    assert value(spark, rules.merged_abbreviations(F.lit(given))) == expected


@pytest.mark.parametrize(("given", "expected"), [("3/4/21 and 3 March 2021", ["2021-03-03", "2021-04-03"]), ("Mar 3rd, 1999", ["1999-03-03"]), ("40/1/2020", []), ("none", [])])
def test_prose_dates(spark, given, expected):
    assert value(spark, rules.prose_dates(F.lit(given))) == expected


def test_expanded_cells(spark):
    cells = F.array(*(F.struct(F.lit(c).cast("int").alias("column"), F.lit(s).cast("int").alias("span"), F.lit(t).alias("text")) for c, s, t in [(2, 2, "a"), (None, None, "b"), (6, 0, None), (7, 1, "c")]))
    assert value(spark, rules.expanded_cells(cells)) == ["", "a", "a", "b", "", "", "c"]


@pytest.mark.parametrize(("given", "expected"), [([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")])
def test_listed(spark, given, expected):
    assert value(spark, rules.listed(F.array(*map(F.lit, given)).cast("array<string>"))) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [("8.8.8.8", True), ("10.1.2.3", False), ("172.31.0.1", False), ("172.32.0.1", True), ("127.0.0.1", False), ("1.2.3", False), ("1.2.3.256", False), ("x", False), (None, False)],
)
def test_public_addresses(spark, given, expected):
    assert value(spark, rules.is_public_ipv4(F.lit(given).cast("string"))) is expected


@pytest.mark.parametrize(("given", "expected"), [("https://www.bit.ly/x", "blocklist"), ("https://a.b/intent/tweet?x", "suspicious"), ("https://x.org/shop/1", "suspicious"), ("https://store.apple.com/shop/1", None), ("https://x.org/news", None)])
def test_drop_reasons(spark, given, expected):
    assert value(spark, rules.drop_reason(F.lit(given))) == expected


def test_denied_heads(spark):
    said = "The seller is not mentioned. It doesn't state the final price. No record of rain."
    assert sorted(value(spark, answers.denied_heads(F.lit(said)))) == ["price", "rain", "seller"]


def test_citations_need_a_word_or_a_cosine(spark):
    rows = spark.createDataFrame([(1, "https://x.org/1", "on rain", [1.0, 0.0]), (2, "https://bit.ly/1", "on rain", [1.0, 0.0]), (3, "https://x.org/3", "on snow", [0.0, 1.0])], "id int, url string, content string, v array<double>")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(answers.cited(rows, F.col("url"), F.lit(""), F.col("content"), F.lit("what about the rain"))) == [1]
    claim = lambda *x: F.array(*map(F.lit, x))
    assert ids(answers.cited(rows, F.col("url"), F.lit(""), F.col("content"), F.lit(""), F.col("v"), claim(0.1, 1.0))) == [3]
    assert ids(answers.cited(rows, F.col("url"), F.lit(""), F.col("content"), F.lit(""), F.col("v"), claim(0.0, 0.0))) == [1, 3]


def test_a_swap_of_part_of_the_vectors_is_refused(spark):
    old = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id int, embedding array<double>")
    with pytest.raises(ValueError):
        mutations.swap_embeddings(old, old.where("id = 1"), "id", 1)


# ---- sources

def test_layout_trees_become_elements(spark):
    import json

    from docloom.sources import readers

    cell = lambda t, **k: {"content": t, **{a.replace("_", " "): b for a, b in k.items()}}
    tree = {"type": "document", "kids": [
        {"type": "heading", "heading level": 1, "content": "A", "page number": 1},
        {"type": "paragraph", "content": " one "},
        {"type": "heading", "heading level": 2, "content": "B", "page number": 2},
        {"type": "table", "page number": 3, "rows": [{"cells": [cell("k"), cell("v", column_span=2)]}, {"cells": [cell("x"), cell("7", column_number=3)]}]},
        {"type": "heading", "heading level": 1, "content": "C"}, {"kids": [{"type": "list item", "content": "two"}, "lost", None]},
    ]}
    rows = spark.createDataFrame([(1, json.dumps(tree)), (2, "{"), (3, None)], "doc_id long, layout string")
    got = [tuple(r)[1:] for r in readers.layout_elements(rows).orderBy("doc_id", "ordinal").collect()]
    assert got == [(0, "heading", 1, "A", 1, "A"), (1, "paragraph", 0, "one", None, "A"), (2, "heading", 2, "B", 2, "A > B"), (3, "table_row", 0, "k: x | v: 7", 3, "A > B"), (4, "heading", 1, "C", None, "C"), (5, "list item", 0, "two", None, "C")]


def test_grids_become_lines(spark):
    from docloom.sources import readers

    cells = spark.createDataFrame([(1, 1, 0, " a  b "), (1, 1, 2, "c"), (1, 0, 1, "h"), (2, 5, 0, None)], "t int, row int, column int, text string")
    assert dict(map(tuple, readers.grid_text(cells, ["t"]).collect())) == {1: " | h\na b |  | c", 2: ""}


# ---- streams

def streamed(spark, tmp_path, batches, schema, transform, name, mode="append"):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    found = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = transform(source).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, _: found.append(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [r for rows in found for r in rows]


PART = "stream_id string, seq long, text string, final boolean"


def test_numbers_are_held_until_the_answer_is_checked(spark, tmp_path):
    from docloom.streaming import state

    parts = [[("a", 0, "It has ", False), ("b", 0, "No figure ", False)], [("a", 1, "some 42 parts", False), ("b", 1, "here.", True)], [("a", 2, " now.", True)]]
    got = streamed(spark, tmp_path, parts, PART, lambda df: state.held_numbers(df, lambda t: "42 parts" in t), "held")
    by = lambda k: [r["text"] for r in got if r["stream_id"] == k]
    assert "".join(by("a")) == "It has some 42 parts now." and not any("4" in x for x in by("a")[:-1]) and "".join(by("b")) == "No figure here."


def test_deltas_are_never_taken_back(spark, tmp_path):
    import re

    from docloom.streaming import state

    parts = [[("a", 0, "One [V1] two\nthr", False)], [("a", 1, "ee [W2", False)], [("a", 2, "] four", True)]]
    got = streamed(spark, tmp_path, parts, PART, lambda df: state.projected_deltas(df, lambda t: re.sub(r" ?\[[VW]\d+\]", "", t)), "deltas")
    assert [r["text"] for r in got] == ["One two\n", "three four"]


def test_updates_become_deltas_of_one_node(spark, tmp_path):
    from docloom.streaming import state

    rows = [[("r", 0, "final", "ab"), ("r", 1, "plan", "x")], [("r", 2, "final", "abcd"), ("r", 3, "final", "zz"), ("r", 4, "final", "abcd")]]
    got = streamed(spark, tmp_path, rows, "run_id string, seq long, node string, text string", lambda df: state.final_deltas(df, "final"), "final")
    assert [(r["seq"], r["delta"]) for r in sorted(got, key=lambda r: r["seq"])] == [(0, "ab"), (2, "cd")]


def test_mentions_keep_topics_alive(spark, tmp_path):
    import datetime

    from docloom.streaming import state

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [[("u", "rain", day(0))], [("u", "rain", day(20)), ("v", "snow", day(60))], [("v", "snow", day(61))]]
    got = streamed(spark, tmp_path, rows, "user string, topic string, at timestamp", state.live_topics, "topics", "update")
    rain = [(r["last_seen"], r["expires_at"]) for r in got if r["topic"] == "rain"]
    assert rain == [(day(0), day(30)), (day(20), day(50))] and max(r["expires_at"] for r in got) == day(91)


# ---- chunks

def chunked(text, **how):
    return [dict(zip(("ordinal", "text", "first", "last", "tokens", "kind", "section", "lead"), c)) for c in chunks.chunk_text(text, **how)]


def test_a_small_text_is_one_chunk():
    assert [(c["kind"], c["text"], c["section"]) for c in chunked("# A\nhello there")] == [("single", "A\nhello there", "A")]


def test_headings_start_chunks_and_name_sections():
    got = chunked("# A\none two\n## B\nthree\n## C\nfour\n# D\nfive", target=3, most=10)
    assert [(c["section"], c["text"]) for c in got] == [("A", "A\none two"), ("A > B", "B\nthree"), ("A > C", "C\nfour"), ("D", "D\nfive")]


def test_sections_stay_whole_up_to_the_maximum():
    got = chunked("# A\n" + "\n".join("w " * 4 for _ in range(5)), target=5, most=30)
    assert len(got) == 1


def test_code_blocks_stand_alone():
    got = chunked("intro words\n```\nx = 1\ny = 2\n```\nmore words\n```\nz = 3\n```\nlast", target=50, most=80)
    assert [(c["kind"], c["text"]) for c in got] == [("text", "intro words"), ("code", "x = 1\ny = 2"), ("text", "more words"), ("code", "z = 3"), ("text", "last")]


def test_tables_repeat_their_header():
    rows = "\n".join(f"| {k} | v{k} |" for k in range(12))
    got = chunked("| k | v |\n" + rows, target=20, most=30)
    assert len(got) > 2 and all(c["text"].startswith("| k | v |\n") and c["tokens"] <= 30 for c in got)
    assert [r for c in got for r in c["text"].split("\n")[1:]] == rows.split("\n")


def test_long_sentences_are_cut_at_boundaries_and_lose_nothing():
    text = " ".join(f"w{k}" + ("." if k % 9 == 8 else "") for k in range(200)) + " " + "x" * 30 + " y" * 100
    got = chunked(text, target=20, most=20, overlap=4)
    assert all(c["tokens"] <= 20 for c in got) and "".join("".join(c["text"].split()) for c in got) == "".join(text.split())
    assert got[1]["lead"].split() == chunks.TOKEN.findall(got[0]["text"])[-4:]


def test_prose_fills_chunks_to_the_target():
    got = chunked("\n".join("a b c d" for _ in range(10)), target=10, most=20)
    assert [c["tokens"] for c in got] == [8] * 5 and [(c["first"], c["last"]) for c in got][:2] == [(1, 2), (3, 4)]
