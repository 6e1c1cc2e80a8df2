"""Rules that the tables don't exercise, on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import scores, text
from docloom.operators import chunks, library, retrieval
from docloom.sources import readers, sinks
from docloom.streaming import state


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first()[0]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("password: hunter2", "password: [REDACTED]"),
        ("see ftp://ann:pw@host/x", "see ftp://ann:[REDACTED]@host/x"),
        ("Authorization: Bearer abc.def", "Authorization: Bearer [REDACTED]"),
        ("a eyJhbGci.eyJzdWIi b", "a [REDACTED] b"),
        ("-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "[REDACTED]"),
        ('token = "0123456789abcdef"', 'token = "0123456789abcdef"'),
        (None, ""),
    ],
)
def test_redaction(spark, given, expected):
    assert one(spark, text.redact_credentials, given) == expected


def test_quoted_values_are_redacted_on_request(spark):
    assert one(spark, lambda c: text.redact_credentials(c, quoted=True), 'token = "0123456789abcdef"') == 'token = "[REDACTED]"'


@pytest.mark.parametrize(("given", "expected"), [("stocks", "stock"), ("whats", "whats"), ("countries", "country"), ("prices", "prices"), ("dies", "dies")])
def test_plural_stem(spark, given, expected):
    assert one(spark, text.plural_stem, given) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("HTTP://A.com:80/x?utm_source=q&b=1#f", "http://a.com/x?b=1"),
        ("https://a.com", "https://a.com/"),
        ("https://u:p@a.com/", None),
        ("nothing", None),
    ],
)
def test_canonical_url(spark, given, expected):
    assert one(spark, text.canonical_url, given) == expected


@pytest.mark.parametrize(("given", "expected"), [(0.125, 12), (0.135, 14), (0.5, 50), (1.0, 100), (64.5, 64), (250.0, 100), (-1.0, 0)])
def test_match_percentage_rounds_half_to_even(spark, given, expected):
    assert one(spark, text.match_percentage, given, "double") == expected


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(scores.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_fingerprint_ignores_case_and_spaces(spark):
    rows = spark.createDataFrame([("fact", " i ", "HAS__PET", "a  dog"), ("fact", "I", "has pet", "a dog")], "k string, s string, p string, o string")
    assert len({r[0] for r in rows.select(scores.fingerprint("k", "s", "p", "o")).collect()}) == 1


def test_chunks_cover_the_text_and_keep_lines():
    body = "\n".join(["A short line."] * 3 + ["word " * 1500 + "end."] + ["", "Last one."])
    made = list(chunks.chunk_text(body))
    assert [c[0] for c in made] == list(range(len(made)))
    assert all(c[4] <= chunks.MOST for c in made)
    assert made[0][2] == 1 and made[-1][3] == 6
    assert "".join("".join(c[1].split()) for c in made) == "".join(body.split())


def test_one_chunk_is_single_and_empty_has_none():
    assert [c[5] for c in chunks.chunk_text("Tiny.")] == ["single"]
    assert list(chunks.chunk_text("")) == []


def test_tree_rollup_counts_subtrees(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "d")], "id int, parent_id int, name string")
    leaves = spark.createDataFrame([(3, 5.0), (3, 6.0), (1, 1.0)], "at int, size double")
    got = {r["id"]: (r["n_items"], r["total_size"]) for r in library.tree_rollup(nodes, leaves, "at", "size", 4).collect()}
    assert got == {1: (3, 12.0), 2: (2, 11.0), 3: (2, 11.0), 4: (0, 0.0)}


def test_scoped_representation_keeps_asked_files(spark):
    pool = spark.createDataFrame([(7, 1, 0.9), (8, 2, 0.2), (8, 3, 0.3), (9, 4, 0.05)], "file int, chunk int, score double")
    got = retrieval.scoped_representation(pool.where("file = 7"), pool, "file", "score", ["chunk"])
    assert sorted((r["file"], r["chunk"]) for r in got.collect()) == [(7, 1), (8, 3)]


def test_text_elements_number_lines_from_one(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc\n"), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in readers.text_elements(docs).collect()]
    assert got == [(1, 0, "a\nb", 1, 2), (1, 1, "c", 4, 4)]


def test_publish_shows_the_newest_revision(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(k,) for k in range(n)], "chunk int")
    for revision, n in ((1, 2), (2, 3)):
        sinks.publish(rows(n), str(tmp_path), 5, revision)
    assert sorted(r["chunk"] for r in sinks.current(spark, str(tmp_path)).collect()) == [0, 1, 2]


def run_stream(spark, tmp_path, rows, schema, build, name):
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_publishing_a_revision_again_keeps_what_readers_have(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(k,) for k in range(n)], "chunk long")
    sinks.publish(rows(4), str(tmp_path), 7, 1)
    before = sinks.current(spark, str(tmp_path))
    sinks.publish(rows(2), str(tmp_path), 7, 1)
    assert before.count() == 4
    assert sorted(map(tuple, sinks.current(spark, str(tmp_path)).select("chunk", "file_id", "revision").collect())) == [(0, 7, 1), (1, 7, 1)]


def test_scrubbed_stream_equals_the_whole_redacted(spark, tmp_path):
    import re

    redact = lambda t: re.sub(r"(?i)(password: )(\S+)", r"\1[REDACTED]", t)
    parts = [[("s", 0, "hello wor", False)], [("s", 1, "ld the pass", False)], [("s", 2, "word: hun", False)], [("s", 3, "ter2 bye", True)]]
    got = run_stream(spark, tmp_path, parts, "stream_id string, seq long, text string, final boolean", lambda df: state.scrub_stream(df, redact), "scrubbed")
    assert "".join(r["text"] for r in got) == "hello world the password: [REDACTED] bye"


def test_scrubbed_stream_equals_the_whole_under_the_real_rules(spark, tmp_path):
    import random
    import re

    from docloom.functions import text

    steps = [(text.PRIVATE_KEY, text.REDACTED), (text.SSH_LINE, text.REDACTED), (text.URL_USERINFO, rf"\1://\2:{text.REDACTED}@"), (text.BEARER, f"Bearer {text.REDACTED}"), (text.JWT, text.REDACTED), (text.PASSWORD_FOR, rf"\1{text.REDACTED}"), (text.LABELLED_VALUE, rf"\1\2{text.REDACTED}")]

    def redact(t):
        for pattern, by in steps:
            t = re.sub(pattern, by, t)
        return t

    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIE\nabcd\n-----END RSA PRIVATE KEY-----"
    lines = ["hello world", "note ssh-rsa AAAABBBB me", "password: hunter22 and more", "the token is", "abcdefgh tail", "", key, "see http://bob:pw@host/x", "Bearer abc.def-ghi", "-----BEGIN CERTIFICATE-----", "password for bob: letmein1", "secret", "", "s3cr3tvalue end", "bye"]
    rng, whole = random.Random(1), "\n".join(lines * 2)
    cuts = sorted({0, len(whole), *(rng.randrange(len(whole)) for _ in range(40))})
    parts = [[("s", k, whole[a:b], b == len(whole))] for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = run_stream(spark, tmp_path, [sum(parts[k : k + 8], []) for k in range(0, len(parts), 8)], "stream_id string, seq long, text string, final boolean", lambda df: state.scrub_stream(df, redact), "real")
    assert "".join(r["text"] for r in got) == redact(whole) and len(got) > 1
    assert state.releasable(whole[: whole.index("abcd")], 4000) < whole.index("-----BEGIN RSA") + 1


def test_registry_numbers_items_once(spark, tmp_path):
    rows = [[("r", 0, "a"), ("r", 1, "b")], [("r", 2, "a"), ("r", 3, "c")]]
    got = run_stream(spark, tmp_path, rows, "run_id string, seq long, item_key string", state.evidence_registry, "registry")
    assert sorted(r["item_key"] for r in got) == ["a", "b", "c"] and sorted(r["label"] for r in got) == ["V1", "V2", "V3"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("given", "expected"),
    [("2+2", 4.0), ("(3 + 4) * 2", 14.0), ("2^10", 1024.0), ("7//2", 3.0), ("-5 % 3", 1.0), ("1/0", None), ("2**99", None), ("a+1", None), ("", None), (None, None), ("+".join("1" * 70), None)],
)
def test_arithmetic(given, expected):
    from docloom.functions.facts import arithmetic

    assert arithmetic(given) == expected


@pytest.mark.parametrize(("given", "expected"), [("what is 2+2?", "2+2"), ("in 2024-2025", None), ("id 123-45-6789", None), ("none", None)])
def test_expression_in(spark, given, expected):
    from docloom.functions.facts import expression_in

    assert one(spark, expression_in, given) == expected


def test_spelling_is_only_set_right_when_clear(spark):
    from docloom.functions.facts import spelled

    fix = spelled(["retrieval", "evidence", "document"])
    assert one(spark, fix, "Documnt of evidance") == "Document of evidance"
    assert one(spark, fix, "cats") == "cats"


def test_acronyms_are_expanded_once(spark):
    from docloom.functions.facts import expand_acronyms

    got = one(spark, lambda c: expand_acronyms(c, {"RAG": "retrieval augmented generation"}), "RAG helps")
    assert got == "RAG (retrieval augmented generation) helps"


@pytest.mark.parametrize(("given", "expected"), [("My name is Ann", ("name", "Ann")), ("maybe call me Ann", None), ("my wife said my name is Ann", None), ("I prefer metric units", ("units", "metric")), (None, None)])
def test_identity_fact(spark, given, expected):
    from docloom.functions.facts import identity_fact

    got = one(spark, identity_fact, given)
    assert (tuple(got) if got else None) == expected


def test_entities_pair_with_their_nearest_number(spark):
    from docloom.operators import grounding

    rows = frame(spark, [(1, "Acme sold 20 units while Zeta sold 35 units.")], "id int, t string")
    assert sorted(tuple(r) for r in grounding.entity_numbers(rows, "id", "t").collect()) == [(1, "Acme", "20"), (1, "Zeta", "35")]


def test_relations_decimals_and_refusals(spark):
    from docloom.operators import grounding

    assert one(spark, grounding.relation_triples, "Ann Lee is the head of sales. nothing here.") == ["Ann Lee|the head of sales"]
    assert [one(spark, grounding.decimal_form, x) for x in ("142.70", "1,000", "3.00", "10")] == ["142.7", "1000", "3", "10"]
    rows = frame(spark, [("how many?", 1, 2), ("who?", 1, 2), ("who?", 0, 2), ("who?", 0, 0)], "q string, k int, t int")
    assert [r[0] for r in rows.select(grounding.refuses_number(F.col("q"), F.col("k"), F.col("t"))).collect()] == [True, False, True, False]


def test_summaries_must_be_grounded(spark):
    from docloom.operators import grounding

    rows = frame(spark, [("The invoice lists 120 items.", "an invoice that lists 120 items"), ("The invoice lists 130 items.", "an invoice that lists 120 items"), ("Penguins conquered Rome.", "an invoice")], "s string, e string")
    assert [r[0] for r in rows.select(grounding.summary_is_grounded("s", "e")).collect()] == [True, False, False]


def test_questions(spark):
    from docloom.functions import questions

    assert one(spark, questions.parts, "Who is it? what then; last and then more") == ["Who is it", "what then", "last", "more"]
    assert [one(spark, questions.needs_web, x) for x in ("latest news", "2+2?", "convert 3 km to miles today", "my notes")] == [True, False, False, False]
    assert one(spark, questions.topics, 'On "deep nets" by Ada Lovelace at NASA') == ["deep nets", "Ada Lovelace", "NASA"]
    assert [one(spark, questions.literal_phrase, x) for x in ("ab", "word", "two words", "a-1")] == [None, None, "two words", "a-1"]
    rows = frame(spark, [("what about it", "solar panels"), ("cats purr", "solar panels"), ("solar panels cost", "solar panels"), ("x", None)], "q string, b string")
    assert [r[0] for r in rows.select(questions.turn_kind("q", "b")).collect()] == ["follow_up", "new_topic", "follow_up", "new_topic"]


def test_scopes(spark):
    from docloom.operators import jobs

    rows = frame(spark, [([1], [2], [3, 1], [1, 2, 3]), ([1], [9], None, [1]), (None, None, [7], [1])], "s array<long>, e array<long>, f array<long>, a array<long>")
    assert [r[0] for r in rows.select(jobs.resolve_scope(F.col("s"), F.col("e"), F.col("f"), F.col("a"))).collect()] == [[1, 2, 3], [], None]


def test_pages_lose_their_furniture(spark):
    html = "<html><head><title> A  b </title></head><body><nav>menu</nav><script>x<1</script><p>One &amp; two</p><!-- c --><footer>f</footer></body></html>"
    assert one(spark, readers.page_title, html) == "A b" and one(spark, readers.page_text, html) == "One & two"


def test_grounding_text_and_summary(spark):
    from docloom.operators import grounding

    assert one(spark, grounding.grounding_text, "Sold 1,234  units (5%) on the 3rd") == "sold 1234 units (5) on the 3"
    body = "Ok. This first sentence counts. Hm! So does this second one. And the third one too. Not a fourth one."
    assert one(spark, text.extractive_summary, body) == "This first sentence counts. So does this second one. And the third one too."
    assert one(spark, text.extractive_summary, "Too short. No.") is None
    assert one(spark, lambda c: text.cut_at_word(c, 12), "alpha beta gamma") == "alpha beta"
