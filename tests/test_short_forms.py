"""Short forms: quorum by context, conflicts, and texts that stay."""

import pytest

from docloom.operators import short_forms

FORMS = [("AB", "Alpha Beta", ["greek"], False), ("AB", "Air Base", ["planes"], False), ("UN", "United Nations", ["peace"], True), ("X1", "Extra One", [], False)]


@pytest.mark.parametrize(
    ("text", "history", "detected", "resolved"),
    [
        ("The AB of greek", None, ["AB"], "The Alpha Beta (AB) of greek"),
        ("The AB", "on planes", ["AB"], "The Air Base (AB)"),
        ("greek planes of AB", None, ["AB"], "greek planes of AB"),
        ("what does AB stand for", None, ["AB"], "what does AB stand for"),
        ("AB and UN, UN", None, ["AB", "UN"], "AB and United Nations (UN), United Nations (UN)"),
        ("the United Nations or UN", None, ["UN"], "the United Nations or UN"),
        ("X1 meaning", None, ["X1"], "Extra One (X1) meaning"),
        ("one X1", None, ["X1"], "one Extra One (X1)"),
        ("X1", None, ["X1"], "X1"),
        ("ABC UNO ab", None, [], "ABC UNO ab"),
        ("", None, [], ""),
        (None, "x", [], None),
    ],
)
def test_short_forms(spark, text, history, detected, resolved):
    forms = spark.createDataFrame(FORMS, "code string, meaning string, topics array<string>, free boolean")
    rows = spark.createDataFrame([(1, text, history), (1, text, history)], "id long, text string, history string")
    got = short_forms.resolved_short_forms(rows, forms, "id", "text", "history").collect()
    assert [tuple(r) for r in got] == [(1, detected, resolved)] * 2


def test_conflicts(spark):
    forms = spark.createDataFrame([*FORMS, ("AB", "Acid Bath", ["planes", "acid"], False)], "code string, meaning string, topics array<string>, free boolean")
    assert [tuple(r) for r in short_forms.conflicting_forms(forms).collect()] == [("AB", 3, 1)]
