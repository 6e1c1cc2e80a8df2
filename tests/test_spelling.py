"""Near words by deletions equal all pairs by distance."""

import random

from docloom.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def words(rng, n):
    found = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 11))) for _ in range(n)}
    return sorted(found | {w[:3] + rng.choice("abx") + w[4:] for w in found} | {w[::2] for w in found})


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(2)
    asked, known = words(rng, 200), words(rng, 120)
    df = lambda ws: spark.createDataFrame([(w,) for w in [*ws, None, ws[0]]], "word string")
    got = {tuple(r) for r in spelling.near_words(df(asked), df(known)).collect()}
    most = lambda w: 0 if len(w) < 4 else 1 if len(w) < 8 else 2
    pairs = {(a, b, distance(a, b)) for a in asked for b in known if len(a) >= 4}
    assert got == {p for p in pairs if p[2] <= most(p[0])} and len(got) > 100


def test_only_clear_corrections(spark):
    df = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    vocabulary = df(["letter", "better", "document", "documents"])
    got = {tuple(r) for r in spelling.corrections(df(["leter", "netter", "documnt", "letter", "dokumentz", "xyz", "abcdefgh"]), vocabulary).collect()}
    assert got == {("leter", "letter", 1), ("documnt", "document", 1)}
    assert spelling.corrections(df([]), vocabulary).collect() == spelling.corrections(df(["leter"]), df([])).collect() == []
