"""SentencePiece ids against the library, periodic runs and hard negatives against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import negatives, pieces, queries, runs
from docloom.llm.common import table

DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "x y z"), (None, None), (4, "Ünï ço dé\n\n\nend "), (5, " \t\r\n "), (6, "the " * 3000), (7, "  two  spaces ▁ and <s> </s> <0x0A>"), (8, "日本語のテキスト😀" * 40), (9, "\x00\x01é́")]
MODEL = queries.tokenizer_path("piece_bpe_32k.model")
ALPHABETS = ["abcdefgh", "aab ", "abcdeilnorst  ", "1234567890 .,;", "éèàüñçß ", "   \n\t", "{}()[];=<>/\\_- ab", "日本語한국어😀 "]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


# ---- 11: SentencePiece

@pytest.mark.parametrize("least", [0, 395])
def test_ids_and_texts_are_the_librarys(least):
    rng = random.Random(least)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(least, least + 90))) for a in ALPHABETS for _ in range(200 if least == 0 else 20)]
    found, sp = pieces.codec(MODEL).encode(texts, True, True), library()
    assert [ids(x) for x in found] == sp.encode(texts, add_bos=True, add_eos=True)
    assert [pieces.codec(MODEL).decode(x) for x in found] == [sp.decode(ids(x)) for x in found]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(pieces.codec(MODEL).encode([text], False, False)[0]) == library_once().encode(text)


def library_once(found=[]):  # noqa: B006
    if not found:
        found.append(library())
    return found[0]


def test_rounds_and_queue_agree_where_a_merge_makes_a_better_pair():
    """Three pieces of which the longest has the best rank: after b+c the pair a+bc comes before other b+c."""

    class Toy(pieces.Pieces):
        def __init__(self):
            self.symbols = {"a": 0, "b": 1, "c": 2, "bc": 3, "abc": 4, "bcbc": 5, "bcb": 6}
            self.n, self.width = 7, 8
            pairs = [(1 * 8 + 2, 5, 3), (0 * 8 + 3, 2, 4), (3 * 8 + 1, 1, 6), (3 * 8 + 3, 0, 5)]
            self.keep_pairs(*(np.array(x, t) for x, t in zip(zip(*pairs), (np.int64, np.int32, np.int32))))

    def one_by_one(word, toy):
        word = list(word)
        while True:
            best = min(((int(r), k, int(m)) for k in range(len(word) - 1) for r, m in [[x[0] for x in toy.look_up(np.array([word[k]]), np.array([word[k + 1]]))]] if r < pieces.NONE), default=None)
            if best is None:
                return word
            word[best[1] : best[1] + 2] = [best[2]]

    toy, rng = Toy(), random.Random(4)
    words = [[rng.randrange(3) for _ in range(rng.randint(0, 14))] for _ in range(400)] + [[1, 2, 1, 2, 1, 2]]
    flat, sizes = pieces.merge_rounds(np.array([s for w in words for s in w], np.int32), np.array([len(w) for w in words]), toy)
    got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [one_by_one(w, toy) for w in words]
    assert [pieces.merge_queue(list(w), toy) for w in words if w] == [g for w, g in zip(words, got) if w]


def test_ids_in_any_order_decode_as_the_library_does():
    rng, sp = random.Random(8), library()
    lists = [[rng.choice([rng.randrange(3, 259), rng.randrange(32000), 29871, 1]) for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    assert [pieces.codec(MODEL).decode(np.array(x, "<u4").tobytes()) for x in lists] == [sp.decode(x) for x in lists]
    with pytest.raises(ValueError):
        pieces.codec(MODEL).decode(np.array([32000], "<u4").tobytes())


def test_texts_are_cut_without_a_change(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdeilnorst  ") for _ in range(30_000)) + "x" * 9000 + " " * 900 + "日本語" * 3000
    monkeypatch.setattr(pieces, "SLICE", 500)
    own = pieces.Codec(MODEL)
    monkeypatch.setattr(pieces, "WORDS_KEPT", 50)
    found = own.encode([text, "", text[:700]], True, True)
    assert [ids(x) for x in found] == library().encode([text, "", text[:700]], add_bos=True, add_eos=True)
    assert own.decode(found[0]) == text


@pytest.mark.parametrize("size", [1, 9, 1000])
def test_slices_of_any_size_end_between_words(monkeypatch, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab e9.,-▁\n  éßñ日本한😀\u0301") for _ in range(rng.choice([0, 0, 1, 40, 300]))) for _ in range(60)]
    monkeypatch.setattr(pieces, "SLICE", size)
    own, sp = pieces.Codec(MODEL), library()
    found = own.encode(texts, True, True)
    assert [ids(x) for x in found] == sp.encode(texts, add_bos=True, add_eos=True)
    rows = [*found, b"", found[-1] + found[3], found[0][:4], *(x[4:] for x in found)]
    assert own.decode_all(rows) == [sp.decode(ids(x)) for x in rows]


def test_words_are_merged_once_and_without_what_no_piece_holds_together(monkeypatch):
    met, learn = Counter(), pieces.Codec.learn
    monkeypatch.setattr(pieces.Codec, "learn", lambda self, words: met.update(words) or learn(self, words))
    texts = [f"item {k}, price {k}.{k % 100}; done({k})" for k in range(500)]
    assert [ids(x) for x in pieces.Codec(MODEL).encode(texts, False, False)] == library().encode(texts)
    assert max(met.values()) == 1 and len(met) < 50  # digits are pieces of their own, so numbers are no new words


def test_query_encodes_a_text_once(spark, sf_dir):
    found = queries.op11_sentencepiece(spark, sf_dir)
    assert found._jdf.queryExecution().executedPlan().toString().count("run(") == 1


def test_models_that_change_texts_are_refused(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, text: text.lower())
    with pytest.raises(ValueError):
        pieces.Pieces(MODEL)


def test_encoding_of_odd_rows(spark):
    rows, sp = spark.createDataFrame(ODD, DOC).withColumn("ids", F.lit(1)), library()
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in pieces.decode_documents(pieces.encode_documents(rows, MODEL), MODEL).collect())
    told = [(k, sp.encode(t or "", add_bos=True, add_eos=True)) for k, t in ODD]
    assert got == Counter((k, len(x), np.array(x, "<u4").tobytes(), sp.decode(x)) for k, x in told)
    assert pieces.encode_documents(spark.createDataFrame([], DOC), MODEL).collect() == []
    bad = spark.createDataFrame([(1, bytes([97, 0xE2, 0x82, 98]))], "doc_id long, text binary")
    assert ids(pieces.encode_documents(bad, MODEL).first()["ids"]) == sp.encode("a��b", add_bos=True, add_eos=True)


def test_query_of_pieces(spark, sf_dir):
    sp, texts = library(), dict(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    for r in queries.op11_sentencepiece(spark, sf_dir).collect():
        found = sp.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(found, "<u4").tobytes(), sp.decode(found).encode())]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(found), *digests]


# ---- 13: runs

def runs_by_brute_force(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        begin = 0
        for i in range(len(words) - q + 1):
            if i == len(words) - q or words[i] != words[i + q]:
                if i + q - begin >= max(least, 2 * q):
                    found.setdefault((begin, i + q), q)  # the smallest period comes first
                begin = i + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def wordy(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 70))]
    if kind == 1:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 15))]
        return [rng.choice("xyz") for _ in range(rng.randint(0, 9))] + (unit * 9)[: rng.randint(5, 90)] + [rng.choice("abx") for _ in range(rng.randint(0, 30))]
    if kind == 2:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(3, 7)):
            a, b = b, b + a
        return b
    return [w for _ in range(rng.randint(1, 5)) for w in [rng.choice("abcdef") for _ in range(rng.randint(1, 8))] * rng.randint(1, 6)]


@pytest.mark.parametrize("least", [12, 4, 7])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    docs = [wordy(rng) for _ in range(600)]
    size, found, texts = runs.analysed([" ".join(d).encode() for d in docs], least)
    got = [[(r["start"], r["length"], r["period"]) for r in x] for x in found.to_pylist()]
    assert got == [runs_by_brute_force(d, least) for d in docs]
    assert texts.to_pylist() == [collapsed(d, g) for d, g in zip(docs, got)]
    assert size.to_pylist() == [len(d) for d in docs]


def test_words_that_no_gram_repeats_are_masked():
    words = [f"w{k}" for k in range(40)] + ["a", "b", "c"] * 6 + [f"v{k}" for k in range(30)]
    ids_ = np.unique(words, return_inverse=True)[1]
    assert [x.tolist() for x in runs.unmasked(ids_, np.zeros(len(ids_), int), 6, 12)] == [[40], [58]]
    twice = np.concatenate([ids_[:9], ids_[:9]])  # the same words in two documents repeat in neither
    assert [x.tolist() for x in runs.unmasked(twice, np.repeat([0, 1], 9), 6, 12)] == [[], []]


def test_short_tables_of_stretches_reach_as_far(monkeypatch):
    monkeypatch.setattr(runs, "TABLE", 1)
    words = (["a", "b", "c", "d", "e"] * 200)[:990]
    assert runs.analysed([" ".join(words).encode()], 12)[1].to_pylist() == [[{"start": 0, "length": 990, "period": 5}]]


def test_runs_of_odd_rows(spark, monkeypatch):
    rows = [*ODD, (20, "a b " * 40_000), (21, " ".join(f"w{k}" for k in range(100_000))), (21, "x\x0by\x0cz q " * 9)]
    got = runs.periodic_runs(spark.createDataFrame(rows, DOC).withColumn("runs", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r, (k, text) in zip(got, rows):
        words = [w.decode() for w in (text or "").encode().split()]
        assert (r["doc_id"], r["n_words"]) == (k, len(words))
        if len(words) < 5000:
            assert [tuple(x) for x in r["runs"]] == runs_by_brute_force(words)
    assert [tuple(x) for x in got[-3]["runs"]] == [(0, 80_000, 2)] and got[-3]["collapsed"] == "a b"
    assert got[-2]["runs"] == []
    assert runs.periodic_runs(spark.createDataFrame([], DOC)).collect() == []


def test_query_of_runs(spark, sf_dir):
    texts = dict(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    seen = 0
    for r in queries.op13_runs(spark, sf_dir).collect():
        words = [w.decode() for w in (texts[r["doc_id"]] or "").encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = runs_by_brute_force(words)
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        told = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        assert tuple(r)[1:5] == (len(found), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        seen += bool(found)
    assert seen > 10


def test_texts_without_words_or_ids_are_not_made_cyclic(spark):
    rows = [(k, t) for k in range(40) for t in (None, "", " \n")] + [(None, "a b")]
    assert Counter(map(tuple, queries.cyclic(spark.createDataFrame(rows, DOC)).collect())) == Counter(rows)


# ---- 12: hard negatives

VEC = "vec_id long, embedding array<float>, label int"


def mined(rows, every=50, positives=5, negatives_=3):
    """rows: (id, integer vector, label), each a row of its own."""
    out = []
    for a, (i, v, lab) in enumerate(rows):
        if i % every:
            continue
        others = sorted(((-sum(x * y for x, y in zip(v, w)), j, b) for b, (j, w, other) in enumerate(rows) if b != a), key=lambda r: r)
        near = [r for r in others if rows[r[2]][2] == lab][:positives]
        for s, j, _ in near:
            fit = [r for r in others if rows[r[2]][2] != lab and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives_]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return Counter(out)


def vectors(rng, n, dim=6, groups=5):
    centres = rng.standard_normal((groups, dim)) * 60
    return [(int(i), [int(x) for x in centres[rng.integers(groups)] + rng.standard_normal(dim) * 40], int(rng.integers(4))) for i in rng.permutation(n)]


def got_negatives(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("uid", F.lit(1)).withColumn("key", F.lit("x"))
    return Counter(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **how).collect()))


@pytest.mark.parametrize("how", [{}, {"sample": 64, "shard": 50}, {"sample": 8, "shard": 40}])
def test_negatives_equal_brute_force(spark, how):
    rows = vectors(np.random.default_rng(3), 700)
    expected = mined(rows)
    assert got_negatives(spark, [(i, [float(x) for x in v], lab) for i, v, lab in rows], **how) == expected and len(expected) > 60


def test_copies_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 200)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(150)] + [(2000 + k, rows[0][1], (rows[0][2] + 1) % 4) for k in range(60)]
    rows += [(50, rows[3][1], 2), (50, rows[3][1], 2), (50, rows[4][1], 1), (7, [0] * 6, 0), (100, [0] * 6, 0), (101, [0] * 6, 1)]
    assert got_negatives(spark, [(i, [float(x) for x in v], lab) for i, v, lab in rows], sample=64, shard=60) == mined(rows)


def test_negatives_of_odd_rows(spark):
    rows = vectors(np.random.default_rng(6), 120)
    fine = [(i, [float(x) for x in v], lab) for i, v, lab in rows]
    odd = [(50, None, 1), (50, [None] * 6, 1), (50, [float("nan")] * 6, 1), (50, [float("inf")] + [1.0] * 5, 1), (None, [1.0] * 6, 1), (50, [9.0] * 6, None), (50, [1.0], 1), (50, [], 1)]
    assert got_negatives(spark, fine + odd) == mined(rows)
    assert got_negatives(spark, []) == got_negatives(spark, odd[:4]) == Counter()
    assert got_negatives(spark, [(0, [1.0, 2.0], 1)]) == Counter()


@pytest.mark.parametrize("tight", [True, False])
def test_bounds_hold(tight):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((500, 5)), np.ones((80, 5))])
    tree = negatives.VpTree(x, 20, tight)
    q = rng.standard_normal((40, 5)) * 2
    least, most = tree.bounds(q)
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    for k, (_, at) in enumerate(tree.parts):
        assert (d[:, at] >= least[:, [k]] - 1e-9).all() and (d[:, at] <= most[:, [k]] + 1e-9).all()
    assert sorted(np.concatenate([at for _, at in tree.parts]).tolist()) == list(range(580))
    for k, node in enumerate(tree.leaves):
        assert (tree.place(x[tree.leaves[node]]) == k).all()


def test_query_of_negatives(spark, sf_dir):
    rows = [(i, [int(np.floor(256 * np.float64(x))) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    found = queries.op12_negatives(spark, sf_dir)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, found.collect())) == mined(rows)
