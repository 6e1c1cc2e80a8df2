"""Corpus operators against brute force, on small tables and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import ann, chat, licenses, lines, mixing, neardup_vectors, packing, simhash, substrings, toxicity
from docloom.llm.common import connected_components, table
from docloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "x y z"), (None, None), (4, "Ünï ço dé\n\n\nend "), (5, " \t\r\n "), (6, "the " * 3000), (7, "the " * 3000), (8, "a b\nc d\na b\nc d"), (9, "a b\nc d")]


def texts(spark, n=200):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for k in range(n):
        body = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 9)))
        if k % 7 == 3:
            body = rows[rng.randrange(k)][1]
        elif k % 7 == 5:
            body = rows[rng.randrange(k)][1].replace("a", "b", 1)
        elif k % 11 == 4:
            body = body + "\n" + passage + "\n" + body
        rows.append((k, body))
    return rows


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def components(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


# ---- components

@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (3, 9)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(30)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(frame(spark, edges, "a long, b long")).collect()}
    label = components(60, [e for e in edges if e[0] != e[1]])
    assert got == {x: label[x] for e in edges if e[0] != e[1] for x in e}


# ---- 1: substrings

def removed(rows):
    seen, out = set(), {}
    for k, body in sorted(rows, key=lambda r: r[0]):
        b = (body or "").encode()
        windows = [b[i : i + 50] for i in range(len(b) - 49)]
        gone = bytearray(len(b))
        for i, w in enumerate(windows):
            if w in seen:
                gone[i : i + 50] = b"\1" * 50
        seen.update(windows)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("block", "bucket", "segment", "bits"), [(4_000_000, 12_000_000, 1_000_000, 64), (3_000, 1_000, 1_000_000, 64), (3_000, 1_000, 70, 64), (3_000, 1_000, 150, 8), (20_000, 1_000_000, 1_000_000, 8)])
def test_substrings_equal_brute_force(spark, block, bucket, segment, bits):
    rows = texts(spark, 150) + [(1000 + k, "é" * 40 + str(k)) for k in range(3)] + [(2000, "z" * 49), (2001, "z" * 49), (2002, "z" * 300), (2003, "z" * 60)]
    got = {r[0]: tuple(r)[1:] for r in substrings.dedup_substrings(frame(spark, rows), block_bytes=block, bucket_bytes=bucket, segment=segment, key_bits=bits).collect()}
    assert got == removed(rows)


def test_suffixes_are_sorted_by_their_bytes():
    rng = np.random.default_rng(5)
    text = np.concatenate([rng.integers(97, 99, 3000), np.tile(rng.integers(97, 100, 37), 60), np.full(400, 97), rng.integers(97, 99, 3000)]).astype(np.uint8)
    at = rng.permutation(len(text) - 49)
    order, fresh = substrings.sorted_suffixes(text, at)
    found = [text[p : p + 50].tobytes() for p in at[order]]
    assert found == sorted(found) and sorted(order.tolist()) == list(range(len(at)))
    assert fresh.tolist() == [k == 0 or found[k] != found[k - 1] for k in range(len(found))]


def test_substrings_of_long_and_repeated_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    rows = [(1, long[:1_000_100]), (2, long), (2, long), (3, long), (None, "x" + long[2_400_000:]), (4, long[999_970:1_000_030])]
    got = Counter(tuple(r)[:4] for r in substrings.dedup_substrings(frame(spark, rows)).collect())
    assert got == Counter([(1, 1_000_100, 0, 0), (2, 2_500_000, 1_000_100, 1), (2, 2_500_000, 1_000_100, 1), (3, 2_500_000, 2_500_000, 1), (None, 100_001, 100_000, 1), (4, 60, 60, 1)])


def test_substrings_of_odd_rows(spark):
    got = substrings.dedup_substrings(frame(spark, ODD).withColumn("block", F.lit(1))).collect()
    assert len(got) == len(ODD)
    big = {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in (6, 7)}
    assert big == {6: 0, 7: 12000}
    assert substrings.dedup_substrings(frame(spark, [])).collect() == []


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_strings_of_one_first_fingerprint_are_told_apart(spark, block):
    a = bytes(range(50))
    mixed = lambda w: (h := (int.from_bytes(w, "little") ^ 50) * int(substrings.MULTIPLIERS[0]) % 2**64) ^ h >> 29
    head = b"differ!!"
    b = head + (mixed(a[:8]) ^ mixed(head) ^ int.from_bytes(a[8:16], "little")).to_bytes(8, "little") + a[16:]
    words = [np.frombuffer(x[k : k + 8], "<u8")[0] for x in (a, b) for k in range(43)]
    h = substrings.fingerprints(np.array(words), np.array([0, 43]), 50)
    assert a != b and h[0] == h[1]
    docs = spark.createDataFrame([(1, bytearray(a)), (2, bytearray(b)), (3, bytearray(a + b"x"))], "doc_id long, text binary")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(docs, block_bytes=block).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_cover_meets_every_pair():
    cover = set(substrings.COVER)
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + d) % substrings.PERIOD in cover and (j + d) % substrings.PERIOD in cover for d in range(substrings.PERIOD))


# ---- 2, 7, 10: against SQL

@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, cur.fetchall()))


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, "Released UNDER the MIT-license. under the mit license"), (2, mit.replace("hereby ", "")), (3, "GNU General Public License"), (4, "CC BY NC cc by-nc"), (5, None), (6, "under the mit")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"], got[1]["score"]) == (2, 1, 5, "mit", 1.0)
    assert (got[2]["n_base"], got[2]["labels"], got[2]["base_labels"]) == (0, "mit", "") and 0.8 <= got[2]["score"] < 1
    assert (got[3]["labels"], got[3]["first_word"]) == ("gpl", None)
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 0, 3)
    assert (got[5]["n_words"], got[5]["n_base"], got[5]["labels"], got[5]["score"]) == (0, 0, "", 0.0)
    assert 0 < got[6]["score"] < 0.8 and got[6]["labels"] == ""
    assert licenses.scan_licenses(frame(spark, ODD).withColumn("row", F.lit(1)).withColumn("pos", F.lit(2))).count() == len(ODD)
    assert licenses.scan_licenses(frame(spark, [])).count() == 0
    spans = licenses.scan_licenses(frame(spark, rows), spans=True).where("doc_id = 3").collect()
    assert [(r["label"], r["first_word"], r["end_word"]) for r in spans] == [("gpl", 0, 4)]


def test_lines(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(1, f"a b\nc d\ne\n{long}"), (2, f"x\na b\nc d\ny\n{long}\nz"), (3, "a b\nq\nc d"), (4, "\n\n\n"), (5, "\n\n\n"), (6, "k\nk\nk\nk"), (7, None), (None, "a b\nc d")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, rows).withColumn("n_lines", F.lit("mine"))).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "x\ny\nz" and (got[2]["n_removed"], got[2]["n_runs"]) == (3, 2)
    assert got[3]["text"] == rows[2][1] and got[5]["text"] == "\n\n\n" and got[6]["text"] == "k" and got[7]["text"] is None
    assert got[None]["text"] == ""
    assert lines.dedup_lines(frame(spark, [])).count() == 0
    assert lines.dedup_lines(frame(spark, ODD)).count() == len(ODD)


@pytest.mark.parametrize("run", [2, 3])
def test_fingerprints_are_window_minima(spark, run):
    rng = random.Random(2)
    rows = [(k, 0, [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 30))]) for k in range(40)]
    df = frame(spark, rows, "id long, tag int, lines array<string>")
    h = dict(df.select(F.explode("lines").alias("x")).distinct().select("x", F.xxhash64("x")).collect())
    want = set()
    for k, _, x in rows:
        for i in range(len(x) - run + 1):
            want.add((k, min(range(i, i + run), key=lambda p: (h[x[p]], p))))
    got = lines.winnowed(df, run, 50, True).collect()
    assert Counter(r["id"] for r in got) == Counter(k for k, _ in want) and len(want) < sum(len(x) for _, _, x in rows)
    assert sum(len(r["runs"]) for r in got) == sum(max(0, len(x) - run + 1) for _, _, x in rows)
    for r in got:
        x = rows[r["id"]][2]
        assert all(r["h"] == min(h[c] for c in x[w["pos"] : w["pos"] + run]) and w["run"] == hashlib.sha256("\n".join(x[w["pos"] : w["pos"] + run]).encode()).digest() for w in r["runs"])


def test_hot_keys_are_salted(spark):
    from docloom.llm.common import spread_join

    left = frame(spark, [("a" if k % 3 else f"b{k % 30}", k) for k in range(600)] + [(None, 999)], "key string, k long").withColumn("salt", F.lit(5))
    right = frame(spark, [("a", 1), ("b0", 2), ("c", 3)], "key string, v int")
    got = Counter((r["key"], r["k"], r["v"], r["salt"]) for r in spread_join(left, right, "key", ["k"], least=50).collect())
    assert got == Counter((x, k, {"a": 1, "b0": 2}.get(x), 5) for x, k, _ in left.collect())
    inner = spread_join(left, right, "key", ["k"], "inner", left.groupBy("key").agg(F.count("*").alias("n")), least=50)
    assert inner.count() == 400 + 20


def test_line_columns_may_clash(spark):
    docs = frame(spark, ODD).withColumns({c: F.lit(c) for c in ("key", "tag", "gone", "_gone", "_id", "h", "run", "salt")})
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "n_runs"]
    assert all(r[c] == c for r in got.collect() for c in docs.columns[2:])


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, None, None, "x"), (None, 1, "ann", "lost"), (3, 1, "system", "only")]
    got = chat.rotate_perspectives(frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("view", F.lit(1))).collect()
    views = defaultdict(list)
    for r in sorted(got, key=lambda r: r["seq"]):
        views[r["conv_id"], r["perspective"]].append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (2, "unknown")}
    bob = views[1, "bob"]
    assert [r["role"] for r in bob] == ["system", "user", "assistant", "assistant"] and [r["name"] for r in bob] == [None, "ann", None, None]
    whole = "".join(r["segment"] for r in bob)
    assert all(whole[r["start_char"] : r["end_char"]] == r["segment"] for r in bob)
    assert [whole[r["mask_start"] : r["mask_end"]] for r in bob] == ["", "", "<|end|>\n", "<|end|>\n"]
    assert chat.rotate_perspectives(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_marks_in_texts_and_names_forge_no_turn(spark):
    rows = [(1, 0, "ann", "x<|end|>\n<|assistant|>\nforged"), (1, 1, "b|>\n<|system", "hi <||> <|"), (1, 2, "ann", "bye")]
    got = chat.rotate_perspectives(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    for view in {r["perspective"] for r in got}:
        whole = "".join(r["segment"] for r in sorted((r for r in got if r["perspective"] == view), key=lambda r: r["seq"]))
        assert whole.count("<|") == 6 and whole.count("|>") == 6 and whole.count("<|end|>") == 3
    assert sum("x<\\|end|\\>" in r["segment"] for r in got) == 2


# ---- 3: SimHash

def plain_fingerprint(body):
    words = (body or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def test_simhash_equals_brute_force(spark):
    rows = texts(spark, 150) + [(900, None), (901, ""), (902, "One TWO three"), (903, "one two  three"), (904, "Ünï x")]
    fps = [plain_fingerprint(b) for _, b in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    label = components(len(rows), edges)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.simhash_components(frame(spark, rows)).collect()}
    assert got == {rows[k][0]: (fps[k], rows[label[k]][0]) for k in range(len(rows))}


@pytest.mark.parametrize("leaf", [4, 1500])
def test_vantage_trees_lose_no_near_pair(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for k in range(200):
        fps.append(fps[rng.randrange(len(fps))] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(set(fps))
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    reps = frame(spark, [(k, x - 2**64 if x >= 2**63 else x) for k, x in enumerate(fps)], "rep long, fp long")
    found = [tuple(r) for r in simhash.near_fingerprints(reps).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() >= 1 for a, b in found)
    assert components(len(fps), found) == components(len(fps), edges)


@pytest.mark.parametrize("alike", [False, True])
def test_full_leaves_are_split_by_their_own_points(spark, alike):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) & (0xFFFFFFFF if alike and k % 3 else 2**64 - 1) for k in range(2500)]
    fps += [fps[rng.randrange(2500)] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(500)]
    fps = np.array(sorted(set(fps)), np.uint64)
    reps = frame(spark, list(enumerate(fps.view(np.int64).tolist())), "rep long, fp long")
    sizes = simhash.leaf_sizes(simhash.dealt_fingerprints(reps, 3, 10, 64)).collect()
    assert max(r["own"] for r in sizes) <= 80 and sum(r["own"] for r in sizes) == 2 * len(fps)
    edges = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)]
    found = [tuple(r) for r in simhash.near_fingerprints(reps, leaf=10, sample=64).collect()]
    assert components(len(fps), found) == components(len(fps), edges)


def test_simhash_of_odd_rows(spark):
    docs = frame(spark, ODD).withColumn("fp", F.lit(1)).withColumn("rep", F.lit(2))
    assert simhash.simhash_components(docs).count() == len(ODD)
    kept = simhash.keep_one_each(docs)
    assert {r["doc_id"] for r in kept.collect()} >= {None, 1, 3} and kept.columns[0] == "doc_id"
    assert simhash.simhash_components(frame(spark, [])).count() == 0


# ---- 4 and 8: vectors

VEC = "vec_id long, embedding array<float>, label int"


def vectors(n, copies=40, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    for k in range(copies):
        x[n - 1 - k] = x[rng.integers(0, n - copies)] + (0.08 * rng.standard_normal(16) if k % 2 else 0)
    return [(int(k), [float(v) for v in row], int(k % 3)) for k, row in enumerate(x)]


BAD = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [None] + [1.0] * 15, 1), (5004, [float("inf")] * 16, 1), (5005, [], 1)]


def test_nearest_neighbours_reach_the_recall(spark):
    rows = vectors(1500, 60)
    got = defaultdict(list)
    for r in ann.search(frame(spark, rows + BAD, VEC), F.col("vec_id") % 20 == 0, leaf=40).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([r[1] for r in rows], np.float64)
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        order = [k for k in sorted(range(len(x)), key=lambda k: (-s[k], k)) if k != q][:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s[v] - sc) < 1e-9 for _, v, sc in found)
        assert [f[1] for f in found] == sorted((f[1] for f in found), key=lambda v: (-s[v], v))
        hit += len({f[1] for f in found} & set(order))
    assert set(got) == set(range(0, 1500, 20)) and hit / (20 * 75) >= 0.9


def test_few_candidates_are_all_returned(spark):
    rows = vectors(7, 2)
    got = [tuple(r) for r in ann.search(frame(spark, rows + BAD, VEC), F.col("vec_id") == 0).collect()]
    assert len(got) == 6
    assert ann.search(frame(spark, BAD, VEC), F.lit(True)).count() == 0 and ann.search(frame(spark, [], VEC), F.lit(True)).count() == 0


@pytest.mark.parametrize("block", [16, 1024])
def test_vector_links_equal_brute_force(spark, block):
    rows = vectors(400, 200)
    rows += [(900 + k, rows[5][1], 0) for k in range(30)]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9 - 1e-12) & ~np.eye(len(x), dtype=bool)
    label = components(len(rows), [tuple(map(int, e)) for e in np.argwhere(np.triu(near))])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.vector_links(frame(spark, rows + BAD, VEC), block=block).collect()}
    want = {rows[k][0]: (int(near[k].sum()), rows[label[k]][0], rows[label[k]][0] == rows[k][0]) for k in range(len(rows))}
    want |= {b[0]: (0, b[0], True) for b in BAD}
    assert got == want
    assert neardup_vectors.vector_links(frame(spark, [], VEC)).count() == 0


def test_vector_links_of_odd_ids(spark):
    v = [1.0] * 16
    rows = [(None, v, 1), (3, v, 1), (3, v, 1), (None, [1.0] * 15 + [-9.0], 1), (4, [2.0] * 16, 1)]
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in neardup_vectors.vector_links(frame(spark, rows, VEC)).collect() if r["component_id"])
    assert got == [(-1, 3, 3), (3, 3, 3), (3, 3, 3), (4, 3, 3)]


def test_no_link_is_lost_between_rows_that_share_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(rng.choice([None, int(rng.integers(0, 12))]), [float(x) for x in base[rng.integers(0, 40)] + (0.05 * rng.standard_normal(16) if k % 2 else 0)], 0) for k in range(300)]
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9 - 1e-12) & ~np.eye(len(x), dtype=bool)
    label = components(len(rows), [tuple(map(int, e)) for e in np.argwhere(np.triu(near))])
    least = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in label}
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in neardup_vectors.vector_links(frame(spark, rows, VEC), block=16).collect())
    assert got == Counter((rows[k][0], int(near[k].sum()), least[label[k]]) for k in range(len(rows)))


# ---- 5: mixing

def test_rates_match_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.5, 0.4, 0.3], 400)
    n = rng.integers(1, 500, 400)
    soft = frame(spark, [(int(a), *map(float, q)) for a, q in zip(n, p)], "n long, p0 double, p1 double, p2 double")
    weights = [0.5, 0.3, 0.2]
    steps = mixing.fit_rates(soft, 3, weights)
    rates = np.array([r[0] for r in soft.select(mixing.stepped(F.lit(1.0), F.lit(1.0), [F.col(f"p{k}") for k in range(3)], steps)["r"]).collect()])
    assert (rates >= 0).all() and np.abs((n * rates) @ p / n.sum() - weights).max() < 1e-3


def nearest_nonnegative(a, b):
    """Least squares over x >= 0 by an active set of columns."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(20 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        if free.all() or slope[~free].max() <= 1e-9:
            return x
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > -1e-12).all():
                x = np.maximum(z, 0)
                break
            low = free & (z <= 0)
            x = x + (x[low] / (x[low] - z[low])).min() * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    raise AssertionError("no solution")


@pytest.mark.parametrize(("seed", "weights"), [(1, [0.5, 0.3, 0.2]), (2, [0.9, 0.08, 0.02])])
def test_rates_equal_nonnegative_least_squares(spark, seed, weights):
    rng = np.random.default_rng(seed)
    p = 0.15 + 0.55 * rng.dirichlet([0.5, 0.5, 0.5], 60)  # no document is surely of one domain, so the last targets are out of reach
    n = rng.integers(1, 500, 60).astype(float)
    soft = frame(spark, [(int(a), *map(float, q)) for a, q in zip(n, p)], "n long, p0 double, p1 double, p2 double")
    steps = mixing.fit_rates(soft, 3, weights, rounds=80, tolerance=1e-6)
    rates = np.array([r[0] for r in soft.select(mixing.stepped(F.lit(1.0), F.lit(1.0), [F.col(f"p{k}") for k in range(3)], steps)["r"]).collect()])
    moments = (p * n[:, None]).T @ p / n.sum()
    root = np.linalg.cholesky(np.linalg.inv(moments + mixing.RIDGE * np.eye(3))).T
    want = nearest_nonnegative(root @ (p * n[:, None]).T / n.sum(), root @ np.array(weights))
    miss = lambda r: np.linalg.norm(root @ ((n * r) @ p / n.sum() - weights))
    assert (rates >= 0).all() and np.abs((n * (rates - want)) @ p / n.sum()).max() < 2e-3 and miss(rates) <= miss(want) + 1e-3


def test_columns_of_mixing_and_toxicity_may_clash(spark):
    labels = frame(spark, [(1, "a"), (3, "b")], "doc_id long, domain string")
    docs = frame(spark, ODD).withColumns({c: F.lit(c) for c in ("_id", "_domain", "_words", "_sums", "words", "sums", "_toxicity", "toxicity")})
    got = mixing.mix(docs, labels, {"a": 0.6, "b": 0.4}).collect()
    assert len(got) == len(ODD) and all(r[c] == c for r in got for c in docs.columns[2:])
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, frame(spark, [], "doc_id long, toxic int")))
    assert kept.columns == docs.columns and all(r[c] == c for r in kept.collect() for c in docs.columns[2:])


@pytest.mark.parametrize(("poor", "least"), [(0.15, 0.03), (0.3, 0.03), (0.2, 0.08)])
def test_rows_of_the_mixing_stage_match_weights(spark, sf_dir, monkeypatch, poor, least):
    import corpus_pipeline

    chance = lambda words: F.when(F.array_contains(words, "bad"), 0.9).when(F.array_contains(words, "fair"), least).otherwise(0.05)
    monkeypatch.setattr(mixing, "with_posteriors", lambda rows, model, words, names: rows.withColumns({names[0]: 1 - chance(F.col(words)), names[1]: chance(F.col(words))}).drop(words))
    docs = frame(spark, [(k, ("bad" if k < 3000 * poor else "fair" if k % 2 else "good") + f" w{k} a b") for k in range(3000)])
    out = corpus_pipeline.mixing_stage(spark, docs, sf_dir)
    q, ids = out.agg(F.avg(chance(F.split("text", " "))), F.count_distinct("doc_id")).first()
    assert ids == 3000 and abs(q - corpus_pipeline.WEIGHTS["poor"]) < 0.005


def test_mixing_of_odd_rows(spark):
    labels = frame(spark, [(1, "a"), (3, "b"), (6, "b"), (8, "a"), (None, "a"), (9, None)], "doc_id long, domain string")
    docs = frame(spark, ODD).withColumn("rate", F.lit("mine")).withColumn("n", F.lit(1))
    got = mixing.mix(docs, labels, {"a": 0.6, "b": 0.4}, keep_all=True).collect()
    assert len(got) == len(ODD) and all(r["rate"] >= 0 and r["copies"] >= 1 and abs(r["p_a"] + r["p_b"] - 1) < 1e-9 for r in got)
    same = mixing.rates(docs, labels, {"a": 0.6, "b": 0.4}, keep_all=True).collect()
    assert Counter((r["doc_id"], r["tokens"], round(r["rate"], 9), r["copies"]) for r in got) == Counter((r["doc_id"], r["tokens"], round(r["rate"], 9), r["copies"]) for r in same)
    assert mixing.mix(frame(spark, []), labels, {"a": 1.0, "b": 1.0}).count() == 0
    assert mixing.mix(frame(spark, ODD), labels.limit(0), {"a": 1.0, "b": 1.0}).count() == len(ODD)


# ---- 6: toxicity

def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    syllables = ["ing", "the", "er", "an", "ou", "st", "re", "nd", "ha", "ti", "or", "wh"]
    bad = ["vilegrub", "mudsnort", "rotbrain", "foulwretch"]
    rows, labels = [], []
    for k in range(1200):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(40, 200))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(max(3, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, marks = frame(spark, rows + [(9000, None), (9001, ""), (None, "x")]), frame(spark, labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs.withColumn("score", F.lit(1)), toxicity.fit(docs, marks)).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert [k for k in range(1200) if got[k]["held_out"]] == held
    right = Counter((labels[k][1], got[k]["predicted"]) for k in held)
    assert right[1, 1] >= 0.9 * (right[1, 0] + right[1, 1]) and right[0, 1] <= 0.05 * (right[0, 0] + right[0, 1])
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["score"] == got[9001]["score"] and not got[None]["held_out"]


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    model = toxicity.fit(docs, frame(spark, [], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.classify(docs, model).collect()] == [0.0] * len(ODD)
    assert toxicity.drop_toxic(docs, model).count() == len(ODD)
    assert toxicity.classify(frame(spark, []), model).count() == 0


# ---- 9: packing

def reference_ids(body):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return tok.encode(body or "", add_special_tokens=False).ids + [2]


def test_packing_round_trip(spark):
    rows = texts(spark, 60) + [(500 + k, t) for k, (_, t) in enumerate(ODD)] + [(700, "a  b\n\n c d <|endoftext|> it's\t x　y"), (None, "free")]
    got = packing.pack_documents(frame(spark, rows).withColumn("length", F.lit(1)), tokenizer_path(), with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for k, body in rows:
        pieces = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [x for r in pieces for x in r["ids"]] == reference_ids(body)
        assert all(r["length"] == 1024 for r in pieces[1:]) and [r["piece"] for r in pieces] == list(range(len(pieces)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack_documents(frame(spark, []), tokenizer_path()).count() == 0


def test_plan_places_every_item():
    rng = random.Random(6)
    for _ in range(30):
        counts = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(rng.randint(1, 200))}
        used, placed = defaultdict(list), Counter()
        for length, first, items, each, bin_, at in packing.plan_bins(counts):
            assert first == placed[length]
            placed[length] += items
            for k in range(items):
                used[bin_ + k // each].append((at + k % each * length, length))
        assert placed == Counter(counts)
        for parts in used.values():
            at = 0
            for a, n in sorted(parts):
                assert a == at
                at += n
            assert at <= 1024 and sum(3 * n > 1024 for _, n in parts) <= 2
        least = max(sum(k * v for k, v in counts.items()) / 1024, sum(v for k, v in counts.items() if k > 512))
        assert len(used) <= least * 1.34 + 2


def fewest_bins(items, capacity):
    """By trying every bin for every item, largest first."""
    items, best = sorted(items, reverse=True), len(items)

    def place(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(items):
            best = len(gaps)
            return
        for j in {g: j for j, g in enumerate(gaps) if g >= items[k]}.values():
            place(k + 1, [*gaps[:j], gaps[j] - items[k], *gaps[j + 1 :]])
        place(k + 1, [*gaps, capacity - items[k]])

    place(0, [])
    return best


def test_plans_are_near_the_optimum():
    rng, over = random.Random(8), Counter()
    for _ in range(300):
        items = [rng.randint(1, rng.choice([30, 50, 100])) for _ in range(rng.randint(1, 9))]
        slots = packing.plan_bins(Counter(items), 100)
        bins = max(first + -(-n // each) for _, _, n, each, first, _ in slots)
        over[bins - fewest_bins(items, 100)] += 1
    assert set(over) <= {0, 1} and over[1] <= 15


def test_a_common_length_is_dealt_to_many_tasks(spark):
    rows = frame(spark, [(k % 7, 512 if k % 3 else 500, k) for k in range(3000)], "salt int, length long, k long").withColumn("row", F.lit(1)).withColumn("slot", F.lit("x"))
    got = packing.pack(rows, ["k"], rows_a_task=100).collect()
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["k"] for r in got) == list(range(3000)) and len(used) == 1500 and got[0]["slot"] == "x"
    assert all(a == 0 and b == n for (a, n), (b, _) in (sorted(x) for x in used.values()))


def test_sequences_join_their_pieces(spark):
    packed = packing.pack_documents(frame(spark, [(1, "a b c"), (2, "d")]), tokenizer_path(), with_ids=True)
    (row,) = packing.sequences(packed).collect()
    assert sorted(row["ids"]) == sorted(reference_ids("a b c") + reference_ids("d"))


@pytest.mark.parametrize("body", [" " * 1_100_000, "a b" + "\n" * 2_000_000 + "c d", "x " + " \t" * 700_000 + "y"])
def test_long_white_space_is_encoded(body):
    want = np.array(reference_ids(body)[:-1], "<u4").tobytes()
    assert packing.Encoder(tokenizer_path())(body) == want


# ---- the pipeline

def test_pipeline_keeps_what_it_says(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(spark.createDataFrame(stage(spark, steps[-1], sf_dir).toPandas(), docs.schema))
    assert all(s.columns == docs.columns for s in steps)
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[4] == ids[3]
    marks = dict(table(spark, sf_dir, "labels").select("doc_id", "toxic").collect())
    clean = [k for k, y in marks.items() if not y]
    assert sum(k in ids[1] for k in clean) >= 0.95 * len(clean)
    fps = [plain_fingerprint(r[0]) for r in steps[3].select("text").collect()]
    assert not any((fps[i] ^ fps[j]).bit_count() <= 3 for i in range(len(fps)) for j in range(i))
    packed = corpus_pipeline.STAGES[-1][1](spark, steps[4], sf_dir)
    assert packed.select("doc_id").distinct().count() == len(ids[4])


@pytest.mark.parametrize("rows", [[], ODD, [(1, "x " * 300_000 + "y"), (1, None), (2, "x\ny\nx\ny")]])
def test_stages_take_odd_rows(spark, sf_dir, rows):
    import corpus_pipeline

    extra = ("_id", "_tag", "_gone", "key", "tag", "gone", "keep", "was", "row", "copies", "rate", "n_lines", "n_removed", "_toxicity", "length", "tokens", "words", "n_chars")
    docs = frame(spark, rows).withColumns({c: F.lit(7).cast("long") for c in extra})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.where("_gone <> 7 or row <> 7 or n_lines <> 7").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()
