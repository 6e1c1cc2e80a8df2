"""Rows that must not change what is found of others: long labelled texts, rows without ids, ids of several rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import ann, simhash, toxicity

DOC = "doc_id long, text string"


def labelled(n=400):
    rng = random.Random(6)
    plain, rude = (["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(40)] for _ in range(2))
    docs = [(k, " ".join(rng.choice(rude if k % 2 and rng.random() < 0.3 else plain) for _ in range(120))) for k in range(n)]
    return docs, [(k, 1, k % 2) for k in range(n)]


@pytest.mark.parametrize("at", range(4))
def test_a_long_labelled_text_leaves_other_scores_as_they_were(spark, at):
    """Whichever class it has, and wherever in the order of hashes it comes."""
    docs, labels = labelled()
    long = docs[:at] + [(at, docs[at][1] + " " + "filler words that say nothing at all " * 250_000)] + docs[at + 1 :]
    said = []
    for rows in (docs, long):
        df = spark.createDataFrame(rows, DOC)
        model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert model.weights
        said.append({r["doc_id"]: r["predicted"] for r in toxicity.classify(df, model).collect() if r["doc_id"] >= 4})
    wrong = [sum(p != k % 2 for k, p in s.items()) for s in said]
    assert max(wrong) <= 0.05 * len(said[0])


def test_the_first_stage_keeps_its_judgement_beside_a_long_text(spark, tmp_path):
    docs, labels = labelled()
    docs = [(k, t + " " + "filler words that say nothing at all " * 250_000 if k in (0, 1) else t) for k, t in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, spark.createDataFrame(docs, DOC), str(tmp_path)).collect()}
    assert sum(k % 2 == 0 and k not in kept for k in range(2, 400)) <= 8 and sum(k % 2 == 1 and k in kept for k in range(2, 400)) <= 20


def test_training_reads_stretches_of_long_texts(spark):
    body = "".join(f"{k:07d} " for k in range(20_000))
    rows = spark.createDataFrame([(1, body), (2, "short")], DOC)
    got = [bytes(r[0]).decode() for r in rows.orderBy("doc_id").select(toxicity.stretches(F.col("text").cast("binary"), 1600)).collect()]
    assert len(got[0]) == 1600 and got[0].startswith(body[:100]) and got[0].endswith(body[-100:]) and got[1] == "short"
    many = spark.createDataFrame([(k, body) for k in range(60)], DOC)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    found, _ = toxicity.training_rows(many, labels, "doc_id", "text", "toxic", 100, 16_000, 1600)
    assert Counter(y for _, y in found) == {0: 10, 1: 10} and {len(t) for t, _ in found} == {1600}


def linked(points, bits):
    """Component of each (id, fp) by brute force: the smallest id that is reachable over all points, with ids or without."""
    fps = sorted({f for _, f in points})
    part = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= bits and part[b] < part[a]:
                    part[a], changed = part[b], True
    least = defaultdict(lambda: None)
    for i, f in points:
        if i is not None:
            least[part[f]] = i if least[part[f]] is None else min(i, least[part[f]])
    return Counter((i, f, least[part[f]]) for i, f in points)


@pytest.mark.parametrize("leaf", [None, 4])
def test_rows_without_ids_link_others(spark, monkeypatch, leaf):
    rng = random.Random(7)
    fps = {0b000, 0b111, 0b111111, 1 << 40, (1 << 40) | 0b111, 0b1111 << 50}
    while len(fps) < 80:
        f = rng.choice(sorted(fps))
        for _ in range(rng.choice([2, 3, 3, 9])):
            f ^= 1 << rng.randrange(62)
        fps.add(f)
    points = [(None if rng.random() < 0.5 else k, f) for k, f in enumerate(sorted(fps))] + [(None, 0b111), (500, 1 << 40)]
    points = [(None, f) if f == 0b111 else (i, f) for i, f in points]
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs, *how: docs.select("id", "fp"))
    if leaf:
        monkeypatch.setattr(simhash, "LEAF", leaf)
    docs = spark.createDataFrame(points, "id long, fp long")
    got = Counter(map(tuple, simhash.simhash_components(docs.withColumn("doc_id", F.col("id"))).select("doc_id", "fp", "component_id").collect()))
    assert got == linked(points, 3)


def test_query_rows_of_one_id_each_get_their_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(1, 200) if k % 20] + [(20, rng.standard_normal(8).tolist()) for _ in range(2)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, recall=1.0).collect()
    assert Counter(r["query_id"] for r in found) == {20: 40}
    x = np.array([v for _, v in rows])
    expected = Counter()
    for a in (len(rows) - 2, len(rows) - 1):
        s = (x * x[a]).sum(axis=1)
        best = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-s[b], rows[b][0]))[:20]
        expected += Counter((20, n + 1, rows[b][0]) for n, b in enumerate(best))
    assert sum((expected - Counter((r["query_id"], r["rank"], r["vec_id"]) for r in found)).values()) <= 1
    assert any(r["vec_id"] == 20 for r in found) == any(k[2] == 20 for k in expected)
