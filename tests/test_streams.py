"""Streams with a time to live: what they say equals a plain fold over the same items, and the table form; states end."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.streaming import registry, state

ITEM = "run_id string, generation long, seq long, at timestamp, kind string, item_key string, relevant boolean"
PART = "stream_id string, seq long, text string, final boolean"
START = datetime.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, build, name):
    """What a stream of these batches, a file each, puts out; it is ended once all is read."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        return spark.table(name).collect(), query.lastProgress
    finally:
        query.stop()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def items(n=260, runs=3):
    rng, at, out = random.Random(5), START, []
    for seq in range(n):
        at += datetime.timedelta(seconds=rng.choice([5, 40, 200, 700]))
        out.append((f"r{rng.randrange(runs)}", seq // 60 - rng.choice([0, 0, 0, 1]), seq, at, rng.choice("VW"), f"k{rng.randrange(9)}", rng.random() < 0.3))
    return out


def folded(rows, ttl, most):
    """(run, since, label, kind, item) -> relevant, by a plain loop."""
    live, out = {}, {}
    for run_id, generation, _, at, kind, item, relevant in rows:
        r = live.get(run_id)
        alive = r is not None and at < r["until"]
        if alive and generation < r["generation"]:
            r["until"] = at + ttl
            continue
        if not alive or generation > r["generation"]:
            r = live[run_id] = {"since": at, "generation": generation, "items": {}, "n": Counter()}
        r["until"] = at + ttl
        if (kind, item) not in r["items"]:
            if len(r["items"]) >= most:
                continue
            r["n"][kind] += 1
            r["items"][kind, item] = f"{kind}{r['n'][kind]}"
        key = (run_id, r["since"], r["items"][kind, item], kind, item)
        out[key] = out.get(key, False) or relevant
    return out


@pytest.mark.parametrize("most", [40, 3])
def test_an_expiring_registry_equals_a_fold(spark, most):
    rows = items()
    got = registry.registry_table(spark.createDataFrame(rows, ITEM), 600, most).collect()
    assert {tuple(r)[:5]: r["relevant"] for r in got} == folded(rows, datetime.timedelta(seconds=600), most) and len(got) > 20


def test_the_stream_says_what_the_table_says(spark, rocks, tmp_path):
    rows = items(120, 2)
    got, progress = run(spark, tmp_path, [rows[k : k + 30] for k in range(0, 120, 30)], ITEM, lambda df: registry.registry_stream(df, "1 hour", 600, 4), "expiring")
    said = {}
    for r in got:
        said[tuple(r)[:5]] = said.get(tuple(r)[:5], False) or r["relevant"]
    assert said == folded(rows, datetime.timedelta(seconds=600), 4)
    assert max(Counter((tuple(r)[:5], r["relevant"]) for r in got).values()) == 1  # each said once, and once more when it turns relevant


def test_idle_runs_leave_the_state(spark, rocks, tmp_path):
    late = START + datetime.timedelta(hours=9)
    batches = [[(f"r{k}", 0, k, START, "V", "a", False) for k in range(20)], [("last", 0, 99, late, "V", "a", False)], [("last", 0, 100, late + datetime.timedelta(minutes=1), "V", "b", False)]]
    got, progress = run(spark, tmp_path, batches, ITEM, lambda df: registry.registry_stream(df, "10 minutes"), "idle")
    assert len(got) == 22
    assert progress["stateOperators"][0]["numRowsTotal"] <= 12  # of the last run alone: its value, its items and its timer


def test_ended_runs_of_updates_are_forgotten(spark, tmp_path):
    schema = "run_id string, seq long, node string, text string, at timestamp"
    hours = lambda k: START + datetime.timedelta(hours=k)
    batches = [[("r", 0, "final", "ab", hours(0)), ("r", 1, "plan", "x", hours(0))], [("r", 2, "final", "abc", hours(0.1))], [("s", 3, "final", "z", hours(5))], [("s", 4, "final", "zz", hours(5.1))]]
    got, progress = run(spark, tmp_path, batches, schema, lambda df: state.final_deltas(df, "final", "at"), "ended")
    assert [tuple(r) for r in got] == [("r", 0, "ab"), ("r", 2, "c"), ("s", 3, "z"), ("s", 4, "z")]
    assert progress["stateOperators"][0]["numRowsTotal"] == 1


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2], [2, 3, 1, 0]])
def test_parts_may_come_in_any_order(spark, tmp_path, order):
    texts = ["It has ", "some 42 ", "parts\nand [V1] more", "\nin all"]
    batches = [[("a", k, texts[k], k == 3)] for k in order]
    got, _ = run(spark, tmp_path / "h", batches, PART, lambda df: state.held_numbers(df, lambda t: t == "".join(texts)), f"held{order[0]}")
    assert "".join(r["text"] for r in got) == "".join(texts) and not any("4" in r["text"] for r in got[:-1])
    got, _ = run(spark, tmp_path / "p", batches, PART, lambda df: state.projected_deltas(df, lambda t: t.replace("[V1] ", "")), f"projected{order[0]}")
    assert "".join(r["text"] for r in got) == "".join(texts).replace("[V1] ", "")


def test_registry_of_nothing(spark):
    assert registry.registry_table(spark.createDataFrame([], ITEM)).collect() == []
    one = registry.registry_table(spark.createDataFrame([(None, 0, 0, START, "V", None, None)], ITEM)).select("label", F.col("relevant").isNull().alias("n")).collect()
    assert [tuple(r) for r in one] == [("V1", True)]
