"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import connected_components, merge_labels, settled, spread_join

THRESHOLD = 0.9
RECALL = 0.998  # of pairs just at the threshold that share a code in some table; nearer pairs share more
BUCKET = 64  # vectors that a bucket would hold on average if directions were spread evenly
BLOCK = 1024  # vectors of a bucket that one side of a comparison holds
SEED = 7


def usable(vector: str) -> F.Column:
    """True for vectors with a finite direction: not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def layout(n: int, threshold: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(tables, bits): bits grow with the logarithm of the number of vectors, tables so that the recall stays."""
    bits = max(4, min(60, math.ceil(math.log2(max(2, n / bucket)))))
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - agree)))) if agree < 1 else 1, bits


def codes(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The sign pattern of each vector in each table."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (np.int64(1) << np.arange(bits))).sum(axis=2)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large and very small numbers finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def link_cell(x: np.ndarray, c: np.ndarray, n: np.ndarray, right: np.ndarray, same: bool, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight gained, root) of each member of a cell: two blocks of a bucket, ``right`` marking the second, or one with itself.

    Members are in order of id. Pairs that share an earlier table's code are left to that table.
    """
    parent, gain = np.arange(len(x)), np.zeros(len(x), np.int64)
    rows, cols = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
    i, j = np.nonzero(x[rows] @ x[cols].T >= threshold)
    i, j = rows[i], cols[j]
    if same:
        i, j = i[i < j], j[i < j]
    if table:
        new = (c[i, :table] != c[j, :table]).all(axis=1)
        parent = merge_labels(parent, i, j)
        i, j = i[new], j[new]
    else:
        parent = merge_labels(parent, i, j)
    np.add.at(gain, i, n[j])
    np.add.at(gain, j, n[i])
    return gain, parent


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Rows with equal components are one class with a number of its own; the classes are hashed, so copies never meet as
    pairs. A bucket is cut into blocks, and each pair of blocks is a cell of its own: a bucket of any size is spread out.
    A cell returns the weights that its members gain and a spanning forest, not its pairs. A pair counts in the first
    table that it shares, so links are counted once. Vectors of different lengths never link; unusable ones have no
    links and are their own component, kept. Rows count as links whatever their ids; ids come in only when components are
    named by their smallest one. A component without any id is null, and none of its rows is kept. Repeated rows stay
    separate rows, also where one id names several vectors. Other columns are not looked at. No rows give no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("v", F.when(usable("v"), F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))))  # no -0.0
    rows = settled(rows.withColumn("key", F.sha2(F.col("v").cast("string"), 256)))
    classes = rows.where("v is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    live = settled(classes.withColumn("cls", F.monotonically_increasing_id()))  # as written, so numbers stay
    tables, bits = layout(live.count(), threshold)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                c = codes(unit(np.stack(part["v"].to_numpy()).astype(np.float64)), tables, bits)
                yield pd.DataFrame({"cls": np.repeat(part["cls"].to_numpy(), tables), "dim": dim, "t": np.tile(np.arange(tables), len(part)), "code": c.ravel()})

    signed = settled(live.select("cls", "v").mapInPandas(sign, "cls long, dim int, t int, code long"))
    sizes = signed.groupBy("dim", "t", "code").agg(F.count("*").alias("m")).where("m > 1")
    placed = signed.join(sizes, ["dim", "t", "code"]).withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cls", "dim", "t", "code", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    shards = max(1, -(-placed.count() // (8 * block)))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("dim", "t", "code", "lo", "hi"), F.lit(shards)))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dim", "t", "code", "lo", "hi", "cls"])
        cell = pdf[["dim", "t", "code", "lo", "hi"]].to_numpy()
        cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
        cls, n, own, vs, out = pdf["cls"].to_numpy(), pdf["n"].to_numpy(), pdf["own"].to_numpy(), pdf["v"].to_numpy(), []
        for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            _, t, _, lo, hi = cell[a]
            x = unit(np.stack(vs[a:b]).astype(np.float64))
            gain, parent = link_cell(x, codes(x, tables, bits), n[a:b], own[a:b] != lo, lo == hi, t, threshold)
            k = np.flatnonzero((gain > 0) | (parent != np.arange(b - a)))
            out.append((cls[a:b][k], gain[k], cls[a:b][parent[k]]))
        return pd.DataFrame(dict(zip(("cls", "gain", "root"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    met = placed.join(live.select("cls", "n", "v"), "cls").groupBy("shard").applyInPandas(meet, "cls long, gain long, root long")
    found = settled(met.groupBy("cls", "root").agg(F.sum("gain").alias("gain")))
    gains = found.groupBy("cls").agg(F.sum("gain").alias("gain"))
    parts = connected_components(found.select("cls", "root"))
    joined = live.select("key", "cls", "least", "n").join(gains, "cls", "left").join(parts, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    joined = settled(joined.select("key", "component", "least", (F.col("n") - 1 + F.coalesce("gain", F.lit(0))).alias("links")))
    names = joined.groupBy("component").agg(F.min("least").alias("part"))
    named = spread_join(joined.select("key", "component", "links"), names, "component", ["key"]).select("key", "links", "part")
    out = spread_join(rows.select("id", "key"), named, "key", ["id"])
    part = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("part"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
