"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import settled
from docloom.llm.neardup_vectors import usable

SAMPLE = 20_000  # vectors from which the driver builds the tree
BRANCHES = 8
LEAF = 400  # vectors that a leaf should hold
RECALL = 0.97  # of the sample's own nearest that the sample's calibration queries must find
CHECKS = 256  # calibration queries
SHARD = 20_000  # vectors of a leaf that one task holds
QUERIES = 5_000  # queries that one task has for a shard
SEED = 11


class Tree:
    """Centres of a k-means hierarchy over vectors lifted so that the nearest has the largest inner product.

    A vector x gets the component sqrt(M^2 - |x|^2), a query 0: then |q - x|^2 = |q|^2 + M^2 - 2 q.x.
    """

    def __init__(self, sample: np.ndarray, norm: float, leaf: int):
        self.norm, rng = norm, np.random.default_rng(SEED)
        self.centres: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(self.lift(sample), leaf, rng)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1))
        return np.column_stack([x, np.sqrt(rest)])

    def _grow(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        node = len(self.children)
        self.children.append(np.empty(0, np.int64))
        self.centres.append(np.empty((0, x.shape[1])))
        self.leaf.append(-1)
        parts, centres = cluster(x, BRANCHES, rng) if len(x) > leaf else ([], None)
        if len(parts) < 2:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            return node
        self.centres[node] = centres
        self.children[node] = np.array([self._grow(p, leaf, rng) for p in parts])
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child all the way down."""
        x, out = self.lift(x), np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, idx = todo.pop()
            if self.leaf[node] >= 0:
                out[idx] = self.leaf[node]
                continue
            c = self.centres[node]
            near = ((c * c).sum(axis=1) - 2 * x[idx] @ c.T).argmin(axis=1)
            todo += [(child, idx[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves by best-bin-first traversal: always on from the open node whose centre is nearest."""
        q = np.append(query, 0.0)
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            d = ((self.centres[node] - q) ** 2).sum(axis=1)
            for k, child in zip(d, self.children[node], strict=True):
                heapq.heappush(heap, (float(k), int(child)))


def cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """Lloyd's k-means; empty clusters are left out, so vectors that are all alike give one part."""
    c = x[rng.choice(len(x), k, replace=False)] if len(x) > k else x
    for _ in range(12):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        held = np.unique(near)
        c = np.array([x[near == j].mean(axis=0) for j in held])
    near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
    held = np.unique(near)
    return [x[near == j] for j in held], c[held]


def calibrated_visits(tree: Tree, sample: np.ndarray, k: int, recall: float, checks: int) -> int:
    """Leaves to visit, widened until the sample's own queries find that share of their k nearest in the sample."""
    queries = sample[:: max(1, len(sample) // checks)][:checks]
    at = tree.place(sample)
    order = [list(tree.best_bins(q)) for q in queries]
    nearest = [np.argpartition(-(sample @ q), min(k, len(sample) - 1))[: k + 1] for q in queries]
    needed = np.concatenate([np.argsort(o)[at[n]] for o, n in zip((np.array(o) for o in order), nearest, strict=True)])
    return int(np.quantile(needed, recall, method="higher")) + 1


def nearest(q: np.ndarray, q_row: int, x: np.ndarray, x_id: np.ndarray, x_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, score) of the k best of a query but its own row; ties to smaller ids."""
    s = np.where(x_row == q_row, -np.inf, x @ q)
    idx = np.flatnonzero(s > -np.inf)
    if len(idx) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        idx = np.flatnonzero(s >= least - 1e-9 * (1 + abs(least)))
    exact = (x[idx] * q).sum(axis=1)  # one order of summing, so that equal vectors score alike
    best = np.lexsort((x_id[idx], -exact))[:k]
    return x_id[idx][best], exact[best]


def shards_of(held: dict[int, int], size: int) -> tuple[dict[int, int], dict[int, int]]:
    """(shard of each leaf, parts of each shard): neighbouring leaves together up to ``size`` vectors, larger ones alone in parts."""
    shard, parts, at, filled = {}, {}, -1, size
    for leaf in sorted(held):
        if filled + held[leaf] > size:
            at, filled = at + 1, 0
        shard[leaf], filled = at, filled + held[leaf]
        parts[at] = -(-filled // size)
    return shard, parts


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest among all other rows, by inner product in doubles.

    The tree comes from a bounded sample in hash order; every vector is dealt to its leaf, and a query goes to as many
    best bins as calibration on the sample asks for, and on until they hold k others at least. Neighbouring leaves share
    a shard, which returns k rows for each query; a larger leaf is cut into parts, so one with a third of all vectors is
    many tasks' work, and a shard that many queries ask for is asked in parts too. Vectors null, zero, with null or
    non-finite components, without an id, or of another length than most take no part. Rows that
    repeat an id are separate candidates and separate queries; only a query's own row is not its neighbour. Fewer candidates than k: all of them. Other columns are
    not looked at, but for what ``is_query`` reads. No rows give no rows. The tree has no more leaves than the sample has
    vectors: past ``sample`` times ``leaf`` rows leaves grow with the table, and a larger ``sample`` is called for.
    """
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim is None:
        return empty
    rows = rows.where(F.size("v") == dim[0])
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    n, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    drawn = np.array([r[0] for r in rows.orderBy(F.xxhash64("id", "v"), "id").select("v").limit(sample).collect()])
    tree = Tree(drawn, norm, max(1, round(leaf * len(drawn) / n)))
    visits = calibrated_visits(tree, drawn, k, recall, CHECKS)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "id": pdf["id"], "v": pdf["v"], "q": pdf["q"], "leaf": tree.place(np.stack(pdf["v"].to_numpy()))})

    dealt = settled(rows.mapInPandas(deal, "row long, id long, v array<double>, q boolean, leaf int"))
    held = dict(dealt.groupBy("leaf").count().collect())  # as many rows as the tree has leaves
    shard, parts = shards_of(held, SHARD)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q_row, q_id, v in zip(pdf["row"], pdf["id"], pdf["v"], strict=True):
                seen, others, bins = 0, 0, {}
                for b in tree.best_bins(v):
                    if seen >= visits and others > k:
                        break
                    seen, others = seen + 1, others + held.get(b, 0)
                    if b in shard:
                        bins.setdefault(shard[b], []).append(b)
                out += [(q_row, q_id, v, s, sorted(leaves)) for s, leaves in bins.items()]
            yield pd.DataFrame(out, columns=["q_row", "q_id", "q_v", "shard", "leaves"])

    spark = vectors.sparkSession
    queries = settled(dealt.where("q").select("row", "id", "v").mapInPandas(route, "q_row long, q_id long, q_v array<double>, shard int, leaves array<int>"))
    asked = dict(queries.groupBy("shard").count().collect())
    cuts = spark.createDataFrame([(s, parts[s], -(-asked.get(s, 0) // QUERIES)) for s in parts], "shard int, parts int, qparts int")
    homes = spark.createDataFrame(list(shard.items()), "leaf int, shard int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = dealt.join(F.broadcast(homes), "leaf").join(F.broadcast(cuts.where("qparts > 0")), "shard")
    candidates = placed.select("row", "id", "v", "leaf", "shard", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), every("qparts").alias("qpart"))
    queries = queries.join(F.broadcast(cuts), "shard").select("q_row", "q_id", "q_v", "leaves", "shard", F.pmod(F.xxhash64("q_row"), F.col("qparts")).cast("int").alias("qpart"), every("parts").alias("part"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q_row": [], "query_id": [], "vec_id": [], "score": []})
        right = right.sort_values("leaf")
        x, x_id, x_row, leaf = np.stack(right["v"].to_numpy()), *(right[c].to_numpy() for c in ("id", "row", "leaf"))
        here, begin = np.unique(leaf, return_index=True)
        rows_of = dict(zip(here.tolist(), map(np.arange, begin, [*begin[1:], len(leaf)]), strict=True))
        out = []
        for q_row, q_id, q, leaves in zip(left["q_row"], left["q_id"], left["q_v"], left["leaves"], strict=True):
            idx = np.concatenate([np.empty(0, np.int64), *(rows_of[b] for b in leaves.tolist() if b in rows_of)])
            ids, scores = nearest(np.asarray(q), q_row, x[idx], x_id[idx], x_row[idx], k)
            out.append((np.full(len(ids), q_row), np.full(len(ids), q_id), ids, scores))
        return pd.DataFrame(dict(zip(("q_row", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    keys = ["shard", "part", "qpart"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(meet, "q_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
