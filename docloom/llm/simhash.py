"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints, exact within three differing bits."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import connected_components, merge_labels, settled, spread_join

SEED = 42
MAX_BITS = 3
SAMPLE = 8192  # fingerprints from which the driver builds the trees
LEAF = 1500  # fingerprints that a leaf should be home to


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 values of word shingles, as a signed 64-bit integer; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in map(b" ".join, grams)], dtype="<u8").view(np.uint8).reshape(-1, 8)
    votes = sum(np.unpackbits(h[k : k + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(h), 65536))
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp) of each document; null texts count as empty. Bytes split as the C locale does: space and \\t to \\r."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fp": np.array([fingerprint(t, shingle) for t in pdf["body"]], dtype=np.int64)})

    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).mapInPandas(run, "id long, fp long")


def grow_tree(points: np.ndarray, leaf: int) -> list[tuple[int, int, int, int]]:
    """A vantage-point tree: nodes (vantage point, radius, inside child, outside child); leaves have radius -1."""
    nodes: list[tuple[int, int, int, int]] = []
    todo = [(points, -1, 0)]
    while todo:
        part, up, side = todo.pop()
        if up >= 0:
            x = list(nodes[up])
            x[2 + side] = len(nodes)
            nodes[up] = tuple(x)
        split = None
        if len(part) > leaf:
            best = -1
            for vantage in part[:: max(1, len(part) // 8)][:8]:  # of a few, the one that splits most evenly
                d = np.bitwise_count(part ^ vantage)
                mu = int(np.median(d))
                for m in (mu, mu - 1):
                    inside = int((d <= m).sum())
                    if min(inside, len(part) - inside) > best:
                        best, split = min(inside, len(part) - inside), (int(vantage), m, d <= m)
            split = split if best > 0 else None
        if split is None:
            nodes.append((0, -1, 0, 0))
            continue
        todo += [(part[~split[2]], len(nodes), 1), (part[split[2]], len(nodes), 0)]
        nodes.append((split[0], split[1], 0, 0))
    return nodes


def visit(nodes: list[tuple[int, int, int, int]], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, point index) of every leaf that a ball of that radius around a point may reach, by the triangle bound."""
    leaves, found = [], []
    todo = [(0, np.arange(len(points)))]
    while todo:
        k, idx = todo.pop()
        vantage, mu, inside, outside = nodes[k]
        if not len(idx):
            continue
        if mu < 0:
            leaves.append(np.full(len(idx), k, dtype=np.int32))
            found.append(idx)
            continue
        d = np.bitwise_count(points[idx] ^ np.uint64(vantage)).astype(np.int16)
        todo += [(inside, idx[d - radius <= mu]), (outside, idx[d + radius > mu])]
    return (np.concatenate(leaves), np.concatenate(found)) if found else (np.empty(0, np.int32), np.empty(0, np.int64))


def link_shard(home: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, root) that join all points of a leaf within max_bits of a point at home there; blocks bound the memory."""
    parent = np.arange(len(fp))
    own = np.flatnonzero(home)
    for k in range(0, len(fp), 512):
        for m in range(0, len(own), 4096):
            i, j = np.nonzero(np.bitwise_count(fp[k : k + 512, None] ^ fp[own[m : m + 4096]][None, :]) <= max_bits)
            parent = merge_labels(parent, i + k, own[j + m])
    far = np.flatnonzero(parent != np.arange(len(fp)))
    return far, parent[far]


HALVES = (lambda x: x & np.uint64(0xFFFFFFFF), lambda x: x >> np.uint64(32), lambda x: x)  # and the whole fingerprint


def deal(fp: np.ndarray, home: np.ndarray, tree: list[tuple[int, int, int, int]], part: int, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, point index, home): the leaves that a ball around each point may reach; a point is at home in one of them at most."""
    x = HALVES[part](fp)
    at = np.empty(len(fp), np.int32)
    leaf, k = visit(tree, x, 0)
    at[k] = leaf
    leaf, k = visit(tree, x, max_bits if part == 2 else max_bits // 2)
    return leaf, k, home[k] & (at[k] == leaf)


def leaf_sizes(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("own"))


def split_leaves(dealt: DataFrame, full: DataFrame, max_bits: int, leaf: int, sample: int) -> DataFrame:
    """The points of over-full leaves ``full`` (shard, n, own), dealt to the leaves of trees of their own.

    Each leaf's tree grows from a hashed sample of the points at home in it; a leaf that its half hardly tells apart gets a
    tree over whole fingerprints. Points of a leaf are split by salts, and each salt gets the leaf's tree.
    """
    salts = F.ceil(F.col("n") / F.lit(100_000)).cast("long")
    held = spread_join(dealt, full.select("shard", "own", salts.alias("salts")), "shard", ["fp"], "inner", full)
    held = held.withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")))
    drawn = held.where("home").where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(sample)) / F.col("own")) * (1 << 30))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        points, own, t = pdf["fp"].to_numpy().view(np.uint64), int(pdf["own"].iloc[0]), int(pdf["shard"].iloc[0].split(".")[0])
        size = max(1, round(leaf * len(points) / own))
        tree = grow_tree(HALVES[t](points), size)
        if t < 2 and np.bincount(visit(tree, HALVES[t](points), 0)[0]).max() > max(2 * size, len(points) // 4):
            t, tree = 2, grow_tree(points, size)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "salts": pdf["salts"].iloc[:1], "part": t, "tree": [pickle.dumps(tree)]})

    trees = drawn.select("shard", "fp", "own", "salts").groupBy("shard").applyInPandas(grow, "shard string, salts long, part int, tree binary")
    trees = trees.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))

    def part_out(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or own.empty:
            return pdf[["shard", "rep", "fp", "home"]]
        t, up = int(own["part"].iloc[0]), pdf["shard"].iloc[0].split(".", 1)[1]
        found, k, home = deal(pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(), pickle.loads(own["tree"].iloc[0]), t, max_bits)
        return pd.DataFrame({"shard": [f"{t}.{up}.{x}" for x in found], "rep": pdf["rep"].to_numpy()[k], "fp": pdf["fp"].to_numpy()[k], "home": home})

    keys = ["shard", "salt"]
    return held.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(part_out, DEALT)


DEALT = "shard string, rep long, fp long, home boolean"


def dealt_fingerprints(reps: DataFrame, max_bits: int, leaf: int, sample: int) -> DataFrame:
    """(shard, rep, fp, home): the leaves that each fingerprint of ``reps`` visits, none with more than about 8 ``leaf`` at home.

    The first trees come from a bounded sample on the driver; leaves that are over-full for lack of sample are split again
    by trees of their own, grown where their points are, until none is left.
    """
    n = reps.count()
    drawn = np.array([r[0] for r in reps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(min(1.0, sample / 2 / max(n, 1)) * (1 << 30))).select("fp").limit(sample).collect()], dtype=np.int64).view(np.uint64)
    trees = [grow_tree(HALVES[t](drawn), max(1, round(leaf * len(drawn) / max(n, 1)))) for t in (0, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            for t, tree in enumerate(trees):
                found, k, home = deal(fp, np.ones(len(fp), bool), tree, t, max_bits)
                yield pd.DataFrame({"shard": [f"{t}.{x}" for x in found], "rep": pdf["rep"].to_numpy()[k], "fp": fp[k].view(np.int64), "home": home})

    dealt, done = reps.mapInPandas(run, DEALT), []
    if n <= leaf * len(trees[0]):  # leaves as the sample has them hold few
        return dealt
    before = None
    while True:
        dealt = settled(dealt)
        sizes = settled(leaf_sizes(dealt).where(F.col("own") > 8 * leaf))
        left = sizes.agg(F.count("*"), F.max("own")).first()
        if not left[0] or tuple(left) == before:  # the same again: fingerprints that no tree tells apart any further
            return reduce(DataFrame.unionByName, [*done, dealt])
        before = tuple(left)
        done.append(dealt.join(sizes.select("shard"), "shard", "left_anti"))
        dealt = split_leaves(dealt, sizes, max_bits, leaf, sample)


def near_fingerprints(reps: DataFrame, max_bits: int = MAX_BITS, leaf: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) between ids of ``reps`` (rep, fp distinct) that join all fingerprints within max_bits.

    Two fingerprints that differ in at most 2r+1 bits differ in at most r bits in one of their 32-bit halves. One tree
    for each half deals the fingerprints out to leaves; a fingerprint also visits each leaf that its ball of radius r
    overlaps, so each near pair meets in the home leaf of either. A leaf compares all 64 bits and returns a spanning
    forest, never all pairs. Leaves hold a bounded number of fingerprints at any size.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        rep = pdf["rep"].to_numpy()
        i, root = link_shard(pdf["home"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), max_bits)
        return pd.DataFrame({"a": rep[i], "b": rep[root]})

    return dealt_fingerprints(reps, max_bits, leaf or LEAF, sample).groupBy("shard").applyInPandas(meet, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fp (signed 64-bit), component_id (smallest id reachable by links, itself included).

    Null or empty texts have fingerprint 0 and link like any other. Points are fingerprints, whatever ids have them: rows
    without an id link others, and get their component's smallest id, null if none of its rows has one. Repeated rows
    stay repeated. Other columns are not looked at. No rows give no rows.
    """
    seen = settled(with_fingerprints(docs, id_col, text_col, shingle))
    points = settled(seen.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    parts = connected_components(near_fingerprints(points.select(F.col("fp").alias("rep"), "fp"), max_bits))
    placed = settled(points.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("part")))
    names = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = spread_join(placed.select("fp", "part"), names, "part", ["fp"]).select("fp", "component_id")
    return spread_join(seen, named, "fp", ["id"], counts=points).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their component.

    Rows with one id are one document, which goes if any of its texts has a smaller neighbour; if none has, all stay. Rows
    without an id have nothing to be told apart by and stay. Columns are kept, whatever their names. No rows give no rows.
    """
    marks = simhash_components(docs, id_col, text_col)
    gone = marks.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
