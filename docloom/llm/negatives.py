"""Hard negatives: vantage-point trees over norm-augmented vectors; score windows are distance annuli, walked from the inside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import settled, spread_join

SAMPLE = 8192  # vectors from which the driver builds the upper tree
SHARD = 8192  # vectors that one task holds
ASKED = 4096  # requests that one task has for a shard
LEAF = 128  # vectors of a leaf inside a shard
NEAR = 2  # shards that a request visits first, for a bound that rules out most others
ROUTED = "request long, label long, v array<double>, lo double, hi double, bound double, shard int"
FOUND = "request long, uid long, id long, score double"


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1) + v @ v - 2 * (x @ v)))


class VpTree:
    """A vantage-point tree whose leaves hold ``leaf`` points at most, copies of one point in leaves of their own.

    ``tight`` trees know between which distances from a vantage point the points on each side lie; others, built from a
    sample, know the radius alone and so hold for all points that ``place`` puts there.
    """

    def __init__(self, x: np.ndarray, leaf: int, tight: bool):
        self.nodes: list[tuple | None] = []  # vantage point, radius, (least, most, child) inside and outside; None for a leaf
        self.leaves: dict[int, np.ndarray] = {}
        self._grow(x, np.arange(len(x)), leaf, tight)
        self.parts: list[tuple[int, np.ndarray]] = []  # leaves cut to size: node, points
        for node, at in self.leaves.items():
            self.parts += [(node, at[k : k + leaf]) for k in range(0, max(1, len(at)), leaf)] if tight else [(node, at)]
        self.of = {node: k for k, node in enumerate(self.leaves)}

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf: int, tight: bool) -> int:
        node = len(self.nodes)
        self.nodes.append(None)
        split = None
        if len(at) > leaf:
            own = x[at]
            vantage = own[distances(own, own.mean(axis=0)).argmax()]
            d = distances(own, vantage)
            mu = float(np.median(d))
            split = (d <= mu) if (d > mu).any() else (d < mu)
            mu = float(d[split].max()) if split.any() else mu
        if split is None or split.all() or not split.any():
            self.leaves[node] = at
            return node
        sides = [(float(d[s].min()), float(d[s].max())) for s in (split, ~split)] if tight else [(0.0, mu), (mu, np.inf)]
        self.nodes[node] = (vantage, mu, *((*side, self._grow(x, at[s], leaf, tight)) for side, s in zip(sides, (split, ~split), strict=True)))
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        """The number of each point's leaf."""
        out, todo = np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if self.nodes[node] is None:
                out[at] = self.of[node]
                continue
            vantage, mu, inside, outside = self.nodes[node]
            near = distances(x[at], vantage) <= mu
            todo += [(inside[2], at[near]), (outside[2], at[~near])]
        return out

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible distance of each query to the points of each part, by the triangle inequality."""
        least, most = np.empty((len(q), len(self.parts))), np.empty((len(q), len(self.parts)))
        cols: dict[int, list[int]] = {}
        for k, (node, _) in enumerate(self.parts):
            cols.setdefault(node, []).append(k)
        todo = [(0, np.zeros(len(q)), np.full(len(q), np.inf))]
        while todo:
            node, lo, hi = todo.pop()
            if self.nodes[node] is None:
                least[:, cols[node]], most[:, cols[node]] = lo[:, None], hi[:, None]
                continue
            vantage, _, *sides = self.nodes[node]
            d = distances(q, vantage)
            todo += [(child, np.maximum(lo, np.maximum(d - b, a - d)), np.minimum(hi, d + b)) for a, b, child in sides]
        return least, most


class Space:
    """Vectors x with sqrt(M^2 - |x|^2) as one more component and queries q with 0: |q - x|^2 = |q|^2 + M^2 - 2 q.x."""

    def __init__(self, norm: float):
        self.norm = norm
        self.slack = 1e-6 * norm  # more than rounding can change a distance

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))])

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a point has that score to a query."""
        return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1) + self.norm**2 - 2 * score))


def annuli(space: Space, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least distance, infinite where the annulus of scores lo to hi, in hundredths, passes a part by; outer radius)."""
    inner, outer = space.radius(q, hi / 100) - space.slack, space.radius(q, lo / 100) + space.slack
    return np.where((most < inner[:, None]) | (least > outer[:, None]), np.inf, least), outer


def nearest_first(space: Space, x: np.ndarray, label: np.ndarray, q: np.ndarray, own: np.ndarray, same: bool, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in x, score) of the k best for each query among rows of its label, or of others; -1 where there are fewer.

    Each query goes to the parts that its annulus touches, nearest first, until the next one is farther than its k-th
    best; all queries take their n-th part together. Equal scores go by position, so x comes in order of ids.
    """
    tree = VpTree(space.lift(x), LEAF, tight=True)
    least, outer = annuli(space, q, lo, hi, *tree.bounds(np.column_stack([q, np.zeros(len(q))])))
    order = np.argsort(least, axis=1, kind="stable")
    score, at = np.full((len(q), k), -np.inf), np.full((len(q), k), len(x))
    active = np.arange(len(q))
    for turn in range(least.shape[1]):
        part = order[active, turn]
        go = (d := least[active, part]) <= outer[active]
        go &= d < np.inf
        active, part = active[go], part[go]
        if not len(active):
            break
        for b in np.unique(part):
            r, idx = active[part == b], tree.parts[b][1]
            s = q[r] @ x[idx].T
            ok = ((own[r][:, None] == label[idx]) == same) & (100 * s >= lo[r][:, None]) & (100 * s <= hi[r][:, None])
            some = ok.any(axis=1)
            r, s = r[some], np.where(ok, s, -np.inf)[some]
            all_s, all_at = np.hstack([score[r], s]), np.hstack([at[r], np.broadcast_to(idx, s.shape)])
            best = np.lexsort((all_at, -all_s), axis=1)[:, :k]
            score[r], at[r] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_at, best, 1)
            full = r[score[r, -1] > -np.inf]
            outer[full] = space.radius(q[full], score[full, -1]) + space.slack
    return np.where(score > -np.inf, at, -1), score


class Index:
    """All candidate rows (uid, id, label, v), each dealt to a leaf of the upper tree; leaves are shards, large ones in parts.

    The upper tree comes from a sample in hash order and is bounded by it; how many rows a leaf has is counted over all.
    """

    def __init__(self, rows: DataFrame, sample: int, shard: int):
        n, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
        drawn = np.array([r[0] for r in rows.orderBy(F.xxhash64("id", "v"), "id").select("v").limit(sample).collect()])
        self.space = Space(float(norm))
        self.tree = tree = VpTree(self.space.lift(drawn), max(1, round(shard * len(drawn) / n)), tight=False)
        space, self.spark = self.space, rows.sparkSession

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(shard=tree.place(space.lift(np.stack(pdf["v"].to_numpy()))))

        self.rows = settled(rows.select("uid", "id", "label", "v").mapInPandas(deal, "uid long, id long, label long, v array<double>, shard int"))
        self.parts = {s: -(-m // shard) for s, m in self.rows.groupBy("shard").count().collect()}  # a row for each leaf

    def route(self, requests: DataFrame, near: bool) -> DataFrame:
        """Requests with each shard that their annulus may touch: the first NEAR of them, or all others within the bound."""
        tree, space = self.tree, self.space

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k in range(0, len(batch), 1000):
                    pdf = batch.iloc[k : k + 1000]
                    q = np.stack(pdf["v"].to_numpy())
                    seen = tree.bounds(np.column_stack([q, np.zeros(len(q))]))
                    lo, hi, bound = (pdf[c].to_numpy() for c in ("lo", "hi", "bound"))
                    least, _ = annuli(space, q, lo, hi, *seen)
                    turn = np.argsort(np.argsort(least, axis=1, kind="stable"), axis=1)
                    first = (turn < NEAR) & (least < np.inf)
                    taken = first if near else ~first & (annuli(space, q, np.maximum(lo, bound), hi, *seen)[0] < np.inf)
                    row, shard = np.nonzero(taken)
                    yield pdf.iloc[row].assign(shard=shard.astype(np.int32))

        return requests.mapInPandas(run, ROUTED)

    def ask(self, requests: DataFrame, same: bool, k: int, near: bool) -> DataFrame:
        """(request, uid, id, score): up to k rows for each request and part of a shard that it visits."""
        asked = settled(self.route(requests, near))
        many = {s: -(-m // ASKED) for s, m in asked.groupBy("shard").count().collect()}
        cuts = self.spark.createDataFrame([(s, self.parts.get(s, 0), m) for s, m in many.items()], "shard int, parts int, qparts int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        rows = self.rows.join(F.broadcast(cuts), "shard").select("uid", "id", "label", "v", "shard", salt("uid", "parts").alias("part"), every("qparts").alias("qpart"))
        asked = asked.join(F.broadcast(cuts.where("parts > 0")), "shard").select("request", "label", "v", "lo", "hi", "bound", "shard", every("parts").alias("part"), salt("request", "qparts").alias("qpart"))
        space = self.space

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"request": [], "uid": [], "id": [], "score": []})
            right = right.sort_values(["id", "uid"])
            lo = np.maximum(left["lo"].to_numpy(), left["bound"].to_numpy())
            at, score = nearest_first(space, np.stack(right["v"].to_numpy()), right["label"].to_numpy(), np.stack(left["v"].to_numpy()), left["label"].to_numpy(), same, lo, left["hi"].to_numpy(), k)
            r, c = np.nonzero(at >= 0)
            found = right.iloc[at[r, c]]
            return pd.DataFrame({"request": left["request"].to_numpy()[r], "uid": found["uid"].to_numpy(), "id": found["id"].to_numpy(), "score": score[r, c]})

        keys = ["shard", "part", "qpart"]
        return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(meet, FOUND)

    def first_within(self, requests: DataFrame, same: bool, k: int) -> DataFrame:
        """(request, rank, uid, id, score): the k best rows of a request's label, or of others, with scores from lo to hi hundredths.

        ``requests`` are (request, label, v, lo, hi). The nearest shards come first; the k-th best there bounds what other shards
        are visited and what they return. Equal scores go by id, then row.
        """
        order = Window.partitionBy("request").orderBy(F.desc("score"), "id", "uid")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        asked = requests.withColumn("bound", F.lit(float("-inf"))).select("request", "label", "v", "lo", "hi", "bound")
        near = settled(ranked(self.ask(asked, same, k, near=True)))
        bound = near.where(F.col("rank") == k).select("request", (100 * F.col("score")).alias("bound"))
        asked = asked.drop("bound").join(bound, "request", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        far = self.ask(asked.select("request", "label", "v", "lo", "hi", "bound"), same, k, near=False)
        return ranked(near.drop("rank").unionByName(far))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor row and positive.

    An anchor's positives are its first ``positives`` other rows of the same label by inner product, ties by smaller id; its
    negatives the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's. All
    are found exactly: nothing is left out but what the triangle inequality rules out. Scores are doubles, exact where
    components are integers and sums stay below 2^53. A positive of a negative score has no negatives.

    Rows with null ids, labels or vectors, null or non-finite components, or another length than most take no part. Rows
    that repeat an id are separate rows, anchors if they are; none is its own positive. Of rows with equal label and vector
    only the first ``positives`` + 1 by id can be among a result's, so the others are asked for but not searched, and equal
    anchors ask once: copies cost no more than their rows. Other columns are not looked at, but for what ``is_anchor`` reads.
    No rows give no rows.
    """
    v = F.transform(F.col(vector_col), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))  # no -0.0
    finite = (F.size(vector_col) > 0) & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(finite & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double")
    rows = settled(rows.where(F.size("v") == dim[0]).withColumn("uid", F.monotonically_increasing_id()).withColumn("key", F.sha2(F.concat_ws("|", "label", F.col("v").cast("string")), 256)))
    few = positives + 1
    first = lambda *by: F.row_number().over(Window.partitionBy("key", *by).orderBy("id", "uid"))
    held = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(16))).withColumn("n", first("salt")).where(F.col("n") <= few).withColumn("n", first()).where(F.col("n") <= few)
    index = Index(settled(held.select("uid", "id", "label", "v")), sample, shard)
    asked = settled(rows.where("anchor").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v")).withColumn("class", F.monotonically_increasing_id()))
    unbounded = {"lo": F.lit(float("-inf")), "hi": F.lit(float("inf"))}
    near = settled(index.first_within(asked.select(F.col("class").alias("request"), "label", "v").withColumns(unbounded), True, few))
    windows = near.where("score >= 0").select(F.col("request").alias("class"), F.col("score").alias("ps")).distinct()
    windows = settled(windows.join(asked.drop("key"), "class").withColumn("request", F.monotonically_increasing_id()).withColumns({"lo": low * F.col("ps"), "hi": high * F.col("ps")}))
    far = index.first_within(windows.select("request", "label", "v", "lo", "hi"), False, negatives)
    far = far.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("negative"), "score"))).alias("far"))
    told = windows.select("request", "class", "ps").join(far, "request").drop("request")
    pairs = near.withColumnRenamed("request", "class").join(told.withColumnRenamed("ps", "score"), ["class", "score"], "left")
    pairs = pairs.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("rank", "uid", "id", "score", "far"))).alias("near"))
    answers = asked.select("key", "class").join(pairs, "class").drop("class")
    out = spread_join(rows.where("anchor").select("key", "uid", "id"), answers, "key", ["uid"], "inner")
    others = F.slice(F.filter("near", lambda x: x["uid"] != F.col("uid")), 1, positives)
    out = out.select(F.col("id").alias("anchor_id"), F.explode(others).alias("p")).select("anchor_id", "p", F.explode("p.far").alias("n"))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("n.rank").alias("rank"), F.col("n.negative").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))
