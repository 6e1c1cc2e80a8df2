"""Toxicity by compression distance: windows compressed with a toxic and with an ordinary zstandard dictionary."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from docloom.llm.common import private

THRESHOLD = 0.3
TRAIN_DOCS = 3000  # labelled documents of each class that training reads at most
TRAIN_BYTES = 8_000_000  # and their bytes
TEXT_BYTES = 64_000  # of a text that training reads at most, in STRETCHES evenly spaced stretches
STRETCHES = 16
WINDOW = 64  # bytes; zstandard leaves literals of so short inputs as they are, so lengths differ by matches alone
DICT_BYTES = 7600  # of each part of a dictionary
GRAM = 6
NEW_SHARE = 0.5  # of a run's grams that must not be in the dictionary yet
SURE = 7.0  # standard errors by which a class must lead in documents that hold a gram


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of ids that training never sees; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def stretches(body: Column, most: int) -> Column:
    """A text as training reads it: whole, or ``most`` bytes of it in stretches from its begin to its end."""
    size, n = most // STRETCHES, F.length(body)
    begin = lambda k: (1 + k * (n - size) / (STRETCHES - 1)).cast("int")
    return F.when(n <= most, body).otherwise(F.concat(*(F.substring(body, begin(k), F.lit(size)) for k in range(STRETCHES))))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, docs_a_class: int, bytes_a_class: int, bytes_a_text: int = TEXT_BYTES) -> tuple[list[tuple[bytes, int]], float]:
    """A bounded sample of labelled texts outside the held-out quarter, in hash order, and the toxic share of all labels there.

    Nulls count as no label. A text of more than ``bytes_a_text`` is read in stretches of that many bytes together, so no
    text, however long, keeps others out: each class has ``bytes_a_class / bytes_a_text`` texts at least, if there are as many.
    """
    named = labels.where(~held_out(id_col)).where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label")).where("_label in (0, 1)")
    hashed = named.withColumn("_order", F.xxhash64(F.col(id_col).cast("long")))
    few = [hashed.where(F.col("_label") == k).orderBy("_order", id_col).limit(docs_a_class) for k in (0, 1)]
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_body")).withColumn("_text", F.xxhash64("_body"))
    # lengths first, so that only texts within the limits are ever moved; rows that repeat an id and text count once
    order = ["_order", id_col, "_text"]
    sizes = texts.select(id_col, "_text", F.least(F.length("_body"), F.lit(bytes_a_text)).alias("_bytes")).join(F.broadcast(few[0].unionByName(few[1])), id_col).distinct()
    sizes = [sizes.where(F.col("_label") == k).orderBy(*order).limit(docs_a_class) for k in (0, 1)]
    until = F.sum("_bytes").over(Window.partitionBy("_label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    within = sizes[0].unionByName(sizes[1]).withColumn("_until", until).where(F.col("_until") <= bytes_a_class)
    rows = texts.join(F.broadcast(within.select(id_col, "_text", "_label", "_order")), [id_col, "_text"]).withColumn("_body", stretches(F.col("_body"), bytes_a_text)).dropDuplicates([id_col, "_text"]).select("_body", "_label", "_order", id_col)
    share = named.agg(F.avg("_label")).first()[0] or 0.0
    return [(bytes(r[0]).lower(), r[1]) for r in sorted(rows.collect(), key=lambda r: (r[2], r[3], bytes(r[0])))], share


def grams(text: bytes) -> np.ndarray:
    v = np.frombuffer(text, np.uint8)
    n = max(0, len(v) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(8)) | v[k : n + k]
    return h


def document_counts(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(grams(d)) for d in docs] or [np.empty(0, np.uint64)]
    return np.unique(np.concatenate(parts), return_counts=True)


def look_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, i, -1)


def common_part(docs: list[bytes], size: int, piece: int = 16) -> bytes:
    """Dictionary text by segment cover: from each stretch of the texts the piece whose grams most documents hold."""
    table, count = document_counts(docs)
    worth = np.append(count.astype(np.float64), 0.0)
    text = b" ".join(docs)
    ids = look_up(table, grams(text))
    step, width, found = max(piece, len(ids) // max(1, size // piece)), piece - GRAM + 1, []
    for at in range(0, len(ids) - piece, step):
        part = ids[at : at + step]
        sums = np.concatenate([[0.0], np.cumsum(worth[part])])
        if len(sums) > width:
            gain = sums[width:] - sums[:-width]
            k = int(gain.argmax())
            if gain[k] > 0:
                found.append((gain[k], text[at + k : at + k + piece]))
                worth[part[k : k + width]] = 0.0
    return b"".join(x for _, x in sorted(found))[-size:]


def own_part(docs: list[bytes], others: list[bytes], size: int) -> bytes:
    """Dictionary text of a class: the longest runs whose grams are all surely commoner in its documents; most used last."""
    (table, count), (other, there) = document_counts(docs), document_counts(others)
    at = look_up(other, table)
    count2 = np.where(at >= 0, np.append(there, 0)[at], 0)
    n, m = max(1, len(docs)), max(1, len(others))
    p = (count + count2 + 1) / (n + m + 2)
    sure = (count / n - count2 / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m)) >= SURE
    table, runs = table[sure], Counter()
    for text in docs:
        edge = np.flatnonzero(np.diff((look_up(table, grams(text)) >= 0).astype(np.int8), prepend=0, append=0))
        runs.update({text[a : b + GRAM - 1] for a, b in zip(edge[::2], edge[1::2], strict=True)})
    kept: list[bytes] = []
    seen: set[int] = set()
    for run, n in sorted(runs.items(), key=lambda x: (-x[1], x[0])):
        held = set(grams(run).tolist())
        if n >= 3 and len(held - seen) > NEW_SHARE * len(held) and sum(map(len, kept)) + len(run) <= size:
            kept.append(run)
            seen |= held
    return b"".join(reversed(kept))


@dataclass(frozen=True)
class Model:
    """Two dictionaries of one length and the weights that turn length differences into a probability."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    prior: float = 0.0


def compressor(dictionary: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=15, hash_log=15, search_log=4, min_match=6, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_dict_id=0, write_checksum=0)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data).compress


def features(text: bytes, toxic, ordinary) -> tuple[float, ...]:
    """Of the windows' gains (bytes that the toxic dictionary saves over the ordinary): mean, mean square, share, most."""
    text = text.lower()
    parts = [text[k : k + WINDOW] for k in range(0, len(text), WINDOW)] or [b""]
    gain = np.array([len(ordinary(x)) - len(toxic(x)) for x in parts], dtype=np.float64)
    over = np.maximum(gain - 1, 0)
    return 1.0, float(gain.mean()), float(np.log1p((over * over).mean())), float((gain >= 3).mean()), float(gain.max()) / 10


def fit_weights(x: np.ndarray, y: np.ndarray, toxic_share: float, ridge: float = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton steps; rows count so that the toxic ones have their share of all labelled rows."""
    c = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = x.T @ (x * (c * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (c * (y - p)) - ridge * w)
    return tuple(map(float, w))


def train(rows: list[tuple[bytes, int]], toxic_share: float) -> Model:
    """Dictionaries from two thirds of the rows, weights from the rest; with one class only, its share is the score."""
    build, rest = [r for k, r in enumerate(rows) if k % 3], rows[::3]
    toxic, plain = ([t for t, y in build if y == k] for k in (1, 0))
    if not toxic or not plain or len({y for _, y in rest}) < 2:
        return Model(b"", b"", (), toxic_share)
    base = common_part(plain, DICT_BYTES)
    parts = own_part(toxic, plain, DICT_BYTES), own_part(plain, toxic, DICT_BYTES)
    size = max(map(len, parts))
    model = Model(base + parts[0].rjust(size), base + parts[1].rjust(size), ())
    tools = compressor(model.toxic), compressor(model.ordinary)
    x = np.array([features(t, *tools) for t, _ in rest])
    return Model(model.toxic, model.ordinary, fit_weights(x, np.array([y for _, y in rest], dtype=np.float64), toxic_share))


def score(text_col: str, model: Model) -> Column:
    """Probability that a whole text is toxic; null counts as empty."""

    @F.pandas_udf(DoubleType())
    def run(bodies: pd.Series) -> pd.Series:
        if not model.weights:
            return pd.Series(np.full(len(bodies), model.prior))
        tools, w = (compressor(model.toxic), compressor(model.ordinary)), np.array(model.weights)
        x = np.array([features(t, *tools) for t in bodies]).reshape(-1, len(w))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return run(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_a_class: int = TRAIN_DOCS, bytes_a_class: int = TRAIN_BYTES) -> Model:
    return train(*training_rows(docs, labels, id_col, text_col, label_col, docs_a_class, bytes_a_class))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of each row. Null and empty texts get a score too; repeated rows stay."""
    scored = docs.select(id_col, held_out(id_col).alias("held_out"), score(text_col, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows below the threshold, with their columns, whatever their names.

    Null and empty texts score as texts without any window that tells; rows that are alike score alike, so repeated rows
    stay or go together. Ids are not looked at. No rows give no rows.
    """
    (toxic,) = private(docs, "toxicity")
    return docs.withColumn(toxic, score(text_col, model)).where(F.col(toxic) < threshold).drop(toxic)
