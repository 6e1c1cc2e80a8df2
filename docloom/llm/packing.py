"""Best-fit packing of token sequences: large items paired by greedy matching, smaller ones into the tightest gap."""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import private, settled

CAPACITY = 1024
END_ID = 2
WORDS_KEPT = 600_000  # words whose ids a Python worker remembers
LONG_WORD = 20_000  # characters of a word from which ``tokenizers`` encodes it: tiktoken overflows its stack at a million of white space

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class WordIds(dict):
    """Ids, as little-endian 32-bit bytes, of a word after ``lead``; encodes each word once, but long ones each time."""

    def __init__(self, encode, encode_long, lead: str):
        super().__init__()
        self.encode, self.encode_long, self.lead = encode, encode_long, lead

    def __missing__(self, word: str) -> bytes:
        if len(word) >= LONG_WORD:
            return array("I", self.encode_long(self.lead + word)).tobytes()
        ids = array("I", self.encode(self.lead + word)).tobytes()
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = ids
        return ids


def byte_bpe(path: str):
    """A byte-level BPE file of the ``tokenizers`` library, run by tiktoken: several times faster, and the same ids.

    Ids below the special ones are in merge order, so they serve as ranks. Texts that hold an added token's string don't
    come here whole. The file names its byte characters as all byte-level vocabularies do.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {x["content"] for x in model["added_tokens"]}
    ranks = {bytes(chars[c] for c in word): k for word, k in model["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def library_bpe(path: str):
    """The ``tokenizers`` library itself with its defaults, loaded at the first text."""
    found = []

    def encode(text: str) -> list[int]:
        if not found:
            from tokenizers import Tokenizer

            found.append(Tokenizer.from_file(path))
        return found[0].encode(text, add_special_tokens=False).ids

    return encode


class Encoder:
    """Texts to ids, as little-endian 32-bit bytes.

    The pattern starts a new token at a space between two characters that are no white space, and makes a line feed
    between two such characters a token of its own; so a text falls apart there without changing an id. The file's added
    tokens are matched in the text before the pattern, as the ``tokenizers`` library does; texts that hold one are left to it.
    """

    def __init__(self, path: str):
        encode, self.library = byte_bpe(path), library_bpe(path)
        self.first, self.next = WordIds(encode, self.library, ""), WordIds(encode, self.library, " ")
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]

    def words(self, words: list[str]) -> bytes:
        return self.first[words[0]] + b"".join(map(self.next.__getitem__, words[1:]))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.added):
            return array("I", self.library(text)).tobytes()
        if " ".join(text.split()) == text.replace("\n", " "):  # all white space is single spaces and line feeds, inside
            return self.first["\n"].join([self.words(line.split(" ")) for line in text.split("\n")])
        return self.words(_LONE_SPACE.split(text))


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, and ids if asked for) of each document's ids with the end id after them.

    Only documents of more than ``capacity`` ids are cut, into pieces of that length; the first takes what is over.
    A null or empty text is the end id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = Encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["body"], strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]).astype({"id": "Int64"})

    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("body")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, items, items a bin, first bin, offset) for so many items of each length.

    Items are interchangeable within a length, so the plan works on counts: its size and time depend on the capacity,
    not on the number of items. Items above a third of the capacity go two to a bin at most: the largest takes the
    largest partner that fits. Smaller ones, largest first, go to the smallest gap that takes them.
    """
    left = {n: c for n, c in counts.items() if c}
    rank, slots, bins = dict.fromkeys(left, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def put(length: int, items: int, each: int, first: int, offset: int) -> None:
        slots.append((length, rank[length], items, each, first, offset))
        rank[length] += items
        left[length] -= items

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in (b for b in large if b <= min(a, capacity - a)):
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                put(a, n, 1, bins, 0)
                put(b, n, 1, bins, a)
                leave(capacity - a - b, bins, n)
                bins += n
        if n := left[a]:
            put(a, n, 1, bins, 0)
            leave(capacity - a, bins, n)
            bins += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            at = bisect_left(order, a)
            if at == len(order):
                n = -(-left[a] // (capacity // a))
                leave(capacity, bins, n)
                bins += n
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            each = min(gap // a, left[a])
            full = min(n, left[a] // each)
            put(a, full * each, each, first, capacity - gap)
            if n > full:
                gaps[gap].append((first + full, n - full))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            leave(gap - each * a, first, full)
    return slots


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, rows_a_task: int = 200_000) -> DataFrame:
    """``pieces`` (with a column length, 1 to capacity) plus sequence_id and offset; all rows are placed.

    Ranks within a length are row numbers within (length, salt) plus the counts of the salts before. A length has as many
    salts as its rows ask for, so that one that many rows have is dealt out to many tasks at any size. The driver sees
    counts by length, ``capacity`` at most, and the plan is broadcast; both are bounded by the capacity. No rows give no
    rows. Rows alike in all ``keys`` are interchangeable. Columns named sequence_id and offset are replaced, others kept.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    salt, salts, row, count, before = private(pieces, "salt", "salts", "row", "count", "before")
    total = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    spread = spark.createDataFrame([(n, -(-c // rows_a_task)) for n, c in total.items()] or [(0, 1)], f"length long, {salts} long")
    slots = spark.createDataFrame(plan_bins(total, capacity) or [(0, 0, 0, 1, 0, 0)], "length long, rank long, items long, each long, bin long, at long")
    slot = private(pieces.withColumns({x: F.lit(0) for x in (salt, row, before)}), "slot")[0]
    slots = slots.select("length", F.struct("rank", "items", "each", "bin", "at").alias(slot))
    salted = pieces.join(F.broadcast(spread), "length").withColumn(salt, F.pmod(F.xxhash64(*keys), F.col(salts))).drop(salts)
    counts = settled(salted.groupBy("length", salt).agg(F.count("*").alias(count)))
    sums = counts.select("length", salt, (F.sum(count).over(Window.partitionBy("length").orderBy(salt)) - F.col(count)).alias(before))
    ranked = salted.withColumn(row, F.row_number().over(Window.partitionBy("length", salt).orderBy(*keys)) - 1).join(sums, ["length", salt])
    ranked = ranked.withColumn(row, F.col(row) + F.col(before)).alias("r")
    k = F.col(row) - F.col(slot)["rank"]
    placed = ranked.join(F.broadcast(slots).alias("s"), (F.col("r.length") == F.col("s.length")) & (k >= 0) & (k < F.col(slot)["items"]))
    own = [F.col(f"r.`{c}`") for c in pieces.columns]
    place = F.col(slot)["at"] + k % F.col(slot)["each"] * F.col("r.length")
    return placed.select(*own, (F.col(slot)["bin"] + F.floor(k / F.col(slot)["each"])).alias("sequence_id"), place.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents, as token_pieces() gives them, with their places in sequences of at most ``capacity`` ids.

    Null texts are empty; null ids are kept; repeated rows give repeated pieces, each with its place. Texts may be of any
    length. Other columns than the id and the text are not looked at. No rows give no rows.
    """
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids)
    return pack(settled(pieces), [id_col, "piece", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a sequence holds at most its capacity, so a group is small."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(F.flatten(parts).alias("ids"))
