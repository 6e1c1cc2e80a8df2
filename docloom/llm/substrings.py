"""Exact substring dedup: blockwise suffix sorting with a difference cover, one bucket of suffixes at a time.

Distinct texts lie in blocks. A text falls under the cover at the positions whose residue by 31 is in a perfect
difference set: for any two places of a string of 50 bytes some shift below 31 brings both under the cover, with 20 bytes
of the string or more to go. So a suffix can repeat only if one of the cover samples among its first 31 places occurs
again as a sample. Samples are counted first, by hashes, which can only let more through; suffixes near a sample that
occurs again go on. A suffix belongs to the bucket of the least hash of the 20-byte strings in its first 50 bytes.
Neighbours mostly share that, so a bucket gets stretches of text, and a byte travels about four times at most.

A bucket is sorted by itself: by the suffixes' first 32 bytes, and longer ties by the ranks of the bucket's own cover
samples, which are sorted beforehand: two tied suffixes are compared at the shift that brings both under the cover, where
their ranks tell 20 bytes at once, and what is left of 50 bytes is compared as it is. No decision rests on a hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import settled, spread_join

LENGTH = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # a perfect difference set: each residue but 0 is one difference of two members
SAMPLE = LENGTH - PERIOD + 1  # bytes of a window that lie beyond any shift
HEAD = 32  # bytes by which suffixes are sorted before ties go to ranks
REST = (32, 40, 42)  # where the words begin that hold the rest of a window
SEGMENT = 1_000_000  # bytes after which a text is cut, with LENGTH - 1 bytes more
BLOCK_BYTES = 4_000_000  # of text a block should hold
BUCKET_BYTES = 12_000_000  # of text a bucket of suffixes should hold if all suffixes go on
SPREAD = 4.1  # times that a byte of text is then sent
SEEN = 500_000  # texts that a task remembers to have sent
PIECE = 1 << 14  # positions that are hashed at a time
LAST = (1 << 63) - 1

MULTIPLIERS = [np.uint64(int.from_bytes(hashlib.sha256(f"substring {k}".encode()).digest()[:8], "little") | 1) for k in range(16)]
SHIFT = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])


def fingerprints(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the strings of ``length`` bytes (8 or more) at positions ``at``; words holds the 8 bytes from each
    position. Pieces of the positions stay in the processor's cache."""
    out = np.full(len(at), length, np.uint64)
    for j in range(0, len(at), PIECE):
        h, here = out[j : j + PIECE], at[j : j + PIECE]
        for k, shift in enumerate([*range(0, length - 8, 8), length - 8]):
            h ^= words[here + shift]
            h *= MULTIPLIERS[k]
            h ^= h >> np.uint64(29 + k)
        h *= MULTIPLIERS[15]
        h ^= h >> np.uint64(32)
    return out


# ---- samples: hashes, shortened, and which of them occur again


def packed(keys: np.ndarray, width: int) -> bytes:
    """Ascending keys of ``width`` bytes, as the compressed byte planes of their steps."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps[:, 8 - width :].T).tobytes())


def opened(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, 8 - width :] = planes.T
    return np.cumsum(steps.view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Ascending keys without repeats; np.unique() hashes and is many times slower here."""
    return keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]


def among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys a sorted table holds."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def edges(keys: np.ndarray, bits: int, rest: int) -> np.ndarray:
    """Where each of the 2**bits buckets begins among ascending keys that have ``rest`` bits below the bucket's, and the end."""
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(rest)) if bits else 0, len(keys))


class Samples:
    """How a block's sample hashes are shortened and dealt out to buckets: leading bits, then ``width`` bytes."""

    def __init__(self, total: int, bucket_bytes: int):
        n = max(1, total * len(COVER) / PERIOD)
        self.bits = max(0, math.ceil(math.log2(max(1, n * 8 / bucket_bytes))))
        self.width = min(8, max(1, math.ceil((math.log2(max(2, n)) + 9 - self.bits) / 8)))
        self.rest = min(64, self.bits + 8 * self.width) - self.bits

    def short(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits - self.rest)

    def cut(self, h: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, its keys) of ascending hashes."""
        keys = distinct(self.short(h))
        at = edges(keys, self.bits, self.rest)
        low = keys & np.uint64((1 << self.rest) - 1)
        return ((b, packed(low[i:j], self.width)) for b, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i)

    def again(self, h: np.ndarray, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Which hashes occur again, from (bucket, bits of the keys that cut() put there)."""
        h = self.short(h)
        order = np.argsort(h)
        fresh = np.concatenate([np.ones(min(1, len(h)), bool), np.diff(h[order]) > 0])
        keys = h[order[fresh]]
        at, marks = edges(keys, self.bits, self.rest), np.zeros(len(keys), bool)
        for b, blob in answers:
            marks[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=at[b + 1] - at[b])
        out = np.empty(len(h), bool)
        out[order] = marks[np.cumsum(fresh) - 1]
        return out


# ---- suffixes: stretches of text, sorted bucket by bucket


def refined(order: np.ndarray, fresh: np.ndarray, at: np.ndarray, source: np.ndarray, shifts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """An order and its group beginnings, with the groups put in order by the words of ``source`` at ``at`` plus shifts and parted.

    Word by word, only groups whose members differ in the word are sorted.
    """
    place = at[order]
    for s in shifts:
        tied = np.flatnonzero(~fresh)
        differs = tied[source[place[tied] + s] != source[place[tied - 1] + s]]
        if not len(differs):
            continue
        group = np.cumsum(fresh, dtype=np.int32) - 1
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[differs]] = True
        idx = np.flatnonzero(mixed[group])
        word = source[place[idx] + s]
        by = np.lexsort((word, group[idx]))
        order[idx], place[idx], word = order[idx[by]], place[idx[by]], word[by]
        fresh[idx[1:]] |= word[1:] != word[:-1]
    return order, fresh


def same_strings(words: np.ndarray, pos: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): positions put together by their 50 bytes, and where a new string begins.

    The leading bits of hashes, with the index in the low bits, bring equal strings together by a plain sort; then bytes decide.
    """
    low = max(1, int(len(pos)).bit_length())
    keys = np.sort((h >> np.uint64(low) << np.uint64(low)) | np.arange(len(pos), dtype=np.uint64))
    top = keys >> np.uint64(low)
    fresh = np.concatenate([np.ones(min(1, len(top)), bool), top[1:] != top[:-1]])
    return refined((keys & np.uint64((1 << low) - 1)).astype(np.int64), fresh, pos, words, (*range(0, LENGTH - 8, 8), LENGTH - 8))


def window_buckets(words: np.ndarray, pos: np.ndarray, bits: int, mask: np.uint64) -> np.ndarray:
    """The bucket of the window at each of the ascending positions: by the least hash of its 20-byte strings."""
    if not bits or not len(pos):
        return np.zeros(len(pos), np.uint16)
    wanted = np.zeros(int(pos[-1]) + PERIOD + 1, np.int32)
    wanted[pos] += 1
    wanted[pos + PERIOD] -= 1
    need = np.flatnonzero(np.cumsum(wanted) > 0)
    low = np.full(len(wanted) + PERIOD, np.iinfo(np.uint64).max, np.uint64)
    low[need] = fingerprints(words, need, SAMPLE) & mask
    for k in (1, 2, 4, 8):
        np.minimum(low[:-k], low[k:], out=low[:-k])
    low = np.minimum(low[pos], low[pos + 15])
    return (low * MULTIPLIERS[15] >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)


def stretches(data: np.ndarray, pos: np.ndarray, bucket: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, compressed text of its windows): positions that follow each other in one bucket are one stretch.

    ``pos`` ascends within each bucket, buckets ascend; owner is the rank of each window's document.
    """
    if not len(pos):
        return
    first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(first, append=len(pos))
    at, size, whose, where = pos[first], n + LENGTH - 1, owner[first], bucket[first]
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    tool = zstandard.ZstdCompressor(level=3)
    for i, j in zip(cuts, [*cuts[1:], len(first)], strict=True):
        ends = np.cumsum(size[i:j])
        text = data[np.arange(ends[-1]) + np.repeat(at[i:j] - ends + size[i:j], size[i:j])]
        yield int(where[i]), tool.compress(np.array([j - i], "<u4").tobytes() + n[i:j].astype("<u4").tobytes() + whose[i:j].astype("<i8").tobytes() + text.tobytes())


def read_stretches(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, where each window begins in it, rank of its document)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    m = int(np.frombuffer(raw, "<u4", 1)[0])
    n, whose = np.frombuffer(raw, "<u4", m, 4).astype(np.int64), np.frombuffer(raw, "<i8", m, 4 + 4 * m)
    text = np.frombuffer(raw, np.uint8, offset=4 + 12 * m)
    before = np.cumsum(n) - n
    return text, np.arange(n.sum()) + np.repeat(np.arange(m) * (LENGTH - 1), n), np.repeat(whose, n) if m else before


def by_words(at: np.ndarray, big: np.ndarray, shifts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): positions sorted by their words at ``shifts``, and where in that order a new string begins."""
    order = np.argsort(big[at])
    first = big[at[order]]
    return refined(order, np.concatenate([np.ones(min(1, len(at)), bool), first[1:] != first[:-1]]), at, big, shifts)


def cover_ranks(text: np.ndarray, big: np.ndarray) -> np.ndarray:
    """The rank, by its 20 bytes, of the string at each position that the cover holds; equal strings have equal ranks."""
    n = max(0, len(text) - SAMPLE + 1)
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    at = at[at < n]
    order, fresh = by_words(at, big, (8, SAMPLE - 8))
    ranks = np.zeros(len(text), np.int32)
    ranks[at[order]] = np.cumsum(fresh)
    return ranks


def compared(big: np.ndarray, ranks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the window at i comes before, equals or follows that at j; their first 32 bytes are equal."""
    d = SHIFT[i % PERIOD, j % PERIOD]
    out = np.sign(ranks[i + d] - ranks[j + d])
    for s in REST:
        tied = np.flatnonzero(out == 0)
        a, b = big[i[tied] + s], big[j[tied] + s]
        out[tied] = (a > b).astype(np.int32) - (a < b)
    return out


def sorted_suffixes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): the order of the suffixes at ``at`` by their first 50 bytes, and where in it a new string begins.

    Ties of the first 32 bytes go to a quicksort of all tied groups at once: each is parted by comparison with its middle
    member until all members equal it.
    """
    big = np.ndarray((max(0, len(text) - 7),), ">u8", np.ascontiguousarray(text), strides=(1,)).astype(np.uint64)
    order, fresh = by_words(at, big, tuple(range(8, HEAD, 8)))
    ranks = cover_ranks(text, big)
    start = np.flatnonzero(fresh)
    size = np.diff(start, append=len(at))
    start, size = start[size > 1], size[size > 1]
    while len(start):
        idx = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)  # all members of open groups, in order
        group = np.repeat(np.arange(len(start)), size)
        sign = compared(big, ranks, at[order[idx]], at[order[(start + size // 2)[group]]])
        key = group * 3 + sign + 1
        if sign.any():
            by = np.argsort(key, kind="stable")
            order[idx], key = order[idx[by]], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[idx[new]] = True
        begin = np.flatnonzero(new)
        n = np.diff(begin, append=len(key))
        open_ = (n > 1) & (key[begin] % 3 != 1)
        start, size = idx[begin[open_]], n[open_]
    return order, fresh


class Block:
    """The distinct texts of a block, or segments of texts, in order of their documents' ids, as one stretch of bytes."""

    def __init__(self, docs: pd.DataFrame, key_bits: int):
        least = docs.groupby(["digest", "seg"])["ord"].min()
        docs = docs[docs["body"].notna()].drop_duplicates(["digest", "seg"])
        docs = docs.assign(ord=least.loc[pd.MultiIndex.from_frame(docs[["digest", "seg"]])].to_numpy()).sort_values(["ord", "digest", "seg"])
        self.docs, self.mask = docs, np.uint64((1 << key_bits) - 1)
        bodies = [zstandard.ZstdDecompressor().decompress(b) for b in docs["body"]]
        self.sizes = np.array([len(b) for b in bodies], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(bodies) + bytes(LENGTH), np.uint8)
        self.words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,)).copy()
        self.total = len(self.data) - LENGTH
        self.ords = docs["ord"].to_numpy(np.int64)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the cover samples."""
        found = [np.empty(0, np.int64)]
        for s, n in zip(self.starts, self.sizes - SAMPLE + 1, strict=True):
            if n > 0:
                base = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
                found.append(base[base < n] + s)
        at = np.concatenate(found)
        return at, fingerprints(self.words, at, SAMPLE) & self.mask

    def suffixes(self, at: np.ndarray) -> None:
        """Windows with one of the samples ``at`` among their first places: positions, equal ones together, and buckets to be."""
        near = np.zeros(self.total + 1, np.int32)
        np.add.at(near, np.maximum(0, at - (PERIOD - 1)), 1)
        near[at + 1] -= 1  # positions differ from each other
        room = np.maximum(0, self.sizes - LENGTH + 1)
        inside = np.zeros(self.total + 1, np.int32)
        np.add.at(inside, self.starts, (room > 0).astype(np.int32))
        np.add.at(inside, self.starts + room, -(room > 0).astype(np.int32))
        # near reaches into the text before, where windows so near the end are too short anyway
        self.pos = np.flatnonzero((np.cumsum(near[: self.total]) > 0) & (np.cumsum(inside[: self.total]) > 0))
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.pos]
        self.order, fresh = same_strings(self.words, self.pos, fingerprints(self.words, self.pos, LENGTH) & self.mask)
        self.group = np.flatnonzero(fresh)

    def sent(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which group, position, bucket) of each string's first window, by bucket and position."""
        first = np.minimum.reduceat(self.order, self.group) if len(self.group) else self.group
        group = np.empty(len(self.pos), np.int64)
        group[first] = np.arange(len(first))
        first = np.sort(first)
        bucket = window_buckets(self.words, self.pos[first], bits, self.mask)
        by = np.argsort(bucket, kind="stable")
        return group[first[by]], first[by], bucket[by]

    def covered(self, earlier: np.ndarray) -> np.ndarray:
        """Each byte: whether it goes. ``earlier`` tells of each group whether a document before its first one here holds it."""
        gone = np.zeros(len(self.pos), bool)
        if len(gone):
            n = np.diff(self.group, append=len(self.order))
            ord_ = self.ords[self.doc]
            gone[self.order] = np.repeat(earlier, n) | (ord_[self.order] > np.repeat(np.minimum.reduceat(ord_[self.order], self.group), n))
        marks = np.zeros(self.total + LENGTH + 1, np.int32)
        marks[self.pos[gone]] += 1  # positions differ from each other
        marks[self.pos[gone] + LENGTH] -= 1
        return np.cumsum(marks[: self.total]) > 0


def runs(gone: np.ndarray) -> np.ndarray:
    """Begin and end of each stretch of true values, in turn."""
    return np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, segment: int = SEGMENT, key_bits: int = 64) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row: bytes go that a 50-byte string covers which also
    starts in a document with a smaller id.

    Null texts are empty. Null ids come after all others and are alike among themselves; rows of one id never remove
    each other's bytes; repeated rows stay. Other columns are not looked at. No rows give no rows. Texts of any length
    are cut into segments that overlap, so that no task holds more than a block's worth of arrays; only the few texts of
    more than one segment that lose bytes are read again, a text at a time. ``key_bits`` shortens hashes, for tests.

    A task sends a text once however many copies there are; copies get their result by a join on the digest, salted for
    digests that many rows share. What else moves is a few bytes for each cover sample, then stretches of text around
    samples that occur again. A block sends a string once, however often it holds it, and a bucket answers a block once,
    so a bucket holds at most one copy of a string for each block of 4 MB.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.select("id", F.coalesce("id", F.lit(LAST)).alias("ord"), F.length("body").cast("long").alias("n"), F.sha2("body", 256).alias("sha"), "body")
    ids = settled(rows.drop("body"))
    total = int(ids.agg(F.sum("n")).first()[0] or 0)
    blocks = max(1, math.ceil(total / block_bytes))
    samples = Samples(total, 2 * bucket_bytes)
    bits = max(0, math.ceil(math.log2(max(1, total * SPREAD / bucket_bytes))))

    def send_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, seen = zstandard.ZstdCompressor(level=3), {}
        for pdf in batches:
            out = []
            for ord_, sha, body in zip(pdf["ord"], pdf["sha"], pdf["body"], strict=True):
                digest = bytes.fromhex(sha)
                if digest in seen and seen[digest] <= ord_:
                    continue
                for k, at in enumerate(range(0, len(body), segment)):
                    block = int.from_bytes(hashlib.sha256(digest + at.to_bytes(8, "big")).digest()[:8], "big") % blocks
                    out.append((block, digest, k, len(body), ord_, None if digest in seen else tool.compress(body[at : at + segment + LENGTH - 1])))
                if len(seen) >= SEEN:
                    seen.clear()
                seen[digest] = ord_
            yield pd.DataFrame(out, columns=["block", "digest", "seg", "size", "ord", "body"]).astype({"block": "int32", "seg": "int32", "size": "int64", "ord": "int64"})

    note_schema = "block int, kind int, bucket int, blob binary"

    def note(block: list[int] | int, kind: int, bucket: list[int] | int, blob: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"block": block, "kind": kind, "bucket": bucket, "blob": blob}).astype({"block": "int32", "kind": "int32", "bucket": "int32"})

    def answers(out: list[tuple[int, np.ndarray]], kind: int, bucket: int) -> pd.DataFrame:
        out = [(b, np.packbits(x).tobytes()) for b, x in out if x.any()]
        return note([b for b, _ in out], kind, bucket, [x for _, x in out])

    def of_kind(notes: pd.DataFrame, kind: int) -> list[tuple[int, bytes]]:
        mine = notes[notes["kind"] == kind] if len(notes) else notes
        return list(zip(mine["bucket"].astype(int), mine["blob"], strict=True)) if len(mine) else []

    def send_samples(texts: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(Block(texts, key_bits).samples()[1])
        twice = h[1:][h[1:] == h[:-1]]
        pieces = [(1, *x) for x in samples.cut(h)] + [(2, *x) for x in samples.cut(twice)]
        return note(int(texts["block"].iloc[0]), [k for k, _, _ in pieces], [b for _, b, _ in pieces], [x for _, _, x in pieces])

    def count_samples(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, bucket = pdf[pdf["kind"] == 1], int(pdf["bucket"].iloc[0])
        blobs = [opened(x, samples.width) for x in mine["blob"]]
        keys = np.sort(np.concatenate([*blobs, *(opened(x, samples.width) for x in pdf.loc[pdf["kind"] == 2, "blob"])]))
        again = distinct(keys[1:][keys[1:] == keys[:-1]])
        return answers([(b, among(x, again)) for b, x in zip(mine["block"], blobs, strict=True)], 3, bucket)

    def block_of(texts: pd.DataFrame, notes: pd.DataFrame) -> Block:
        block = Block(texts, key_bits)
        at, h = block.samples()
        block.suffixes(at[samples.again(h, of_kind(notes, 3))])
        return block

    def send_suffixes(texts: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        if texts.empty or notes.empty:
            return note([], 4, [], [])
        block = block_of(texts, notes)
        _, first, bucket = block.sent(bits)
        pieces = list(stretches(block.data, block.pos[first], bucket, block.ords[block.doc[first]]))
        return note(int(texts["block"].iloc[0]), 4, [b for b, _ in pieces], [x for _, x in pieces])

    def sort_suffixes(pdf: pd.DataFrame) -> pd.DataFrame:
        """Blocks learn which of their strings a document before the one they sent holds too."""
        parts = [read_stretches(x) for x in pdf["blob"]]
        ends = np.cumsum([len(t) for t, _, _ in parts])
        at = np.concatenate([a + e - len(t) for (t, a, _), e in zip(parts, ends, strict=True)])
        whose = np.concatenate([w for _, _, w in parts])
        order, fresh = sorted_suffixes(np.concatenate([t for t, _, _ in parts]), at)
        group = np.flatnonzero(fresh)
        least = np.minimum.reduceat(whose[order], group)
        earlier = np.zeros(len(at), bool)
        earlier[order] = whose[order] > np.repeat(least, np.diff(group, append=len(at)))
        until = np.cumsum([len(a) for _, a, _ in parts])
        return answers([(b, earlier[e - len(a) : e]) for b, (_, a, _), e in zip(pdf["block"], parts, until, strict=True)], 5, int(pdf["bucket"].iloc[0]))

    found_schema = "digest binary, seg int, size long, n_removed long, n_spans long, kept string, gone array<long>"

    def finish(texts: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(texts) and len(notes):
            block = block_of(texts, notes)
            by, _, bucket = block.sent(bits)
            at, marks = edges(bucket.astype(np.uint64), bits, 0), np.zeros(len(by), bool)
            for b, blob in of_kind(notes, 5):
                marks[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=at[b + 1] - at[b])
            earlier = np.zeros(len(by), bool)
            earlier[by] = marks
            covered = block.covered(earlier)
            for digest, seg, size, a, b in zip(block.docs["digest"], block.docs["seg"], block.docs["size"], block.starts, block.ends, strict=True):
                c = covered[a:b]
                n = int(c.sum())
                if n and size <= segment:
                    out.append((digest, seg, size, n, len(runs(c)) // 2, hashlib.sha256(block.data[a:b][~c].tobytes()).hexdigest(), None))
                elif n:
                    out.append((digest, seg, size, None, None, None, runs(c) + seg * segment))
        frame = pd.DataFrame(out, columns=["digest", "seg", "size", "n_removed", "n_spans", "kept", "gone"])
        return frame.astype({"seg": "int32", "size": "int64", "n_removed": "Int64", "n_spans": "Int64"})

    def finish_long(texts: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        """The results of a text of several segments, from the stretches that each of them loses."""
        if texts.empty or parts.empty:
            return pd.DataFrame({"sha": [], "n_removed": [], "n_spans": [], "kept": []})
        body = texts["body"].iloc[0]
        gone = np.zeros(len(body), bool)
        for x in parts["gone"]:
            for a, b in np.asarray(x).reshape(-1, 2):
                gone[a:b] = True
        rest = hashlib.sha256(np.frombuffer(body, np.uint8)[~gone].tobytes()).hexdigest()
        return pd.DataFrame({"sha": [texts["sha"].iloc[0]], "n_removed": [int(gone.sum())], "n_spans": [len(runs(gone)) // 2], "kept": [rest]})

    # one plan up to ``found``, so that Spark shuffles the texts and the samples once and reuses both
    texts = rows.where(F.col("n") > 0).select("ord", "sha", "body").mapInPandas(send_texts, "block int, digest binary, seg int, size long, ord long, body binary").groupBy("block")
    ranked = texts.applyInPandas(send_samples, note_schema).groupBy("bucket").applyInPandas(count_samples, note_schema)
    earlier = texts.cogroup(ranked.groupBy("block")).applyInPandas(send_suffixes, note_schema).groupBy("bucket").applyInPandas(sort_suffixes, note_schema)
    found = settled(texts.cogroup(ranked.unionByName(earlier).groupBy("block")).applyInPandas(finish, found_schema))
    whole = found.where("gone is null").select(F.lower(F.hex("digest")).alias("sha"), "n_removed", "n_spans", "kept")
    parts = found.where("gone is not null").select(F.lower(F.hex("digest")).alias("sha"), "gone")
    bodies = rows.where(F.col("n") > segment).join(parts.select("sha").distinct(), "sha", "left_semi").groupBy("sha").agg(F.first("body").alias("body"))
    long = bodies.groupBy("sha").cogroup(parts.groupBy("sha")).applyInPandas(finish_long, "sha string, n_removed long, n_spans long, kept string")
    none = F.lit(None)
    first = ids.groupBy("sha").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("last > first").select("sha", "first", none.cast("long").alias("n_removed"), none.cast("long").alias("n_spans"), none.cast("string").alias("kept"))
    facts = first.unionByName(whole.unionByName(long).withColumn("first", none.cast("long"))).groupBy("sha").agg(*(F.max(c).alias(c) for c in ("first", "n_removed", "n_spans", "kept")))
    out = spread_join(ids, facts, "sha", ["ord"])
    copy = (F.col("ord") > F.col("first")) & (F.col("n") >= LENGTH)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
