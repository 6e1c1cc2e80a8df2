"""Periodic runs of words: repeated k-grams mask what cannot join a run, Main-Lorentz finds the runs in what is left."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12  # words of a run
GROUP = 400_000  # words that are worked on together, or one text
TABLE = 1 << 26  # names of stretches that are held, at most
MIX = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's bits


def unmasked(ids: np.ndarray, doc: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of ``least`` words at least that repeated k-grams of their own document cover.

    A run of length L and period q repeats its first L - q words, and L - q is k at least; both L - q and q being no
    more than L - q, the two copies cover the run. Grams meet by hash: a collision can only let more through.
    """
    n = len(ids) - k + 1
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = doc[:n].astype(np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * MIX + ids[j : j + n].astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * MIX
    whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.concatenate([order[1:][same], order[:-1][same]])
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.subtract.at(cover, again + k, 1)
    held = np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(bool)
    parted = np.concatenate([[True], doc[1:] != doc[:-1], [True]])
    start = np.flatnonzero(held[1:] & (~held[:-1] | parted))
    end = np.flatnonzero(held[:-1] & (~held[1:] | parted))
    keep = end - start >= least
    return start[keep], end[keep]


class Stretches:
    """Names of all stretches of 1, 2, 4, ... words; equal stretches have equal names, so extensions are exact."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.names = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
        while 2 << (len(self.names) - 1) <= longest and (len(self.names) + 1) * len(ids) <= max(TABLE, 2 * len(ids)):
            last, step = self.names[-1].astype(np.int64), 1 << (len(self.names) - 1)
            if len(last) <= step:
                break
            pair = last[:-step] * (int(last.max()) + 1) + last[step:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from each a and b on, or backwards before them, up to ``most``."""
        got = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names, step = self.names[j], 1 << j
            open_ = np.flatnonzero(got + step <= most)
            while len(open_):  # more than once for the longest step alone
                x, y = (a[open_] - got[open_] - step, b[open_] - got[open_] - step) if back else (a[open_] + got[open_], b[open_] + got[open_])
                open_ = open_[names[x] == names[y]]
                got[open_] += step
                open_ = open_[got[open_] + step <= most[open_]] if j == len(self.names) - 1 else open_[:0]
        return got


def spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 0, 1, ... for each owner) of ``size`` items each."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)


def main_lorentz(ids: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of every run in the segments [start, end) of ``ids``, one after another without gaps.

    A segment is halved again and again, all segments at each depth together. A run that crosses a middle has a whole
    period to its left or right: for each distance q the words at the middle and q before or after it are extended both
    ways, and give a run if that makes q words at least. Runs that go on beyond the part belong to a middle further up.
    """
    table = Stretches(ids, int((end - start).max(initial=1)))
    low, high = start, end  # of the segment that a part lies in
    found = [(np.empty(0, np.int64),) * 3]
    while len(start):
        mid = (start + end) // 2
        right, off = spread(end - mid)
        left, off2 = spread(mid - start)
        part = np.concatenate([right, left])
        q = np.concatenate([off, off2]) + 1
        a = np.concatenate([mid[right], mid[left] - off2 - 1])
        lo, hi = start[part], end[part]
        begun = (a + q < hi) & (ids[a] == ids[np.minimum(a + q, len(ids) - 1)]) | (a > lo) & (ids[a - 1] == ids[a + q - 1])
        part, q, a, lo, hi = part[begun], q[begun], a[begun], lo[begun], hi[begun]
        on = table.extension(a, a + q, hi - a - q, back=False)
        back = table.extension(a, a + q, a - lo, back=True)
        ok = (on + back >= q) & (on + back + q >= least)
        part, q, s, e = part[ok], q[ok], (a - back)[ok], (a + q + on)[ok]
        beyond = (s > low[part]) & (ids[s - 1] == ids[s - 1 + q]) | (e < high[part]) & (ids[np.minimum(e, len(ids) - 1)] == ids[e - q])
        found.append((s[~beyond], e[~beyond], q[~beyond]))
        start, end = np.concatenate([start, mid]), np.concatenate([mid, end])
        low, high = np.tile(low, 2), np.tile(high, 2)
        keep = end - start >= least
        start, end, low, high = start[keep], end[keep], low[keep], high[keep]
    s, e, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])[: len(s)]  # multiples of a period give the same run
    return s[first], e[first], q[first]


def runs_of(ids: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of documents that lie in a row, ordered by start, then period."""
    start, end = unmasked(ids, doc, -(-least // 2), least)
    size = end - start
    owner, off = spread(size)
    at = start[owner] + off
    top = np.cumsum(size)
    s, e, q = main_lorentz(ids[at], top - size, top, least)
    s, e = at[s], at[e - 1] + 1
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def analysed(texts: list[bytes], least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of words, runs, text without the repeats) of each text."""
    words = [t.split() for t in texts]
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
    base = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(words)), size)
    s, e, q = runs_of(ids, doc, least)
    own = doc[s]
    ends = np.searchsorted(own, np.arange(len(words) + 1))
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, s + q, 1)
    np.subtract.at(edge, e, 1)
    kept = np.cumsum(edge[:-1]) == 0
    texts = [b" ".join(compress(ws, kept[b : b + len(ws)].tolist()) if hi > lo else ws) for ws, b, lo, hi in zip(words, base.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (s - base[own], e - s, q)], fields=list(FOUND.value_type))
    return pa.array(size), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), runs), pa.array(texts, pa.binary()).view(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row.

    Words are the bytes between ASCII white space. ``runs`` are the stretches (start, length, period) with smallest period q and
    at least max(``least``, 2q) words that no neighbouring word extends, by start, then period; ``collapsed`` is the text
    of the words that no run holds after its first q words, joined by spaces. Null and empty texts have no words, no runs and
    an empty text. Null ids and repeated rows stay as they are; rows are independent: no shuffle. Memory grows with one
    text; short texts are worked on in groups. Other columns are not looked at. No rows give no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo: list[bytes] = []
            first, held = 0, 0
            for k, text in enumerate(batch.column("body")):
                todo.append(text.as_py())
                held += len(todo[-1]) // 4
                if held >= GROUP or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(todo)), *analysed(todo, least)], ["id", "n_words", "runs", "collapsed"])
                    first, held, todo = k + 1, 0, []

    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body")
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), body).mapInArrow(work, f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
