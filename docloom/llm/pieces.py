"""SentencePiece BPE encoding and decoding: words merged together in vectorised rounds over flat symbol arrays."""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SLICE = 1 << 20  # bytes of text, or ids, that are taken apart at a time
WORDS_KEPT = 300_000  # words whose ids a Python worker remembers, and as many older ones
KEPT_BYTES = 40  # of a word that is remembered, at most
LONG = 400  # bytes of a word from which a queue merges it: rounds over it would each merge little
NONE = np.int32(np.iinfo(np.int32).max)  # the rank of a pair that makes no piece
MIX = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's bits


class Pieces:
    """A model's vocabulary as arrays: what each pair of symbols makes and at what rank, and the bytes of each id.

    Taken are BPE models with byte fallback, whose texts are changed by nothing but spaces shown as U+2581 and one put
    before; others raise. Symbols are the ids of pieces, and further numbers for characters that occur inside pieces only.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_at = sp.piece_to_id("<0x00>")
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        shown = "Aİ ééﬁ \t  x\n "
        if not sp.is_byte(self.bytes_at) or any(map(sp.is_unused, plain)) or sp.normalize(shown) != SPACE + shown.replace(" ", SPACE):
            raise ValueError("only BPE models with byte fallback, without text normalization and unused pieces, are supported")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        names = {i: sp.id_to_piece(i) for i in plain}
        self.symbols = {name: i for i, name in names.items()}
        for name in names.values():
            for c in name:
                self.symbols.setdefault(c, n + len(self.symbols))
        self.inner = {s: c for c, s in self.symbols.items() if s >= n}
        self.by_code = np.full(0x110000, -1, np.int32)
        self.by_code[[ord(c) for c in self.symbols if len(c) == 1]] = [s for c, s in self.symbols.items() if len(c) == 1]
        self.width = n + len(self.symbols) + 1  # above every symbol's number
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs = [(self.symbols[a] * self.width + self.symbols[b], order[sp.get_score(i)], i) for i, name in names.items() for k in range(1, len(name)) if (a := name[:k]) in self.symbols and (b := name[k:]) in self.symbols]
        self.keep_pairs(*(np.array(x, t) for x, t in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True)))
        self.inside = {name[k : k + 2] for name in names.values() for k in range(len(name) - 1)}
        self.joined = joined_bytes(names.values())
        self.out = [b""] * n
        for i, name in names.items():
            self.out[i] = name.replace(SPACE, " ").encode()
        for b in range(256):
            self.out[self.bytes_at + b] = bytes([b])
        self.out[sp.unk_id()] = sp.decode([sp.unk_id()]).encode()
        self.silent = [i for i in range(n) if sp.is_control(i)]
        self.leads = {i for i, name in names.items() if name.startswith(SPACE)}
        self.quiet = np.isin(np.arange(n), self.silent)
        self.said = pa.array([*self.out, *(x[1 if i in self.leads else 0 :] for i, x in enumerate(self.out))], pa.large_binary())  # and from n on, as first piece
        self.n = n

    def keep_pairs(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """The pairs as an open hash table, an eighth full at most; a key goes to the next free place after its own."""
        self.shift = np.uint64(64 - max(4, (8 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.ranks, self.made = np.full(size, -1, np.int64), np.full(size, NONE), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.keys[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(np.where(free, at, -1), return_index=True)[1]] = True  # of keys for one place the first takes it
            put = free & first
            self.keys[at[put]], self.ranks[at[put]], self.made[at[put]] = keys[left[put]], ranks[left[put]], made[left[put]]
            left, at = left[~put], (at[~put] + ~free[~put]) % size

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair of symbols; rank NONE where they make no piece. Negative symbols make none."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -1)
        at = self.place(key)
        found = self.keys[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            found = self.keys[at[open_]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        there = (self.keys[at] == key) & (key >= 0)
        return np.where(there, self.ranks[at], NONE), np.where(there, self.made[at], np.int32(-1))

    def characters(self, words: bytes) -> np.ndarray:
        """Symbols of a text; a character that no piece holds is -1 - code point."""
        code = np.frombuffer(shown(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        found = self.by_code[code]
        return np.where(found >= 0, found, -1 - code)

    def ids(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Symbols of words in a row as little-endian ids, and the end of each word in bytes; characters that are no piece become the bytes of their UTF-8."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.n))
        ends = np.cumsum(sizes)
        if not len(odd):
            return sym.astype("<u4").tobytes(), 4 * ends
        spelled = [[self.bytes_at + b for b in (chr(-1 - s) if s < 0 else self.inner[s]).encode("utf-8", "surrogatepass")] for s in sym[odd].tolist()]
        width = np.ones(len(sym), np.int64)
        width[odd] = [len(x) for x in spelled]
        upto = np.cumsum(width)
        out = np.repeat(sym, width)
        out[np.repeat(width > 1, width) | np.isin(np.arange(len(out)), upto[odd] - 1)] = [i for x in spelled for i in x]
        return out.astype("<u4").tobytes(), 4 * np.concatenate([[0], upto])[ends]


def joined_bytes(names: Iterable[str]) -> np.ndarray:
    """Whether no word may be cut between two bytes, at 256 * first + second: a piece has them side by side, or the second goes on a character."""
    joined = np.zeros((256, 256), bool)
    for name in names:
        data = np.frombuffer(name.replace(SPACE, " ").encode(), np.uint8)
        joined[data[:-1], data[1:]] = True
    joined[:, 0x80:0xC0] = True
    return joined.ravel()


def merge_rounds(sym: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words after all merges, and how many each word has; words of ``sizes`` symbols lie in a row in ``sym``.

    The rule to keep is: always the pair of best rank, of equals the leftmost. In a round each word's best rank is its
    minimum over a segment; all pairs of that rank merge at once from the left without overlap. A merge that makes a
    neighbouring pair of that rank or a better one is the word's last in the round, as that pair's turn is then. Words
    without pairs leave the arrays after each round.
    """
    left = np.zeros(len(sizes), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # words, and their symbols in a row
    word, sizes = np.flatnonzero(sizes), sizes[sizes > 0]
    seg = np.repeat(np.arange(len(word)), sizes)
    rank, made = paired(sym, seg, pieces)
    while len(word):
        starts = np.cumsum(sizes) - sizes
        best = np.minimum.reduceat(rank, starts)
        open_ = best < NONE
        if not open_.all():
            keep = np.repeat(open_, sizes)
            left[word[~open_]] = sizes[~open_]
            done.append((word[seg[~keep]], sym[~keep]))
            sym, rank, made = sym[keep], rank[keep], made[keep]
            word, sizes, best = word[open_], sizes[open_], best[open_]
            if not len(word):
                break
            starts = np.cumsum(sizes) - sizes
            seg = np.repeat(np.arange(len(word)), sizes)
        at = np.flatnonzero(rank == best[seg])
        run = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1])  # pairs that overlap: every other one, from the left
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff([*run, len(at)]))) % 2 == 0]
        own, piece = seg[at], made[at]
        beside = np.concatenate([[False], (np.diff(at) == 2) & (own[1:] == own[:-1])])
        before = np.where(beside, np.concatenate([[-1], piece[:-1]]), np.where(at > starts[own], sym[np.maximum(at - 1, 0)], -1))
        last = at + 2 >= starts[own] + sizes[own]
        after = np.where(last, -1, sym[np.minimum(at + 2, len(sym) - 1)])
        (rank1, made1), (rank2, made2) = pieces.look_up(before, piece), pieces.look_up(piece, after)
        soon = np.minimum(rank1, rank2) <= best[own]
        if soon.any():
            earlier = np.cumsum(soon) - soon
            ok = earlier == earlier[np.searchsorted(own, own)]  # none since the word's first merge
            at, own, piece, rank1, made1, rank2, made2 = (x[ok] for x in (at, own, piece, rank1, made1, rank2, made2))
        sym[at] = piece
        rank[at], made[at] = rank2, made2
        inner = at > starts[own]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, seg, rank, made = sym[keep], seg[keep], rank[keep], made[keep]
        lead = (at - np.arange(len(at)) - 1)[inner]  # the symbol before each new piece, by its new place
        rank[lead], made[lead] = rank1[inner], made1[inner]
        sizes = sizes - np.bincount(own, minlength=len(word))
    if not done:
        return sym, left
    owner, sym = (np.concatenate(x) for x in zip(*done, strict=True))
    return sym[np.argsort(owner, kind="stable")], left


def paired(sym: np.ndarray, seg: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(rank, piece) of the pair that begins at each position; none across words."""
    after = np.full(len(sym), -1, sym.dtype)
    after[:-1] = np.where(seg[1:] == seg[:-1], sym[1:], -1)
    return pieces.look_up(sym, after)


def merge_queue(sym: list[int], pieces: Pieces) -> list[int]:
    """The same merges of one long word by a queue over its pairs, in n log n steps."""
    n = len(sym)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    arr = np.array(sym, np.int32)
    rank, made = paired(arr, np.zeros(n, np.int8), pieces)
    queue = [(int(rank[k]), int(k), sym[k], sym[k + 1], int(made[k])) for k in np.flatnonzero(rank < NONE)]
    heapq.heapify(queue)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            r, m = pieces.look_up(np.array([a]), np.array([b]))
            known[a, b] = int(r[0]), int(m[0])
        return known[a, b]

    gone = -1 - 0x110000
    while queue:
        _, k, a, b, piece = heapq.heappop(queue)
        j = after[k]
        if sym[k] != a or j < 0 or sym[j] != b:
            continue
        sym[k], sym[j], after[k] = piece, gone, after[j]
        if after[k] >= 0:
            before[after[k]] = k
        for x, y in ((before[k], k), (k, after[k])):
            if x >= 0 and y >= 0 and (found := pair(sym[x], sym[y]))[0] < NONE:
                heapq.heappush(queue, (found[0], x, sym[x], sym[y], found[1]))
    return [s for s in sym if s != gone]


class Codec:
    """Texts to ids and back, as the library does both; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def cut(self, word: bytes) -> list[bytes]:
        """A word cut where no piece has both characters side by side; bytes alone don't tell that of all."""
        text, inside = shown(word), self.pieces.inside
        at = [0, *(k + 1 for k in range(len(text) - 1) if text[k : k + 2] not in inside), len(text)]
        return [text[a:b].replace(SPACE, " ").encode("utf-8", "surrogatepass") for a, b in zip(at[:-1], at[1:], strict=True)]

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, all merged together."""
        long, short = [w for w in words if len(w) > LONG], [w for w in words if len(w) <= LONG]
        parts = []
        if short:
            data = b"".join(short)
            starts = np.cumsum([0, *map(len, short[:-1])])
            begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80  # of characters
            parts.append(merge_rounds(self.pieces.characters(data), np.add.reduceat(begins, starts, dtype=np.int64), self.pieces))
        for w in long:
            sym = merge_queue(self.pieces.characters(w).tolist(), self.pieces)
            parts.append((np.array(sym, np.int32), np.array([len(sym)])))
        flat, ends = self.pieces.ids(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        ends = ends.tolist()
        return {w: flat[a:b] for w, a, b in zip([*short, *long], [0, *ends], ends, strict=False)}

    def encode(self, texts: list[str], bos: bool, eos: bool) -> list[bytes]:
        head, tail = (np.array([x] * on, "<u4").tobytes() for x, on in ((self.pieces.bos, bos), (self.pieces.eos, eos)))
        out, todo, held = [], [], 0
        for text in [*texts, None]:
            if text is None or held >= SLICE:
                out += [head + x + tail for x in self.encode_together(todo)]
                todo, held = [], 0
            if text is not None:
                todo.append((" " + text.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if text else b"")
                held += len(todo[-1])
        return out

    def encode_together(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that begin with the model's space, from one row of words: a slice at a time, each of its different words looked up once."""
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        upto, flat, at = np.zeros(len(texts), np.int64), bytearray(), 0
        while at < len(data):
            bounds = self.bounds(data, at, ends)
            offsets = (bounds - at).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[at : bounds[-1]])])
            found = words.dictionary_encode()
            ids = pa.array(self.ids_of(found.dictionary.to_pylist()), pa.large_binary()).take(found.indices)
            offsets = np.frombuffer(ids.buffers()[1], np.int64)[: len(bounds)]
            here = slice(*np.searchsorted(ends, [at, bounds[-1]], "right"))
            upto[here] = len(flat) + offsets[np.searchsorted(bounds, ends[here])]
            flat += memoryview(ids.buffers()[2])[: offsets[-1]]
            at = int(bounds[-1])
        upto = upto.tolist()
        whole_row = memoryview(flat)
        return [bytes(whole_row[a:b]) for a, b in zip([0, *upto], upto, strict=False)]

    def bounds(self, data: np.ndarray, at: int, ends: np.ndarray) -> np.ndarray:
        """Where words begin from ``at`` on, and where the last of them ends: about SLICE bytes of whole words, none across the end of a text."""
        size = SLICE
        while True:
            part = data[at : at + size]
            apart = ~self.pieces.joined[(part[:-1].astype(np.uint16) << 8) | part[1:]]
            apart[ends[slice(*np.searchsorted(ends, [at + 1, at + len(part)]))] - at - 1] = True
            cuts = np.flatnonzero(apart) + 1
            if at + size >= len(data):
                return at + np.concatenate([[0], cuts, [len(part)]])
            if len(cuts):
                return at + np.concatenate([[0], cuts])
            size *= 2

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words. Those met lately are remembered: in two halves, of which the older goes."""
        ids = list(map(self.kept.get, words))
        gaps = holes(ids)
        parts = {i: self.cut(words[i]) for i in gaps if len(words[i]) > KEPT_BYTES}
        new = {words[i] for i in gaps if i not in parts}.union(*parts.values())
        found = {w: x for w in new if (x := self.old.get(w) or self.kept.get(w))}
        if len(found) < len(new):
            found |= self.learn([w for w in new if w not in found])
        for i in gaps:
            ids[i] = b"".join([found[x] for x in parts[i]]) if i in parts else found[words[i]]
        self.kept.update((w, x) for w, x in found.items() if len(w) <= KEPT_BYTES)
        if len(self.kept) > WORDS_KEPT:
            self.old, self.kept = self.kept, {}
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids say nothing, the first piece loses one leading space, and byte ids that are no UTF-8 become U+FFFD each."""
        return self.decode_all([ids])[0]

    def decode_all(self, rows: list[bytes]) -> list[str]:
        """The texts of rows of ids, about SLICE ids at a time."""
        out, todo, held = [], [], 0
        for ids in rows:
            todo.append(ids)
            held += len(ids) // 4
            if held >= SLICE:
                out += self.decode_together(todo)
                todo, held = [], 0
        return out + self.decode_together(todo)

    def decode_together(self, rows: list[bytes]) -> list[str]:
        """What the pieces of all rows say, put in a row and cut where the rows end; rows with control ids within or broken UTF-8 are read by runs."""
        p = self.pieces
        found, ends = np.frombuffer(b"".join(rows), "<u4"), np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows))) // 4
        if len(found) and found.max() >= p.n:
            raise ValueError(f"id {found.max()} is not below {p.n}")
        starts = np.concatenate([[0], ends])[: len(rows)]
        quiet = p.quiet[found]
        silent = np.flatnonzero(quiet)
        some, head, tail = ends > starts, np.zeros(len(rows), int), np.zeros(len(rows), int)
        head[some], tail[some] = quiet[starts[some]], quiet[ends[some] - 1]
        within = np.searchsorted(silent, ends) - np.searchsorted(silent, starts) > head + tail
        first = (starts + head)[starts + head < ends]
        data, upto = bytearray(), np.zeros(len(rows), np.int64)
        for k in range(0, len(found), SLICE):
            part = found[k : k + SLICE].copy()
            part[first[slice(*np.searchsorted(first, [k, k + len(part)]))] - k] += p.n
            said = p.said.take(pa.array(part))
            offsets = np.frombuffer(said.buffers()[1], np.int64)[: len(said) + 1]
            here = slice(*np.searchsorted(ends, [k, k + len(said)], "right"))
            upto[here] = len(data) + offsets[ends[here] - k]
            data += memoryview(said.buffers()[2])[: offsets[-1]]
        texts, upto = [], upto.tolist()
        for i, (a, b) in enumerate(zip([0, *upto], upto, strict=False)):
            text = None if within[i] else whole(data[a:b])
            texts.append(self.decode_by_runs(found[starts[i] : ends[i]]) if text is None else text)
        return texts

    def decode_by_runs(self, found: np.ndarray) -> str:
        """Bytes of each run of byte ids are read apart from the ids around them."""
        p, text, run, begun = self.pieces, [], bytearray(), False
        for i in [*found.tolist(), None]:
            if i is not None and p.bytes_at <= i < p.bytes_at + 256:
                run.append(i - p.bytes_at)
                begun = True
                continue
            text.append(by_single_bytes(bytes(run)))
            run.clear()
            if i is not None and i not in p.silent:
                text.append(p.out[i].decode()[1 if i in p.leads and not begun else 0 :])
                begun = True
        return "".join(text)


def shown(word: bytes) -> str:
    """Text with spaces as the model's pieces have them."""
    return word.decode("utf-8", "surrogatepass").replace(" ", SPACE)


def whole(data: bytes | bytearray) -> str | None:
    """Text of UTF-8, None of other bytes."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def holes(values: list) -> list[int]:
    """Where a list has None."""
    at, i = [], -1
    try:
        while True:
            i = values.index(None, i + 1)
            at.append(i)
    except ValueError:
        return at


def by_single_bytes(data: bytes) -> str:
    """UTF-8, with U+FFFD for every byte that is no part of a character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as bad:
            out.append(data[at : at + bad.start].decode() + "�")
            at += bad.start + 1
    return "".join(out)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each model and Python worker, with the words that it has met."""
    return Codec(path)


def encoded(text: Column, model_path: str, bos: bool = True, eos: bool = True) -> Column:
    """Ids of a whole text as little-endian unsigned 32-bit bytes; a null text counts as empty: begin and end ids alone."""

    @F.pandas_udf("binary")
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series(codec(model_path).encode([by_single_bytes(b) for b in bodies], bos, eos), dtype=object)

    return run(F.coalesce(text.cast("binary"), F.lit(b"")))


def decoded(ids: Column, model_path: str) -> Column:
    """The text of such ids; null ids give null."""

    @F.pandas_udf("string")
    def run(found: pd.Series) -> pd.Series:
        return told(found, model_path)

    return run(ids)


def coded(text: Column, model_path: str, bos: bool = True, eos: bool = True) -> Column:
    """Both, as a struct (ids, decoded). Of decoded(encoded(text)) beside encoded(text) Spark would work the ids out twice."""

    @F.pandas_udf("ids binary, decoded string")
    def run(bodies: pd.Series) -> pd.DataFrame:
        ids = pd.Series(codec(model_path).encode([by_single_bytes(b) for b in bodies], bos, eos), dtype=object)
        return pd.DataFrame({"ids": ids, "decoded": told(ids, model_path)})

    return run(F.coalesce(text.cast("binary"), F.lit(b"")))


def told(found: pd.Series, model_path: str) -> pd.Series:
    out = pd.Series([None] * len(found), dtype=object)
    there = found.notna().to_numpy()
    out[there] = pd.Series(codec(model_path).decode_all(found[there].tolist()), index=out.index[there], dtype=object)
    return out


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True, decoded_col: str | None = None) -> DataFrame:
    """(id, ids, n_tokens) of each row: the ids that the library gives for the whole text, begin and end ids included.

    With ``decoded_col`` that column holds the text of the ids, read back from them in the same pass over the rows.
    Null and empty texts have the begin and end ids alone; bytes that are no UTF-8 count as U+FFFD each; null ids of rows
    and repeated rows stay as they are. A text is cut into slices and words where no piece reaches across, so memory grows
    with one text and its ids, not with their pairs. Rows are independent: no shuffle. Other columns are not looked at.
    No rows give no rows.
    """
    if decoded_col is None:
        found = docs.select(F.col(id_col), encoded(F.col(text_col), model_path, bos, eos).alias("ids"))
    else:
        both = coded(F.col(text_col), model_path, bos, eos)
        found = docs.select(F.col(id_col), both["ids"].alias("ids"), both["decoded"].alias(decoded_col))
    return found.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_documents(encoded_docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in ``text_col``, which replaces a column of that name; null ids give a null text."""
    return encoded_docs.withColumn(text_col, decoded(F.col(ids_col), model_path))
