"""Chunking with citations: elements packed to a token budget by a document's shape, long ones cut, identities by content."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.rules import CODE_LINES, MARKUP_LINES, SHAPE_HITS, SHAPE_LINES

TARGET, MOST, OVERLAP = 450, 700, 60
BACK = 200  # characters that a hard cut steps back for a boundary
CODE_SHARE = 0.2  # of a document's characters from which it counts as code
TOKEN = re.compile(r"\w+|[^\w\s]")
HEADING, FENCE = re.compile(r"(#{1,6})\s+(.*)"), re.compile(r"\s*```")
SCHEMA = "doc_id long, chunk_id string, ordinal int, text string, line_start int, line_end int, token_count int, chunk_type string, section string, lead_in string"


class Element(NamedTuple):
    """A heading, code block, table or line of a text, and where it stands."""

    kind: str
    level: int
    text: str
    first: int
    last: int


def elements(text: str) -> list[Element]:
    """A text's elements in order; fenced blocks are code, neighbouring lines that begin with a bar are a table."""
    out: list[Element] = []
    fenced: list[str] | None = None
    for n, line in enumerate(text.split("\n"), 1):
        if FENCE.match(line):
            if fenced is not None and fenced:
                out.append(Element("code", 0, "\n".join(fenced), n - len(fenced), n - 1))
            fenced = [] if fenced is None else None
        elif fenced is not None:
            fenced.append(line)
        elif not line.strip():
            continue
        elif head := HEADING.match(line):
            out.append(Element("heading", len(head[1]), head[2].strip(), n, n))
        elif line.lstrip().startswith("|"):
            if out and out[-1].kind == "table" and out[-1].last == n - 1:
                out[-1] = out[-1]._replace(text=f"{out[-1].text}\n{line.strip()}", last=n)
            else:
                out.append(Element("table", 0, line.strip(), n, n))
        else:
            out.append(Element("text", 0, line.strip(), n, n))
    if fenced:  # never closed
        last = text.count("\n") + 1
        out.append(Element("code", 0, "\n".join(fenced), last - len(fenced) + 1, last))
    return out


def shape(text: str, found: list[Element]) -> str:
    """code, headed or prose: by the share of code, headings, then the shapes of the first lines."""
    size = sum(len(e.text) for e in found)
    if size and sum(len(e.text) for e in found if e.kind == "code") >= CODE_SHARE * size:
        return "code"
    lines = text.split("\n", SHAPE_LINES)[:SHAPE_LINES]
    hits = lambda shapes: sum(bool(re.match(p, x)) for x in lines for p in shapes)
    if any(e.kind == "heading" for e in found) or hits(MARKUP_LINES) >= SHAPE_HITS:
        return "headed"
    return "code" if hits(CODE_LINES) >= SHAPE_HITS else "prose"


def hard_cut(text: str, most: int) -> Iterator[str]:
    """Pieces of at most ``most`` tokens; each ends at the last line or sentence end of its last ``BACK`` characters, if it has one."""
    ends = [m.end() for m in TOKEN.finditer(text)]
    at = done = 0
    while len(ends) - done > most:
        cut = ends[done + most - 1]
        stops = [m.end() for m in re.finditer(r"\n|[.!?](?=\s)", text[max(at, cut - BACK) : cut])]
        cut = max(at, cut - BACK) + stops[-1] if stops else cut
        yield text[at:cut].strip()
        at = cut
        while done < len(ends) and ends[done] <= cut:
            done += 1
    if rest := text[at:].strip():
        yield rest


def packed_parts(parts: list[str], joint: str, most: int) -> Iterator[str]:
    """Parts put together in order while they stay within ``most`` tokens; longer ones are cut hard."""
    held: list[str] = []
    size = 0
    for part in parts:
        n = len(TOKEN.findall(part))
        if held and size + n > most:
            yield joint.join(held)
            held, size = [], 0
        if n > most:
            yield from hard_cut(part, most)
        else:
            held.append(part)
            size += n
    if held:
        yield joint.join(held)


def table_parts(text: str, most: int) -> Iterator[str]:
    """Rows put together within ``most`` tokens, each part below the header row; a row that is too long is cut hard."""
    header, *rows = text.split("\n")
    room = max(1, most - len(TOKEN.findall(header)))
    for part in packed_parts(rows, "\n", room) if rows else hard_cut(header, most):
        yield f"{header}\n{part}" if rows else part


def split_element(e: Element, most: int) -> list[str]:
    if len(TOKEN.findall(e.text)) <= most:
        return [e.text]
    if e.kind == "table":
        return list(table_parts(e.text, most))
    if e.kind == "code":
        return list(packed_parts([b for b in e.text.split("\n\n") if b.strip()], "\n\n", most))
    return split_long(e.text, most)


def split_long(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` tokens, at sentence ends where there are any."""
    return list(packed_parts([s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()], " ", most))


def chunk_id(*parts: object) -> str:
    return "chk_" + hashlib.sha256(("chunk\0" + json.dumps(parts, ensure_ascii=False, separators=(",", ":"))).encode()).hexdigest()


def chunk_text(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> Iterator[tuple[int, str, int, int, int, str, str, str]]:
    """(ordinal, text, first line, last line, tokens, kind, section path, lead-in) of each chunk of a text.

    Headed texts start a chunk at each heading and keep sections whole up to ``most`` tokens; in texts of code each block
    is a chunk; prose fills chunks to ``target``. The lead-in are the last tokens of the chunk before.
    """
    found = elements(text)
    kind = shape(text, found)
    groups: list[list[tuple[Element, str, int, str]]] = []
    path: list[str] = []
    size, fresh = 0, True
    for e in found:
        if e.kind == "heading":
            path = [*path[: e.level - 1], e.text]
        alone = kind == "code" and e.kind == "code"
        for piece in split_element(e, most):
            n = len(TOKEN.findall(piece))
            limit = most if kind == "headed" and e.kind != "heading" else target
            if fresh or alone or size + n > limit or (kind != "prose" and e.kind == "heading"):
                groups.append([])
                size = 0
            groups[-1].append((e, piece, n, " > ".join(path)))
            size, fresh = size + n, alone
    tail: list[str] = []
    for ordinal, group in enumerate(groups):
        body = "\n".join(piece for _, piece, _, _ in group)
        kinds = {e.kind for e, _, _, _ in group}
        named = "single" if len(groups) == 1 else kinds.pop() if len(kinds) == 1 else "mixed"
        yield ordinal, body, group[0][0].first, group[-1][0].last, sum(n for _, _, n, _ in group), named, group[0][3], " ".join(tail)
        tail = TOKEN.findall(body[-20 * overlap :])[-overlap:] if overlap else []


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk. Chunking is a fold in reading order, so each document is one row of an Arrow batch; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                for ordinal, body, a, b, *rest in chunk_text(text):
                    rows.append((doc, chunk_id(None if pd.isna(doc) else int(doc), ordinal, body, a, b), ordinal, body, a, b, *rest))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, SCHEMA)
