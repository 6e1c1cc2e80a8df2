"""Facts out of text: arithmetic, acronyms, spelling, identity statements, memory validation and query shape."""

from __future__ import annotations

import difflib
import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from docloom.functions.text import col, holds_credentials

# Bounds of an expression.
MOST_PARTS, MOST_POWER, LARGEST = 64, 12, 1e100

SYMBOL = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|(\*\*|//|[-+*/%^()]))")
BINDING = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "^": 4, "**": 4}  # signs bind at 3

# Statements about oneself, by kind of fact.
IDENTITY = [
    ("name", r"(?i)\bmy name is (?:now )?([A-Za-z][\w\-']{0,39})\b"),
    ("name", r"(?i)\bmy name's ([A-Za-z][\w\-']{0,39})\b"),
    ("name", r"(?i)\bcall me ([A-Za-z][\w\-']{0,39})\b"),
    ("language", r"(?i)\bmy (?:preferred )?language is ([A-Za-z ]{2,30})\b"),
    ("language", r"(?i)\bspeak to me in ([A-Za-z ]{2,30})\b"),
    ("units", r"(?i)\bi prefer (celsius|fahrenheit|metric|imperial)(?: units)?\b"),
    ("timezone", r"(?i)\bmy timezone is ([A-Za-z_/+-]{2,40})\b"),
]

# Marks of facts that are never kept.
PRIVATE = r"(?i)\b(?:salary|income|wealth|health|diagnos|disease|syndrome|disorder|allergy|pregnan|friend|brother|sister|mother|father|wife|husband)\b"

# Marks of uncertainty.
UNSURE = r"(?i)\b(?:maybe|perhaps|possibly|probably|i\s+think|i\s+guess|not\s+sure|might|could\s+be)\b"

ACTIVE_FROM, PENDING_FROM = 0.88, 0.55


def combined(sign: str, a: float, b: float) -> float:
    if sign in ("^", "**"):
        if abs(b) > MOST_POWER or (a < 0 and b != int(b)):
            raise ValueError("power")
        out = a**b
    elif sign in "+-":
        out = a + b if sign == "+" else a - b
    else:
        out = {"*": lambda: a * b, "/": lambda: a / b, "//": lambda: a // b, "%": lambda: a % b}[sign]()
    if abs(out) > LARGEST:
        raise ValueError("size")
    return out


def arithmetic(text: str | None) -> float | None:
    """The value of an expression of numbers, + - * / // % ** ^ and brackets; null for anything else or out of bounds.

    Read by binding strength: a sign takes what binds more strongly than itself, a power is read from the right.
    """
    source, parts, at = (text or "").strip(), [], 0
    while at < len(source):
        found = SYMBOL.match(source, at)
        if not found or len(parts) == MOST_PARTS:
            return None
        parts.append(found[1] or found[2])
        at = found.end()
    parts.reverse()  # read from the end of the list

    def operand() -> float:
        part = parts.pop()
        if part == "(":
            inner = strength(0)
            if parts.pop() != ")":
                raise ValueError("bracket")
            return inner
        if part in "+-":
            inner = strength(3)
            return -inner if part == "-" else inner
        return float(part) if "." in part else int(part)

    def strength(least: int) -> float:
        value = operand()
        while parts and BINDING.get(parts[-1], 0) > least:
            sign = parts.pop()
            value = combined(sign, value, strength(3 if BINDING[sign] == 4 else BINDING[sign]))
        return value

    try:
        value = strength(0)
        return None if parts else float(value)
    except (ValueError, IndexError, ZeroDivisionError, OverflowError):
        return None


@F.pandas_udf(DoubleType())
def calculated(expressions: pd.Series) -> pd.Series:
    return expressions.map(arithmetic).astype(float)


def expression_in(c: Column | str) -> Column:
    """The first arithmetic expression of a question; years, ranges of years, dates and identity numbers are none."""
    found = F.regexp_extract(col(c), r"((?:\(?\s*-?\d+(?:\.\d+)?\s*\)?\s*(?:\*\*|//|[-+*/%^])\s*)+\(?\s*\d+(?:\.\d+)?\s*\)?)", 1)
    odd = found.rlike(r"^\s*(?:(?:19|20)\d{2}\s*-\s*(?:19|20)\d{2}|\d{3}-\d{2}-\d{4}|\d{1,4}[-/]\d{1,2}[-/]\d{1,4})\s*$")
    return F.when((found != "") & ~odd, F.trim(found))


def expand_acronyms(c: Column | str, meanings: dict[str, str]) -> Column:
    """Known acronyms, written in capitals, followed by their meaning in brackets, once for each."""
    out = col(c)
    for short, long in sorted(meanings.items()):
        out = F.when(out.rlike(rf"\b{re.escape(short)}\b") & ~F.lower(out).contains(long.lower()), F.regexp_replace(out, rf"\b{re.escape(short)}\b(?! \()", f"{short} ({long})")).otherwise(out)
    return out


def spelled(vocabulary: list[str], least: float = 0.92, margin: float = 0.05):
    """A pandas UDF that sets words right that are very near one vocabulary word and clearly farther from any other."""
    known = set(vocabulary)
    near: dict[tuple[int, str], list[str]] = {}
    for v in sorted(known):
        near.setdefault((len(v), v[:1]), []).append(v)

    def right(word: str) -> str:
        """Candidates share the word's first letter and are within two characters of its length."""
        low = word.lower()
        if len(low) < 4 or low in known:
            return word
        found = [v for n in range(len(low) - 2, len(low) + 3) for v in near.get((n, low[0]), [])]
        best = sorted(((difflib.SequenceMatcher(None, low, v).ratio(), v) for v in found), reverse=True)[:2]
        if not best or best[0][0] < least or (len(best) > 1 and best[0][0] - best[1][0] < margin):
            return word
        out = best[0][1]
        return out.upper() if word.isupper() else out.capitalize() if word[:1].isupper() else out

    @F.pandas_udf(StringType())
    def fix(texts: pd.Series) -> pd.Series:
        word = functools.lru_cache(maxsize=100_000)(right)
        return texts.map(lambda t: None if t is None else re.sub(r"[^\W\d_]+", lambda m: word(m[0]), t))

    return fix


def identity_fact(c: Column | str) -> Column:
    """struct(predicate, value) of a plain statement about oneself; null for unsure, private or secret ones."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    found = F.coalesce(*(F.when(F.regexp_extract(text, p, 1) != "", F.struct(F.lit(k).alias("predicate"), F.trim(F.regexp_extract(text, p, 1)).alias("value"))) for k, p in IDENTITY))
    return F.when(~text.rlike(UNSURE) & ~text.rlike(PRIVATE) & ~holds_credentials(text), found)


def memory_verdict(excerpt: Column | str, confidence: Column | str, explicit: Column | str) -> Column:
    """accepted: active or pending; else the first reason against: sensitive, question, uncertain, not_explicit, third_party, low_confidence."""
    t = F.trim(F.coalesce(col(excerpt), F.lit("")))
    return (
        F.when(holds_credentials(t) | t.rlike(PRIVATE), "sensitive")
        .when(t.endswith("?"), "question")
        .when(t.rlike(UNSURE), "uncertain")
        .when(~F.coalesce(col(explicit), F.lit(False)), "not_explicit")
        .when(t.rlike(r"(?i)^(?:he|she|they|his|her|their)\b"), "third_party")
        .when(F.coalesce(col(confidence), F.lit(0.0)) < PENDING_FROM, "low_confidence")
        .when(col(confidence) >= ACTIVE_FROM, "active")
        .otherwise("pending")
    )


def excerpt_around(c: Column | str, term: Column, size: int) -> Column:
    """``size`` characters around a term's first place, a quarter of them before it, cut at spaces; else the head."""
    text = col(c)
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(F.lit(1), at - size // 4)
    piece = F.substring(text, start, F.lit(size))
    return F.when(start > 1, F.regexp_replace(piece, r"^\S*\s+", "")).otherwise(piece)
