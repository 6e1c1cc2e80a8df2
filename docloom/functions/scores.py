"""Column functions over vectors, scores and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import col

# The weights of the hybrid blend and the floors of ranking.
VECTOR_WEIGHT, LEXICAL_WEIGHT, SUMMARY_WEIGHT = 0.68, 0.18, 0.44
RERANK_FLOOR, DISCOVERY_FLOOR = 0.15, 0.35


def dot(a: Column | str, b: Column | str) -> Column:
    both = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for null, empty, unequal lengths or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(col(a)) == F.size(col(b))) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def hybrid_score(vector: Column | str, lexical: Column | str, summary: Column | str) -> Column:
    part = lambda c: F.coalesce(col(c).cast("double"), F.lit(0.0))
    return VECTOR_WEIGHT * part(vector) + LEXICAL_WEIGHT * F.least(F.lit(1.0), part(lexical) * 4) + SUMMARY_WEIGHT * part(summary)


def evidence_score(score: Column | str, rerank: Column | str) -> Column:
    """The better of both, each 1 at most, 0 at least, to six places."""
    top = lambda c: F.least(F.lit(1.0), F.coalesce(col(c).cast("double"), F.lit(0.0)))
    return F.round(F.greatest(F.lit(0.0), top(score), top(rerank)), 6)


def shifted_date(day: Column | str, n: Column | int, unit: str) -> Column:
    """A date moved by days, weeks, months of 30 days or years of 365."""
    days = {"day": 1, "week": 7, "month": 30, "year": 365}[unit]
    return F.date_add(col(day).cast("date"), (F.lit(n) if isinstance(n, int) else n) * days)


def date_side(day: Column | str, today: Column | str) -> Column:
    diff = F.datediff(col(day).cast("date"), col(today).cast("date"))
    return F.when(diff < 0, "past").when(diff > 0, "future").otherwise("today")


def nearest_year_date(month: Column, day: Column, today: Column | str, ahead: bool) -> Column:
    """The next (or last) date with that month and day; 29 February falls back to the 28th."""
    today = col(today).cast("date")
    made = lambda year: F.make_date(year, month, F.least(day, F.day(F.last_day(F.make_date(year, month, F.lit(1))))))
    this = made(F.year(today))
    return F.when(this >= today, this).otherwise(made(F.year(today) + 1)) if ahead else F.when(this <= today, this).otherwise(made(F.year(today) - 1))


def fingerprint(kind: Column | str, subject: Column | str, predicate: Column | str, value: Column | str) -> Column:
    """Identity of a remembered triple. The subject stands twice, as stored fingerprints have it."""
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(col(c), r"[\s_]+", " ")))
    return F.sha2(F.concat_ws("\x1f", tidy(kind), tidy(subject), tidy(subject), tidy(predicate), tidy(value)), 256)
