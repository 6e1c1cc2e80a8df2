"""Queries over encodings and composed forms, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import unicode
from docloom.plans.queries import read

PARTED = {"ä": "a\u0308", "ö": "o\u0308", "ü": "u\u0308", "é": "e\u0301", "ñ": "n\u0303"}


def composed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose letters are taken apart, put together again."""
    parted = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), PARTED.items(), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.sha2(parted, 256).alias("parted"), F.sha2(unicode.nfc(parted), 256).alias("composed"))


def decoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents written in four encodings, by their ids, and read back."""
    narrow = ~F.col("text").rlike(r"[^\x{0000}-\x{007F}\x{00A0}-\x{00FF}]")
    as_ = lambda name: F.encode("text", name)
    marked = F.concat(F.lit(b"\xef\xbb\xbf"), as_("UTF-8"))
    little = F.concat(F.lit(b"\xff\xfe"), as_("UTF-16LE"))
    k = F.col("doc_id") % 4
    data = F.when(k == 0, as_("UTF-8")).when(k == 1, marked).when(k == 2, little).when(narrow, as_("ISO-8859-1")).otherwise(as_("UTF-8"))
    found = read(spark, d, "documents").select("doc_id", unicode.decoded_text(data).alias("found"))
    return found.select("doc_id", "found.encoding", F.sha2("found.text", 256).alias("sha"))


QUERIES = {"composed_texts": composed_texts, "decoded_texts": decoded_texts}

_PARTED_SQL = reduce(lambda c, x: f"replace({c}, '{x[0]}', '{x[1]}')", PARTED.items(), "text")
ORACLE_SQL = {
    "composed_texts": f"SELECT doc_id, sha256({_PARTED_SQL}) AS parted, sha256(nfc_normalize({_PARTED_SQL})) AS composed FROM documents",
    "decoded_texts": r"""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' WHEN 3 THEN CASE WHEN NOT regexp_matches(text, '[^\x{0000}-\x{007F}\x{00A0}-\x{00FF}]') AND regexp_matches(text, '[^\x{0000}-\x{007F}]') THEN 'cp1252' ELSE 'utf-8' END ELSE 'utf-8' END AS encoding, sha256(text) AS sha FROM documents""",
}
