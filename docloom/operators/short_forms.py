"""Short forms in texts, resolved by a table of meanings and the words around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CODE = r"\b([A-Z][A-Z0-9]+)\b"
# Words that ask what something stands for.
ASKS_MEANING = ["abbreviation", "acronym", "define", "definition", "full", "meaning", "means", "stand", "stands"]


def _words(text: str) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0)))


def resolved_short_forms(texts: DataFrame, forms: DataFrame, key: str, text: str = "text", history: str | None = None) -> DataFrame:
    """(key, detected, resolved): the known short forms of each text in order, and the text with their meanings written out.

    ``forms``: code, meaning, topics (array of words), free (needs no context); a code may have several rows. A meaning has its
    quorum if the text or its ``history`` asks for meanings, holds a topic or a word of the meaning itself, or if it is free. A code
    is written out where one of its meanings alone has a quorum, unless the text holds all words of that meaning already.
    Texts meet forms by a join on the code, so the table may be of any size. Texts that are null or hold no known code come
    back as they are; so do keys that repeat, each row by itself.
    """
    rows = texts.select(F.col(key), F.col(text).alias("_text"), (F.col(history) if history else F.lit("")).alias("_history")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_own", _words("_text")).withColumn("_context", F.array_union("_own", _words("_history")))
    codes = rows.select("_row", "_own", "_context", F.posexplode(F.array_distinct(F.regexp_extract_all("_text", F.lit(CODE), F.lit(1)))).alias("_at", "code"))
    met = codes.join(forms.withColumn("_meant", _words("meaning")), "code")
    around = F.array_except("_context", F.array(F.lower("code")))
    quorum = F.arrays_overlap("_context", F.array(*map(F.lit, ASKS_MEANING))) | F.arrays_overlap("_context", "topics") | F.arrays_overlap(around, "_meant") | F.col("free")
    met = met.withColumn("_quorum", F.coalesce(quorum, F.lit(False)).cast("int"))
    said = F.size(F.array_except("_meant", "_own")) == 0
    chosen = met.groupBy("_row", "_at", "code").agg(F.sum("_quorum").alias("_n"), F.max(F.when(F.col("_quorum") == 1, F.struct("meaning", (~said).alias("new")))).alias("_best"))
    entry = F.struct("_at", "code", F.when((F.col("_n") == 1) & F.col("_best.new"), F.col("_best.meaning")).alias("meaning"))
    found = chosen.groupBy("_row").agg(F.array_sort(F.collect_list(entry)).alias("_found"))  # of one text's codes
    written = lambda acc, x: F.when(x["meaning"].isNull(), acc).otherwise(F.regexp_replace(acc, F.concat(F.lit(r"\b"), x["code"], F.lit(r"\b(?! \()")), F.concat(x["meaning"], F.lit(" ("), x["code"], F.lit(")"))))
    joined = rows.join(found, "_row", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<struct<_at:int,code:string,meaning:string>>")))
    return joined.select(key, F.transform("_found", lambda x: x["code"]).alias("detected"), F.aggregate("_found", F.col("_text"), written).alias("resolved"))


def conflicting_forms(forms: DataFrame) -> DataFrame:
    """(code, meanings, shared): codes of several meanings, and how many topics more than one of them has."""
    pairs = forms.select("code", "meaning", F.explode_outer(F.array_distinct("topics")).alias("topic")).distinct()
    topics = pairs.withColumn("_n", F.count("topic").over(Window.partitionBy("code", "topic")))
    return topics.groupBy("code").agg(F.countDistinct("meaning").alias("meanings"), F.countDistinct(F.when(F.col("_n") > 1, F.col("topic"))).alias("shared")).where("meanings > 1")
