"""License scans by diagonal voting: word k-grams joined with template positions, votes counted by offset diagonal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRAM = 3
NEAR = 3  # diagonals this close are one match with words put in or left out
SHARE = 0.8  # of a template's grams that a span must hold
STRETCH = 1.25  # a merged span's length against its template's

# The base phrases and their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# The templates of the method's own labels, from the licenses' public notices.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("gpl", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_grams(base: list[tuple[str, str]], notices: list[tuple[str, str]], k: int) -> list[tuple]:
    """(template, label, is base, words, position, gram words...) for every k-gram of every template."""
    out = []
    for t, (label, text) in enumerate([*base, *notices]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        out += [(t, label, t < len(base), len(words), p, *words[p : p + k]) for p in range(len(words) - k + 1)]
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, k: int = GRAM, spans: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score; or the spans found.

    Every k-gram of every text is joined with the templates' (a fixed list, broadcast) by its hash, then by its words.
    Hits vote for the diagonal word position - template position. A base place is a diagonal with all its grams. A
    span is a diagonal, or neighbouring diagonals merged, with ``SHARE`` of the template's grams; merged ones may be
    ``STRETCH`` times as long as the template. score is the best share among valid spans and single diagonals, 0 to 1.
    Null or empty texts have no words: counts 0, places null, labels ''. Repeated rows and null ids stay rows of their
    own. Other columns are not looked at. ``spans``: rows (id, template, label, first_word, end_word, share) instead.
    """
    spark = docs.sparkSession
    names = [f"g{i}" for i in range(k)]
    grams = spark.createDataFrame(template_grams(base, notices, k), f"tmpl int, label string, is_base boolean, len int, tpos int, {', '.join(f'{n} string' for n in names)}")
    grams = grams.withColumn("hash", F.xxhash64(*names))
    words = F.regexp_extract_all(F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    at = rows.select("id", "row", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "w0"))
    here = [F.col("w0"), *(F.get("words", F.col("pos") + i) for i in range(1, k))]
    at = at.withColumn("hash", F.xxhash64(*here))
    same = [here[i].eqNullSafe(F.col(n)) for i, n in enumerate(names)]
    hit = at.join(F.broadcast(grams.withColumnRenamed("hash", "thash")), reduce(lambda a, b: a & b, same, F.expr("hash = thash")), "left")
    hit = hit.where(F.col("tmpl").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    hit = hit.select("id", "row", "n_words", "pos", "tmpl", "label", "is_base", "tpos", (F.col("len") - k + 1).alias("need"), (F.col("pos") - F.col("tpos")).alias("diag"))

    one = Window.partitionBy("row", "tmpl", "diag")
    line = Window.partitionBy("row", "tmpl").orderBy("diag", "tpos")
    hit = hit.withColumn("votes", F.when(F.col("tmpl").isNotNull(), F.count("*").over(one)))
    hit = hit.withColumn("far", (F.coalesce(F.col("diag") - F.lag("diag").over(line), F.lit(0)) > NEAR).cast("int"))
    hit = hit.withColumn("part", F.sum("far").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("is_base") & (F.col("tpos") == 0) & (F.col("votes") == F.col("need"))
    span = hit.groupBy("row", "id", "n_words", "tmpl", "label", "is_base", "need", "part").agg(
        F.count_if(place).alias("places"),
        F.min(F.when(place, F.col("pos"))).alias("first"),
        F.max(F.when(place, F.col("pos"))).alias("last"),
        F.max("votes").alias("best"),
        F.size(F.collect_set("tpos")).alias("held"),
        F.min("pos").alias("start"),
        (F.max("pos") + k).alias("end"),
    )
    whole = F.when(F.col("end") - F.col("start") <= F.lit(STRETCH) * (F.col("need") + k - 1), F.col("held")).otherwise(0)
    span = span.withColumn("share", F.coalesce(F.greatest(F.col("best"), whole) / F.col("need"), F.lit(0.0)))
    if spans:
        return span.where(F.col("share") >= SHARE).select(F.col("id").alias(id_col), F.col("tmpl").alias("template"), "label", F.col("start").cast("long").alias("first_word"), F.col("end").cast("long").alias("end_word"), "share")
    based, found = F.when(F.col("places") > 0, F.col("label")), F.when((F.col("places") > 0) | (~F.col("is_base") & (F.col("share") >= SHARE)), F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = span.groupBy("row", "id", "n_words").agg(F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"), joined(based).alias("base_labels"), joined(found).alias("labels"), F.max("share").alias("score"))
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle_sql(base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, k: int = GRAM) -> str:
    """The same result in DuckDB's SQL over documents."""
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    values = ", ".join(f"({', '.join(map(quoted, (*t[:5], ' '.join(t[5:]))))})" for t in template_grams(base, notices, k))
    return f"""
WITH g(tmpl, label, is_base, len, tpos, gram) AS (VALUES {values}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(0, len(words) - {k - 1})) AS pos FROM w),
h AS (SELECT p.doc_id, g.tmpl, g.label, g.is_base, g.tpos, p.pos, p.pos - g.tpos AS diag, g.len - {k - 1} AS need
      FROM p JOIN g ON array_to_string(list_slice(p.words, p.pos + 1, p.pos + {k}), ' ') = g.gram),
v AS (SELECT *, count(*) OVER (PARTITION BY doc_id, tmpl, diag) AS votes,
      CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tmpl ORDER BY diag, tpos) > {NEAR} THEN 1 ELSE 0 END AS far FROM h),
c AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, tmpl ORDER BY diag, tpos ROWS UNBOUNDED PRECEDING) AS part,
      is_base AND tpos = 0 AND votes = need AS place FROM v),
s AS (SELECT doc_id, tmpl, label, is_base, count(*) FILTER (place) AS places, min(pos) FILTER (place) AS first, max(pos) FILTER (place) AS last,
      greatest(max(votes), CASE WHEN max(pos) + {k} - min(pos) <= {STRETCH} * (need + {k - 1}) THEN count(DISTINCT tpos) ELSE 0 END)::DOUBLE / need AS share
      FROM c GROUP BY doc_id, tmpl, label, is_base, need, part),
d AS (SELECT doc_id, sum(places)::BIGINT AS n_base, min(first)::BIGINT AS first_word, max(last)::BIGINT AS last_word,
      coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0), '') AS base_labels,
      coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR (NOT is_base AND share >= {SHARE})), '') AS labels, max(share) AS score
      FROM s GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(d.n_base, 0) AS n_base, d.first_word, d.last_word,
       coalesce(d.base_labels, '') AS base_labels, coalesce(d.labels, '') AS labels, coalesce(d.score, 0.0) AS score
FROM w LEFT JOIN d USING (doc_id)"""
