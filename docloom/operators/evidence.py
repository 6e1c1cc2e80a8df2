"""Evidence: relevance gates, source cards, classification, topics, and grounding of claims."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.rules import bound
from docloom.functions.text import canonical_url, col, ngrams, normalized_words, plural_stem


def stem_set(text: Column | str) -> Column:
    return F.array_distinct(F.transform(normalized_words(text), plural_stem))


def keyword_gate(text: Column | str, words: Column) -> Column:
    """At least two of the words' stems, or all if there are fewer, are in the text."""
    asked = F.array_distinct(F.transform(words, plural_stem))
    return F.size(F.array_intersect(stem_set(text), asked)) >= F.least(F.lit(2), F.size(asked))


def source_cards(rows: DataFrame, url: str, rank: str, score: str) -> DataFrame:
    """One card for each canonical URL: earliest rank, best score, number of rows."""
    named = rows.withColumn("canonical", canonical_url(url)).where("canonical is not null")
    return named.groupBy("canonical").agg(F.min(rank).alias("rank"), F.max(score).alias("score"), F.count("*").alias("n_rows"))


def classify(text: Column | str, hints: dict[str, list[str]], name: Column | None = None) -> Column:
    """The kind with most hints (two points where the name has it too); ties to the last in the alphabet; none: other."""
    shown, title = F.lower(F.coalesce(col(text), F.lit(""))), F.lower(F.coalesce(name, F.lit(""))) if name is not None else F.lit("")
    points = lambda words: reduce(lambda a, b: a + b, (F.when(title.contains(w), 2).when(shown.contains(w), 1).otherwise(0) for w in words))
    best = F.greatest(*(F.struct(points(words).alias("n"), F.lit(kind).alias("kind")) for kind, words in hints.items()))
    return F.when(best["n"] > 0, best["kind"]).otherwise("other")


def ngram_topics(segments: DataFrame, doc: str, segment: str, text: str, widths: tuple[int, ...] = (1, 2, 3, 4, 5), least: tuple[int, int] = (3, 2)) -> DataFrame:
    """(doc, gram, width, hits): n-grams in enough different segments of a document, three for single words, else two.

    ``segment`` names a segment within its document; grams are made distinct in it before they are counted.
    """
    grams = lambda w: F.concat(*(F.transform(F.array_distinct(ngrams(w, n)), _wide(n)) for n in widths))
    seen = segments.select(doc, F.inline(bound(normalized_words(text), grams)))
    hits = seen.groupBy(doc, "gram", "width").agg(F.count("*").alias("hits"))
    return hits.where((F.col("hits") >= least[0]) | ((F.col("width") > 1) & (F.col("hits") >= least[1])))


def repeated_grams(docs: list[str], widths: int, least: tuple[int, int]) -> list[tuple[int, str, int, int]]:
    """(document, gram, width, segments) of the grams of texts in lines of words that stand in enough lines.

    Grams are named by the name of their first words and their last word, all documents together, so equal names are equal
    grams; only grams in two lines or more are made wider, as no others can be.
    """
    lines = [line.split() for d in docs for line in d.split("\n")]
    line_doc = np.repeat(np.arange(len(docs)), [d.count("\n") + 1 for d in docs])
    words = [w for line in lines for w in line]
    line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    numbers: dict[str, int] = defaultdict(count().__next__)
    word = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    at, name, out = np.arange(len(words)), line_doc[line] * (len(numbers) + 1) + word, []
    for width in range(1, widths + 1):
        name = np.unique(name, return_inverse=True)[1]
        first, where = np.unique(name * (len(lines) + 1) + line[at], return_index=True)  # a row for each gram and line
        hits = np.bincount(first // (len(lines) + 1))
        one = np.zeros(len(hits), np.int64)
        one[name[where]] = at[where]  # some place of each gram
        for k in np.flatnonzero(hits >= (least[0] if width == 1 else least[1])).tolist():
            out.append((int(line_doc[line[one[k]]]), " ".join(words[one[k] : one[k] + width]), width, int(hits[k])))
        keep = (hits[name] >= 2) & (at + width < len(words))
        at, name = at[keep], name[keep]
        same = line[at + width] == line[at]
        at, name = at[same], name[same]
        if not len(at):
            break
        name = name * (len(numbers) + 1) + word[at + width]
    return out


def document_topics(docs: DataFrame, doc: str, text: Column | str, widths: int = 5, least: tuple[int, int] = (3, 2), group: int = 2_000_000) -> DataFrame:
    """(doc, gram, width, hits): ``ngram_topics`` of documents whose segments are their lines, counted where a document lies.

    Nothing is shuffled: grams of a document meet within its row, and only those in enough lines leave it. Short documents are
    counted together, up to ``group`` characters. Null and empty texts have no topics; rows are documents, whatever their ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = (pdf["body"].str.len().cumsum() // group).to_numpy()
            for _, part in pdf.groupby(parts):
                rows = repeated_grams(part["body"].tolist(), widths, least)
                ids = part["id"].to_numpy()
                yield pd.DataFrame({"id": ids[[r[0] for r in rows]] if rows else ids[:0], "gram": [r[1] for r in rows], "width": [r[2] for r in rows], "hits": [r[3] for r in rows]})

    body = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}+#\n]+", " ")
    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("id"), body.alias("body")).mapInPandas(run, f"id {kind}, gram string, width int, hits long").withColumnRenamed("id", doc)


def ranked_topics(topics: DataFrame, doc: str, n: int = 12) -> DataFrame:
    """Each document's first ``n`` topics, numbered: by hits times width, wider ones first, then by name."""
    best = Window.partitionBy(doc).orderBy(F.desc(F.col("hits") * F.col("width")), F.desc("width"), "gram")
    return topics.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def _wide(n: int):
    return lambda g: F.struct(g.alias("gram"), F.lit(n).alias("width"))


def ungrounded(atoms: DataFrame, evidence: DataFrame, run: str, atom: str, text: str) -> DataFrame:
    """Claim atoms, single words or numbers, that no evidence text of their run has among its words.

    Evidence is taken apart into distinct (run, word) rows before the join, so a run's texts never meet in one row.
    """
    words = evidence.select(run, F.explode(F.array_distinct(normalized_words(text))).alias("_atom")).distinct()
    return atoms.withColumn("_atom", F.lower(F.col(atom))).join(words, [run, "_atom"], "left_anti").select(*atoms.columns)


def mutual_pairs(distances: DataFrame, doc: str, left: str, right: str, distance: str) -> DataFrame:
    """Pairs whose members are each other's nearest; ties to the smaller name."""
    a = F.row_number().over(Window.partitionBy(doc, left).orderBy(distance, right))
    b = F.row_number().over(Window.partitionBy(doc, right).orderBy(distance, left))
    return distances.withColumn("_a", a).withColumn("_b", b).where("_a = 1 and _b = 1").drop("_a", "_b")
