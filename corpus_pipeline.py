"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing and packing, each over all its predecessor kept.

``run`` applies the stages to ``documents``. All but the last return the columns of documents, whatever columns there
are besides doc_id and text. Rows with null ids or texts pass through as each operator says; repeated rows stay repeated
until packing, which places each; texts may be of any length; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import lines, mixing, packing, simhash, toxicity
from docloom.llm.common import settled, table
from docloom.llm.queries import tokenizer_path

WEIGHTS = {"good": 0.9, "poor": 0.1}  # of the tokens by predicted quality


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that none is named as a column that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("doc_id")).alias("row"))


def unwrapped(found: DataFrame, docs: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return found.select(*(changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("row")[c]).alias(c) for c in docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored like any other, repeated rows alike."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs go from the texts, and documents that lose all of their text that way; n_chars follows the text."""
    found = lines.dedup_lines(wrapped(docs)).where("n_removed = 0 or text <> ''")
    n_chars = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None
    return unwrapped(found, docs, {} if n_chars is None else {"n_chars": n_chars})


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates stays, and every row without an id."""
    return simhash.keep_one_each(docs).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their rates until expected totals by quality have the target weights; each stays once at least.

    Rows without an id, and without a text, take part as mix() says.
    """
    labels = mixing.quality_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(wrapped(docs), labels, WEIGHTS, keep_all=True)
    return unwrapped(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, {})


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: a row for each piece of each document, with its place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", lines_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # model scores, fingerprints' components and tokens are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
