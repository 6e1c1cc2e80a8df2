"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ann, chat, licenses, lines, mixing, pieces
from docloom.llm.common import table
from docloom.llm.neardup_vectors import vector_links
from docloom.llm.negatives import hard_negatives
from docloom.llm.packing import pack_documents
from docloom.llm.runs import periodic_runs
from docloom.llm.simhash import simhash_components
from docloom.llm.substrings import dedup_substrings
from docloom.llm.toxicity import classify, fit


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.rates(docs, mixing.quality_domains(labels), {"good": 0.82, "poor": 0.09, "toxic": 0.09})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    found = pieces.encode_documents(table(spark, sf_dir, "documents"), path, decoded_col="decoded")
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(256 * x.cast("double")).cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("embedding"), relabelled.alias("label"))
    found = hard_negatives(rows, F.col("vec_id") % 50 == 0)
    return found.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


def cyclic(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth text by the hash of its id repeats a stretch of its own words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", words).withColumn("n", F.expr("nullif(size(words), 0)"))
    rows = rows.withColumn("a", F.expr("(h div 10) % n")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(cyclic(table(spark, sf_dir, "documents")))
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int"))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("top", F.get(longest, F.lit(0)))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op1_substrings": op1_substrings, "op2_licenses": op2_licenses, "op3_simhash": op3_simhash, "op4_ann": op4_ann, "op5_mixing": op5_mixing, "op6_toxicity": op6_toxicity, "op7_lines": op7_lines, "op8_vectors": op8_vectors, "op9_packing": op9_packing, "op10_chat": op10_chat, "op11_sentencepiece": op11_sentencepiece, "op12_negatives": op12_negatives, "op13_runs": op13_runs}

ORACLE_SQL: dict[str, str] = {"op2_licenses": licenses.oracle_sql(), "op7_lines": lines.oracle_sql(), "op10_chat": chat.ORACLE_SQL}
