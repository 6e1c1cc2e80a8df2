"""Hybrid retrieval: candidate legs, blending, floors, pins and scope rules over DataFrames of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.scores import DISCOVERY_FLOOR, RERANK_FLOOR, cosine, hybrid_score


def eligible(chunks: DataFrame, revisions: DataFrame, files: DataFrame, user_id: int, file_ids: list[int] | None = None) -> DataFrame:
    """Chunks that a tenant may see: same tenant throughout, consented, not deleted, of the current revision."""
    live = files.where((F.col("user_id") == user_id) & F.col("user_granted_ai_access") & ~F.col("is_deleted"))
    live = live.where(F.col("id").isin(file_ids)) if file_ids is not None else live
    shown = live.select(F.col("id").alias("file_id"), F.col("current_revision").alias("revision"))
    current = revisions.where((F.col("status") == "current") & (F.col("user_id") == user_id)).select("file_id", "revision")
    return chunks.where(F.col("user_id") == user_id).join(shown, ["file_id", "revision"], "left_semi").join(current, ["file_id", "revision"], "left_semi")


def vector_leg(chunks: DataFrame, query: list[float], keys: list[str], k: int, vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine; one sort with a limit, ties by key."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    scored = chunks.select(*keys, cosine(vector, literal).alias("vector_score"))
    return scored.orderBy(F.desc("vector_score"), *keys).limit(k)


def literal_leg(chunks: DataFrame, phrase: str, group: str, order: list[str], text: str = "text") -> DataFrame:
    """The first chunk of each group that holds the phrase, whatever its case."""
    hit = chunks.where(F.contains(F.lower(F.col(text)), F.lit(phrase.lower())))
    first = Window.partitionBy(group).orderBy(*order)
    return hit.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("literal_match", F.lit(True))


def rare_term_leg(chunks: DataFrame, words: list[str], key: str, text: str = "text", most: int = 5) -> DataFrame:
    """(word, df, key) of chunks that hold a word which 1 to ``most`` documents hold."""
    asked = F.array(*(F.lit(w.lower()) for w in words))
    hits = chunks.select(key, F.explode(F.filter(asked, lambda w: F.contains(F.lower(F.col(text)), w))).alias("word"))
    df = hits.groupBy("word").agg(F.countDistinct(key).alias("df")).where(F.col("df").between(1, most))
    return hits.join(df, "word").select("word", "df", key).distinct()


def blend(legs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of candidate legs; each score's best by key, then the hybrid score, literal matches first."""
    columns = {"vector_score": "double", "lexical_score": "double", "summary_tag_score": "double", "literal_match": "boolean"}
    whole = [leg.select(*keys, *(F.col(c) if c in leg.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items())) for leg in legs]
    union = whole[0]
    for leg in whole[1:]:
        union = union.unionByName(leg)
    best = union.groupBy(*keys).agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in columns if c != "literal_match"), F.coalesce(F.bool_or("literal_match"), F.lit(False)).alias("literal_match"))
    return best.withColumn("score", hybrid_score("vector_score", "lexical_score", "summary_tag_score"))


def discovery_floor(rows: DataFrame, score: Column, pinned: Column, floor: float = DISCOVERY_FLOOR) -> DataFrame:
    return rows.where(pinned | (score >= floor))


def rerank_floor(rows: DataFrame, group: list[str], rerank: str = "rerank_score", floor: float = RERANK_FLOOR) -> DataFrame:
    """Where any row of a group reaches the floor, scored rows below it go; unscored rows stay."""
    best = F.max(rerank).over(Window.partitionBy(*group))
    return rows.withColumn("_best", best).where((F.coalesce("_best", F.lit(-1.0)) < floor) | F.col(rerank).isNull() | (F.col(rerank) >= floor)).drop("_best")


def file_scope_cap(rows: DataFrame, group: list[str], file: str, rank: str, files: int) -> DataFrame:
    """All rows of the first ``files`` different files by best rank."""
    seen = F.min(rank).over(Window.partitionBy(*group, file))
    place = F.dense_rank().over(Window.partitionBy(*group).orderBy("_first", file))
    return rows.withColumn("_first", seen).withColumn("_place", place).where(F.col("_place") <= files).drop("_first", "_place")


def diverse_pick(rows: DataFrame, engine: str, order: list[str], n: int) -> DataFrame:
    """Round robin by engine: every engine's first, then every engine's second, up to n.

    No engine gives more than n rows, a bound that Spark applies before the rows are shuffled.
    """
    turn = F.row_number().over(Window.partitionBy(engine).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", engine).limit(n)


def scoped_representation(kept: DataFrame, pool: DataFrame, file: str, score: str, order: list[str], floor: float = RERANK_FLOOR) -> DataFrame:
    """``kept`` plus, of each file of the pool that it lacks, the best row at the floor or above."""
    best = Window.partitionBy(file).orderBy(F.desc(score), *order)
    lost = pool.join(kept.select(file).distinct(), file, "left_anti").where(F.col(score) >= floor)
    return kept.unionByName(lost.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").select(*kept.columns))
