"""Changes of stored rows, as new rows: updates from a join, deletes, revocation, trash, requeues and a re-embedding swap.

Each takes the stored rows and gives what they are afterwards; a table format or an append of change rows stores that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_from(rows: DataFrame, other: DataFrame, keys: list[str], changes: dict[str, Column], when: Column | None = None) -> DataFrame:
    """``rows`` with columns changed where ``other``, one row for each key at most, has a match that ``when`` holds for.

    Changes and ``when`` may name columns of both sides; names that ``rows`` has are its own, and a column of ``other`` that
    ``rows`` has too, but for keys, can't be named.
    """
    match = "_match"
    while match in rows.columns or match in other.columns:
        match = f"_{match}"
    named = other.select(*keys, *(F.col(c) for c in other.columns if c not in rows.columns)).withColumn(match, F.lit(True))
    joined = rows.join(named, keys, "left")
    hit = F.coalesce(F.col(match) & (when if when is not None else F.lit(True)), F.lit(False))
    return joined.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns))


def delete_using(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose keys ``other`` has; null keys match nothing and stay."""
    return rows.join(other.select(*keys).distinct(), keys, "left_anti")


def released(jobs: DataFrame, fences: DataFrame, keys: list[str], delay: Column, refund: bool, state: str = "queued") -> DataFrame:
    """Jobs back in the queue after a delay in seconds where their fence holds: not cancelled, and the file still wants the revision.

    A deferred job gets its attempt back; a failed one that is tried again doesn't.
    """
    attempts = F.greatest(F.lit(0), F.col("attempts") - 1) if refund else F.col("attempts")
    at = F.timestamp_seconds(F.unix_timestamp(F.col("available_at").cast("timestamp")) + delay).cast(jobs.schema["available_at"].dataType)
    changes = {"state": F.lit(state), "attempts": attempts, "available_at": at, "lease_owner": F.lit(None)}
    return update_from(jobs, fences, keys, changes, F.col("cancelled_at").isNull() & (F.col("desired_revision") == F.col("revision")))


def revoke(files: DataFrame, chunks: DataFrame, jobs: DataFrame, revoked: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, jobs) after access to the ``revoked`` files ends: derived rows go, the files stay without them, open jobs are cancelled."""
    gone = revoked.select(key).distinct().withColumn("_revoked", F.lit(True))
    after = update_from(files, gone, [key], {"granted": F.lit(False), "current_revision": F.lit(None), "status": F.lit("not_granted")}, ~F.col("is_deleted"))
    stopped = update_from(jobs, gone, [key], {"state": F.lit("cancelled")}, F.col("state").isin("queued", "running"))
    return after, delete_using(chunks, gone, [key]), stopped


def trashed(files: DataFrame, tree: DataFrame, top: int) -> DataFrame:
    """Files under a folder's subtree as deleted: ready ones stay ready for a restore, unfinished ones are cancelled.

    ``tree``: id and ancestor of every folder, itself included.
    """
    under = tree.where(F.col("ancestor") == top).select(F.col("id").alias("folder_id")).distinct().withColumn("_under", F.lit(True))
    status = F.when(~F.col("granted"), "not_granted").when(F.col("current_revision").isNotNull(), "ready").when(F.col("status").isin("queued", "running"), "cancelled").otherwise(F.col("status"))
    return update_from(files, under, ["folder_id"], {"status": status, "is_deleted": F.lit(True)})


def restored(files: DataFrame, tree: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(files, jobs) after a folder's subtree comes back from the trash.

    Files that are ready as they were need nothing; granted ones without a current revision are queued again, a new revision
    each, with a row of jobs (file_id, revision, state, attempts); files without access come back without any.
    """
    under = tree.where(F.col("ancestor") == top).select(F.col("id").alias("folder_id")).distinct()
    again = files.join(under, "folder_id", "left_semi").where(F.col("is_deleted") & F.col("granted") & F.col("current_revision").isNull())
    jobs = again.select("file_id", (F.coalesce("desired_revision", F.lit(0)) + 1).alias("revision"), F.lit("queued").alias("state"), F.lit(0).alias("attempts"))
    waits = F.col("granted") & F.col("current_revision").isNull()
    status = F.when(~F.col("granted"), "not_granted").when(F.col("current_revision").isNotNull(), "ready").otherwise("queued")
    changes = {"status": status, "is_deleted": F.lit(False), "desired_revision": F.when(waits, F.coalesce("desired_revision", F.lit(0)) + 1).otherwise(F.col("desired_revision"))}
    return update_from(files, under, ["folder_id"], changes, F.col("is_deleted")), jobs


def finished(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Running jobs that ``done`` (keys, lease_owner, error_code) reports on as succeeded or failed, if the report holds the lease.

    A report of an older owner changes nothing; cancelled jobs stay cancelled.
    """
    reports = done.withColumnsRenamed({"lease_owner": "_owner", "error_code": "_error"})
    failed = F.col("_error").isNotNull()
    changes = {"state": F.when(failed, "failed").otherwise("succeeded"), "error_code": F.col("_error"), "lease_owner": F.lit(None)}
    return update_from(jobs, reports, keys, changes, (F.col("state") == "running") & F.col("cancelled_at").isNull() & (F.col("lease_owner") == F.col("_owner")))


def with_scope(chats: DataFrame, files: Column, column: str = "scope") -> DataFrame:
    """A map column with its key ``files`` set, others kept; a null map counts as empty."""
    old = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    return chats.withColumn(column, F.map_concat(F.map_filter(old, lambda k, v: k != "files"), F.create_map(F.lit("files"), files)))


def swap_embeddings(chunks: DataFrame, fresh: DataFrame, key: str, dim: int, column: str = "embedding") -> DataFrame:
    """Chunks with the vectors of ``fresh``, where every chunk has exactly one of ``dim`` finite components; else an error.

    The check is one aggregate; nothing is swapped in part.
    """
    ok = (F.size(column) == dim) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = fresh.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))
    bad = chunks.select(key).distinct().join(found, key, "left").where(~(F.coalesce("ok", F.lit(False)) & (F.col("n") == 1)))
    if not bad.isEmpty():
        raise ValueError(f"chunks without exactly one vector of {dim} components: swap refused")
    return chunks.drop(column).join(fresh.select(key, column), key)


def recoverable(jobs: DataFrame, code: str) -> DataFrame:
    """Failed jobs with exactly that error, queued again with no attempts; others as they are."""
    hit = (F.col("state") == "failed") & (F.col("error_code") == code)
    hit = F.coalesce(hit, F.lit(False))
    return jobs.withColumns({"state": F.when(hit, "queued").otherwise(F.col("state")), "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "error_code": F.when(~hit, F.col("error_code"))})
