"""Relational questions around a library: trees, usage, sessions, queues, turns and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tree_paths(nodes: DataFrame, deepest: int = 200) -> DataFrame:
    """(id, ancestor, path): every node with each of its ancestors, itself included, and its path of names.

    ``nodes`` has id, parent_id and name. Jumps of 1, 2, 4, ... levels are joined until none is left, so there are as many
    joins as the depth has binary digits; a tree deeper than about ``deepest``, as one with a cycle is, is an error.
    """
    jump = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("up"), F.col("name").alias("path"))
    jump = jump.join(nodes.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up", "path")
    out, levels = nodes.select("id", F.col("id").alias("ancestor"), F.col("name").alias("path"), F.lit(0).alias("_far")), 1
    while not jump.isEmpty():
        if levels > deepest:
            raise ValueError(f"nodes below themselves, or more than {deepest} levels")
        over = jump.select("id", F.col("up").alias("_at"), F.col("path").alias("_below"))
        further = lambda df, at: df.withColumnRenamed("id", "_at").join(over, "_at").withColumn("path", F.concat_ws("/", "path", "_below")).select("id", at, "path", *(["_far"] if "_far" in df.columns else []))  # noqa: B023, E731
        out = out.unionByName(further(out, "ancestor").withColumn("_far", F.col("_far") + levels))
        jump, levels = further(jump, "up"), 2 * levels
    longest = F.max_by("path", "_far").over(Window.partitionBy("id"))
    return out.select("id", "ancestor", longest.alias("path"))


def tree_rollup(nodes: DataFrame, leaves: DataFrame, at: str, size: str, deepest: int = 200) -> DataFrame:
    """(id, n_items, total_size) over each node's whole subtree; nodes without items count 0.

    Items are summed by their own node first, so the walk up handles one row for each node, not for each item.
    """
    own = leaves.groupBy(F.col(at).alias("id")).agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    up = tree_paths(nodes, deepest).select("id", "ancestor").join(own, "id", "left")
    return up.groupBy(F.col("ancestor").alias("id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("total_size"))


def sessions(events: DataFrame, user: str, at: str, idle: str) -> DataFrame:
    """(user, started, last_seen, n_events) of each stretch of activity without an idle gap."""
    gap = F.session_window(F.col(at), idle)
    return events.groupBy(user, gap.alias("_s")).agg(F.min(at).alias("started"), F.max(at).alias("last_seen"), F.count("*").alias("n_events")).drop("_s")


def with_reply(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """User turns that a later assistant turn of the conversation follows."""
    last = turns.where(F.col(role) == "assistant").groupBy(conv).agg(F.max(turn).alias("_last"))
    return turns.where(F.col(role) == "user").join(last, conv).where(F.col(turn) < F.col("_last")).drop("_last")


def paired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """User turns whose next turn is the assistant's, and assistant turns whose previous is a user's."""
    w = Window.partitionBy(conv).orderBy(turn)
    pair = ((F.col(role) == "user") & (F.lead(role).over(w) == "assistant")) | ((F.col(role) == "assistant") & (F.lag(role).over(w) == "user"))
    return turns.withColumn("_pair", pair).where("_pair").drop("_pair")


def history_budget(turns: DataFrame, chars: int, messages: int, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The newest messages of each conversation up to both budgets; of the last one that fits only its tail stays."""
    newest = Window.partitionBy(conv).orderBy(F.desc(turn))
    before = F.coalesce(F.sum(F.length(text)).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = turns.withColumn("_n", F.row_number().over(newest)).withColumn("_left", F.lit(chars) - before).where((F.col("_n") <= messages) & (F.col("_left") > 0))
    return kept.withColumn(text, F.when(F.length(text) > F.col("_left"), F.expr(f"right({text}, cast(_left as int))")).otherwise(F.col(text))).drop("_n", "_left")


def page_with_total(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page in the given order, each row with the number of all rows; the count is its own aggregate."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total))


def fold_states(changes: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Changes of state with their predecessor and whether the transition is allowed; a first state always is."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    moves = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    seen = changes.withColumn("previous", before)
    return seen.withColumn("valid", F.col("previous").isNull() | F.array_contains(moves, F.concat_ws(">", "previous", state)))


def queue_order(jobs: DataFrame, order: list, n: int) -> DataFrame:
    """The first n jobs in order of claim, numbered."""
    head = jobs.orderBy(*order).limit(n)
    return head.withColumn("position", F.row_number().over(Window.orderBy(*order)))
