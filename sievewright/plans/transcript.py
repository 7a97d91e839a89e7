"""Transcript pruning: system messages, recent turns and what tools link to them stay; older ones as the budget allows.

A message is a row: conv_id, index (dense from 0, in order), role, text, tokens, tool_call_ids, tool_result_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators.relevance import greedy_keep

KEY = "conv_id"


def messages_from_table(conversations: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text), without tool ids."""
    none = F.array().cast("array<string>")
    index = F.row_number().over(W.partitionBy(KEY).orderBy("turn")) - 1
    return conversations.select(KEY, index.alias("index"), "role", F.coalesce("text", F.lit("")).alias("text"), estimate_tokens("text").alias("tokens"), none.alias("tool_call_ids"), none.alias("tool_result_ids"))


def group_turns(messages: DataFrame) -> DataFrame:
    """Adds turn_id: 0 before the first user message, then one more at each; null for system messages."""
    order = W.partitionBy(KEY).orderBy("index").rowsBetween(W.unboundedPreceding, 0)
    asked = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order)
    return messages.withColumn("turn_id", F.when(F.coalesce(F.col("role") != "system", F.lit(True)), asked).cast("int"))


def recent_window(messages: DataFrame, recent_turns: int = 2) -> DataFrame:
    """Adds turn_id and recent: whether the message is of the last ``recent_turns`` turns."""
    last = F.max("turn_id").over(W.partitionBy(KEY))
    return group_turns(messages).withColumn("recent", F.coalesce(F.col("turn_id") > last - max(recent_turns, 0), F.lit(False)))


def tool_groups(messages: DataFrame) -> DataFrame:
    """(conv_id, index, group_id): messages that share an id, of a call or a result, are linked, also through others.

    group_id is the smallest index of a group; messages without shared ids are groups of their own.
    """
    ids = messages.select(KEY, "index", F.explode(F.array_distinct(F.concat("tool_call_ids", "tool_result_ids"))).alias("id")).where("id <> ''")
    shared = ids.groupBy(KEY, "id").agg(F.array_sort(F.collect_set("index")).alias("members")).where(F.size("members") > 1)

    def merge(groups: Column, s: Column) -> Column:
        apart = F.filter(groups, lambda g: ~F.arrays_overlap(g, s))
        joined = F.array_distinct(F.concat(F.flatten(F.filter(groups, lambda g: F.arrays_overlap(g, s))), s))
        return F.concat(apart, F.array(joined))

    merged = shared.groupBy(KEY).agg(F.aggregate(F.array_sort(F.collect_set("members")), F.array().cast("array<array<int>>"), merge).alias("groups"))
    linked = merged.select(KEY, F.explode("groups").alias("g")).select(KEY, F.array_min("g").alias("group_id"), F.explode("g").alias("index"))
    return messages.select(KEY, "index").join(linked, [KEY, "index"], "left").select(KEY, "index", F.coalesce("group_id", "index").alias("group_id"))


def mark_kept(messages: DataFrame, budget: int, recent_turns: int = 2) -> DataFrame:
    """Adds recent, protected (system or recent), mandatory and kept to the messages."""
    m = recent_window(messages, recent_turns).join(tool_groups(messages), [KEY, "index"])
    m = m.withColumn("protected", F.col("recent") | F.coalesce(F.col("role") == "system", F.lit(False)))
    m = m.withColumn("mandatory", F.max("protected").over(W.partitionBy(KEY, "group_id")))
    used = F.sum(F.when(F.col("mandatory"), F.col("tokens")).otherwise(0))
    groups = m.where("not mandatory").groupBy(KEY, "group_id").agg(F.max("index").alias("last"), F.sum("tokens").alias("cost"))
    items = groups.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("last")).alias("order"), F.col("group_id").alias("place"), "cost"))).alias("items"))
    left = m.groupBy(KEY).agg((F.lit(budget) - used).alias("room")).join(items, KEY)
    taken = left.select(KEY, F.explode(greedy_keep(F.col("items"), F.col("room"))).alias("group_id"), F.lit(True).alias("taken"))
    return m.join(taken, [KEY, "group_id"], "left").withColumn("kept", F.col("mandatory") | F.coalesce("taken", F.lit(False))).drop("taken")


def marker_text(n: Column) -> Column:
    return F.format_string("[%d earlier messages elided]", n)


def prune_messages(messages: DataFrame, budget: int, recent_turns: int = 2, marker: bool = True) -> DataFrame:
    """(conv_id, position, index, role, text, tokens): the messages that stay, in order, and a system message (index
    -1) in place of each run of others. The budget isn't a promise: what is mandatory stays, markers aren't charged."""
    return _emitted(mark_kept(messages, budget, recent_turns), marker)


def _emitted(marked: DataFrame, marker: bool) -> DataFrame:
    order = W.partitionBy(KEY).orderBy("index")
    run = F.sum(F.col("kept").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    kept = marked.where("kept").select(KEY, F.col("index").alias("at"), "index", "role", "text", "tokens")
    if marker:
        gone = marked.select(KEY, "index", "kept", run.alias("run")).where("not kept").groupBy(KEY, "run").agg(F.min("index").alias("at"), F.count(F.lit(1)).alias("n"))
        notes = gone.select(KEY, "at", F.lit(-1).alias("index"), F.lit("system").alias("role"), marker_text(F.col("n")).alias("text"))
        kept = kept.unionByName(notes.withColumn("tokens", estimate_tokens("text")))
    position = F.row_number().over(W.partitionBy(KEY).orderBy("at")) - 1
    return kept.select(KEY, position.alias("position"), "index", "role", "text", "tokens")


def pinned_tool_results(marked: DataFrame) -> DataFrame:
    """(conv_id, pinned): sorted ids of kept messages that are neither system nor recent."""
    ids = marked.where("kept and not protected").select(KEY, F.explode(F.concat("tool_call_ids", "tool_result_ids")).alias("id")).where("id <> ''")
    return ids.groupBy(KEY).agg(F.array_sort(F.collect_set("id")).alias("pinned"))


def prune_summary(messages: DataFrame, budget: int, recent_turns: int = 2, marker: bool = True) -> DataFrame:
    """(conv_id, original_tokens, final_tokens, messages_in, messages_out, pinned_tool_results, notes)."""
    marked = mark_kept(messages, budget, recent_turns)
    totals = marked.groupBy(KEY).agg(
        F.sum("tokens").cast("int").alias("original_tokens"),
        F.count(F.lit(1)).cast("int").alias("messages_in"),
        F.count_if(F.col("kept") & ~F.col("mandatory")).alias("added"),
        F.count_if(~F.col("kept")).alias("dropped"),
    )
    sent = _emitted(marked, marker).groupBy(KEY).agg(F.sum("tokens").cast("int").alias("final_tokens"), F.count(F.lit(1)).cast("int").alias("messages_out"))
    out = totals.join(sent, KEY, "left").join(pinned_tool_results(marked), KEY, "left")
    pinned = F.coalesce("pinned", F.array().cast("array<string>"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("added") > 0, F.format_string("kept %d older message(s) outside the recent window", "added")),
            F.when(F.size(pinned) > 0, F.concat(F.lit("pinned "), F.size(pinned), F.lit(" tool result(s) linked across the recent window"))),
            F.when(F.col("dropped") > 0, F.format_string("dropped %d message(s) outside the kept window", "dropped")),
        )
    )
    zero = F.lit(0)
    return out.select(KEY, "original_tokens", F.coalesce("final_tokens", zero).alias("final_tokens"), "messages_in", F.coalesce("messages_out", zero).alias("messages_out"), pinned.alias("pinned_tool_results"), notes.alias("notes"))
