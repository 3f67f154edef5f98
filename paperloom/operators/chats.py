"""Chats of a client: stored chats, titles, counts, edits, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import memory as M

CHAT = "id bigint, title string, model string, pinned boolean, messages array<struct<role:string,content:string>>"


def stored_chats(json: Column) -> Column:
    """IO13: a stored chat read back, with defaults; null where the text is broken or has no id."""
    chat = F.from_json(json, CHAT)
    full = F.struct(
        chat["id"].alias("id"), F.coalesce(chat["title"], F.lit("")).alias("title"), F.coalesce(chat["model"], F.lit("base")).alias("model"),
        F.coalesce(chat["pinned"], F.lit(False)).alias("pinned"), chat["messages"].alias("messages"),
    )
    return F.when(chat["id"].isNotNull(), full)


def title_messages(messages: DataFrame) -> DataFrame:
    """WN14: the first user message of each session, from which its title is made."""
    return M.numbered(messages.filter("role = 'user'"), ["session_id"], F.col("turn")).filter("n = 1").drop("n")


def marked_last(messages: DataFrame, role: str = "assistant") -> DataFrame:
    """WN15: messages with `is_last`: whether they are their session's last of a role."""
    last = F.max(F.when(F.col("role") == role, F.col("turn"))).over(Window.partitionBy("session_id"))
    return messages.withColumn("is_last", F.when(F.col("role") == role, F.col("turn") == last).otherwise(False))


def last_user_texts(messages: DataFrame, n: int = 3) -> DataFrame:
    """FL11: the last n user texts of each session in one text, in time."""
    few = M.last_user_messages(messages, n)
    return few.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda m: m.content), "\n").alias("texts"))


def session_counts(messages: DataFrame) -> DataFrame:
    """AG17: messages and roles of each session."""
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), F.countDistinct("role").alias("n_roles"))


def durations(rows: DataFrame, key: str = "session_id", time: str = "ts") -> DataFrame:
    """AG16: milliseconds from the first to the last row of each key."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return rows.groupBy(key).agg((ms(F.max(time)) - ms(F.min(time))).alias("duration_ms"))


def normalised(role: Column, status: Column, content: Column) -> tuple[Column, Column, Column]:
    """PJ06: role, status and content of a stored message: a message that was being written is done."""
    done = F.when(status.isin("typing", "streaming"), "done").otherwise(F.coalesce(status, F.lit("done")))
    return F.coalesce(role, F.lit("assistant")), done, F.coalesce(content, F.lit(""))


def edited(chats: DataFrame, titles: Column, pinned: Column, deleted: Column) -> DataFrame:
    """MU05: chats (id) after deletions, with their titles (a default where none is given) and pins."""
    kept = chats.filter(~F.coalesce(deleted, F.lit(False)))
    return kept.select("id", F.coalesce(titles, F.concat(F.lit("Chat "), F.col("id").cast("string"))).alias("title"), F.coalesce(pinned, F.lit(False)).alias("pinned"))
