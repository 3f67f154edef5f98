"""Chat history, keyed state and control streams as ordered-window operators over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators.scan import Scan


def clamp(n: int, most: int) -> int:
    """TK08: a requested count between 1 and a cap."""
    return max(1, min(n, most))


def clamped(n: Column, most: int) -> Column:
    """TK08: requested counts, one in each row, between 1 and a cap."""
    return F.greatest(F.lit(1), F.least(n, F.lit(most)))


def numbered(df: DataFrame, keys: list[str], *order: Column, name: str = "n") -> DataFrame:
    """Rows numbered from 1 within their key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_messages(messages: DataFrame, n: int) -> DataFrame:
    """WN06: the first n messages of each session (1 to 200)."""
    return numbered(messages, ["session_id"], F.col("turn")).filter(F.col("n") <= clamp(n, 200))


def last_user_messages(messages: DataFrame, n: int) -> DataFrame:
    """WN07: the last n user messages of each session (1 to 20), numbered in time."""
    last = numbered(messages.filter("role = 'user'"), ["session_id"], F.col("turn").desc(), name="back").filter(F.col("back") <= clamp(n, 20))
    return numbered(last.drop("back"), ["session_id"], F.col("turn"))


def history_tail(messages: DataFrame, n: int = 4) -> DataFrame:
    """WN08: the last n turns of each session, every role but the user's as assistant."""
    last = numbered(messages, ["session_id"], F.col("turn").desc(), name="back").filter(F.col("back") <= n).drop("back")
    return last.withColumn("role", F.when(F.col("role") == "user", "user").otherwise("assistant"))


def rewrite_bases(messages: DataFrame, among: int = 3) -> DataFrame:
    """WN09: for each user message the latest telling one among the `among` user messages before it."""
    content = X.strip(F.col("content"))
    telling = (content != "") & ~F.lower(content).isin(*X.NON_INFORMATIVE) & ~X.is_vague(content)
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-among, -1)
    return messages.filter("role = 'user'").withColumn("base", F.last(F.when(telling, content), ignorenulls=True).over(w))


def epochs(rows: DataFrame, key: str, topic: str, *order: str, cut: int | None = None) -> DataFrame:
    """WN10: rows with the number of topic changes before them; what a session has used counts within one epoch. With `cut`, longer sessions are scanned in segments."""
    scan = Scan(rows, key, list(order), cut).lag(before=F.col(topic))
    return scan.sum("epoch", F.coalesce((F.col("before") != F.col(topic)).cast("int"), F.lit(0))).result().drop("before")


def latest(rows: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """WN11: the last row of each key (upsert, latest wins), by columns that order a key's rows.

    An aggregate, so each task passes on one row per key and a busy key costs no more.
    """
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("row")).select(*keys, "row.*")


def trailing_count(rows: DataFrame, key: str, seconds: int, time: str = "ts") -> DataFrame:
    """WN12: rows of the same key in the trailing seconds, the row itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(time).cast("timestamp"))).rangeBetween(-seconds, 0)
    return rows.withColumn("recent", F.count(F.lit(1)).over(w))


def ttl_sessions(rows: DataFrame, key: str, seconds: int, time: str = "ts", cut: int | None = None) -> DataFrame:
    """ST01: spans in which keyed state stays alive: writes that are less than the TTL apart, with their count. With `cut`, keys of more writes are scanned in segments."""
    scan = Scan(rows.select(key, time), key, [time], cut).lag(before=F.col(time))
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    spans = scan.sum("span", F.coalesce((gap >= seconds * 1_000_000).cast("int"), F.lit(1))).result()
    return spans.groupBy(key, "span").agg(F.min(time).alias("begin"), F.max(time).alias("last_write"), F.count(F.lit(1)).alias("writes"))


def abort_flags(rows: DataFrame, key: str, time: str, kind: str, sets: str, resets: str, *order: Column) -> DataFrame:
    """ST02: whether a session is aborted at each of its other events: its last control event before sets the flag."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(kind).isin(sets, resets), F.col(kind)), ignorenulls=True).over(w)
    return rows.withColumn("aborted", F.coalesce(last == sets, F.lit(False))).filter(~F.col(kind).isin(sets, resets))


def kept_messages(rows: DataFrame, key: str, kind: str, sets: str, resets: str, assistant: str, *order: Column) -> DataFrame:
    """MU01: the messages that are kept: all but control events and an assistant's messages while its session is aborted."""
    seen = abort_flags(rows, key, "ts", kind, sets, resets, *order)
    return seen.filter(~((F.col(kind) == assistant) & F.col("aborted"))).drop("aborted")


def chat_search(messages: DataFrame, titles: DataFrame, text: str) -> DataFrame:
    """FL12: the non-empty chats whose title contains a text, or a message of theirs that is not the system's."""
    wanted = text.lower()
    said = messages.groupBy("session_id").agg(F.max((F.col("role") != "system") & F.lower("content").contains(wanted)).alias("said"))
    named = F.coalesce(F.lower("title").contains(wanted), F.lit(False))
    return said.join(titles.select("session_id", "title"), "session_id", "left").filter(F.coalesce("said", F.lit(False)) | named).select("session_id")


#: The steps of a job's progress, while metadata is asked for and in a whole run.
PROGRESS = ((5, 15, 20), (5, 30, 45, 60, 80, 95, 100))


def progress_steps(rows: DataFrame, key: str, progress: str, *order: Column) -> DataFrame:
    """ST08: rows with `regular`: whether a job's progress is the first step, or follows the one before in one of the fixed sequences."""
    pairs = sorted({p for steps in PROGRESS for p in zip(steps, steps[1:], strict=False)})
    before = F.lag(progress).over(Window.partitionBy(key).orderBy(*order))
    follows = F.lit(False)
    for a, b in pairs:
        follows = follows | ((before == a) & (F.col(progress) == b))
    return rows.withColumn("regular", F.when(before.isNull(), F.col(progress) == PROGRESS[0][0]).otherwise(follows))


def concurrency(rows: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """ST04: the most intervals of a key that overlap (an end at the same time comes first)."""
    marks = rows.select(key, F.col(begin).alias("at"), F.lit(1).alias("step")).unionByName(rows.select(key, F.col(end).alias("at"), F.lit(-1).alias("step")))
    w = Window.partitionBy(key).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("open", F.sum("step").over(w)).groupBy(key).agg(F.max("open").alias("most"))


def superseded(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """ST11: whether a later job of the same key replaced each job."""
    return rows.withColumn("superseded", F.lead(F.lit(1)).over(Window.partitionBy(key).orderBy(*order)).isNotNull())


def after_clears(rows: DataFrame, key: str, is_clear: Column, *order: Column) -> DataFrame:
    """ST12: the writes of each key behind its last clear."""
    w = Window.partitionBy(key).orderBy(*order)
    later = F.max(is_clear.cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("cleared", later == 1).filter(~F.col("cleared")).drop("cleared")
