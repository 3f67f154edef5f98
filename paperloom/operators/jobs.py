"""Ingest jobs of sessions: states, the active document, routes, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import memory as M

# Where a chat turn goes by the state of its session's job; without a job it is plain chat.
ROUTES = {"WAIT_FOR_METADATA": "request_metadata", "PROCESSING": "processing", "ERROR": "failed", "READY": "retrieve"}
PLAIN = "plain_chat"


def latest_status(rows: DataFrame, key: str, status: str, *by: str) -> DataFrame:
    """The last state of each session that has one."""
    return rows.filter(F.col(status).isNotNull()).groupBy(key).agg(F.max_by(status, F.struct(*by)).alias(status))


def status_summary(states: DataFrame, status: str = "status") -> DataFrame:
    """PJ09: jobs by state."""
    return states.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def active_document(sessions: DataFrame, states: DataFrame, stored: DataFrame, key: str = "session_id") -> DataFrame:
    """JN04: each session's state and document: the job's, or READY where only a document is stored."""
    both = sessions.join(states, key, "left").join(stored, key, "left")
    return both.select(key, F.coalesce("status", F.when(F.col("document").isNotNull(), "READY")).alias("status"), "document")


def resolve_jobs(asks: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN05: asks (identifier, ...) with the job of that id, or else the last job (by event_id) of that session."""
    by_id = jobs.select(F.col("job_id").alias("identifier"), F.col("job_id").alias("own"))
    by_session = jobs.groupBy(F.col("session_id").cast("string").alias("identifier")).agg(F.max_by("job_id", "event_id").alias("bound"))
    return asks.join(by_id, "identifier", "left").join(by_session, "identifier", "left").withColumn("job_id", F.coalesce("own", "bound")).drop("own", "bound")


def routed(rows: DataFrame, key: str, status: Column, *order: str) -> DataFrame:
    """ST09: rows with `route`, by the last state of their session at or before them."""
    now = F.last(status, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    route = F.element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), now)
    return rows.withColumn("route", F.coalesce(route, F.lit(PLAIN)))


def active_bindings(rows: DataFrame, key: str, is_clear: Column, *by: str) -> DataFrame:
    """MU03: the last binding of each session; a session whose last row clears it has none."""
    return M.latest(rows.withColumn("clears", is_clear), [key], *by).filter(~F.col("clears")).drop("clears")


def last_metadata(rows: DataFrame, key: str, metadata: Column, by: str) -> DataFrame:
    """TG07: the metadata of each session's last update."""
    return rows.groupBy(key).agg(F.max_by(metadata, by).alias("metadata"))


def debug_snapshot(stored: Column, schema: str) -> Column:
    """TG09: a saved snapshot read back; all fields are null where the text is broken."""
    return F.from_json(stored, schema, {"mode": "PERMISSIVE"})
