"""Processors on streams: one adapter that keeps any processor of `processors` in the state store, and what needs more than that.

Rows of a trigger are taken in their order within the trigger; a key's processor
goes on from its snapshot in the next trigger. Streams need the RocksDB state
store (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.operators.confidence import statistics_of
from paperloom.sources.store import guarded
from paperloom.streaming.processors import AbortFlag, Jobs, LastState, fold


class Fold(StatefulProcessor):
    """A processor per key, kept as its snapshot; a key's end comes with a row whose `ends` column is true, or when the key has been quiet."""

    def __init__(self, keys: list[str], order: list[str], make: Callable, names: list[str], ends: str | None, quiet: int | None, ttl: int | None):
        self.keys, self.order, self.make, self.names, self.ends, self.quiet, self.ttl = keys, order, make, names, ends, quiet, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("snapshot", "snapshot string", self.ttl)

    def _rows(self, key, rows: list[dict]) -> Iterator[Row]:
        own = dict(zip(self.keys, key, strict=True))
        for r in rows:
            yield Row(**{c: (own | r).get(c) for c in self.names})

    def _restored(self):
        processor = self.make()
        if self.state.exists():
            processor.restore(json.loads(self.state.get()[0]))
        return processor

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        processor, out, open_ = self._restored(), [], self.state.exists()
        for r in sorted((r.asDict() for r in rows), key=lambda r: tuple(r[c] for c in self.order)):  # the rows of one trigger
            out += processor.row(r)
            open_ = True
            if self.ends and r[self.ends]:
                out += processor.end()
                processor, open_ = self.make(), False
        if open_:
            self.state.update((json.dumps(processor.snapshot()),))
        else:
            self.state.clear()
        if self.quiet is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if open_:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.quiet)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out = self._restored().end() if self.state.exists() else []
        self.state.clear()
        yield from self._rows(key, out)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """A key's stored state: the columns of the processor's snapshot."""
        processor = self.make()
        processor.restore({f: initialState[f] for f in processor.snapshot()})
        self.state.update((json.dumps(processor.snapshot()),))

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], make: Callable, schema: str, ends: str | None = None, quiet: int | None = None, ttl: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """`processors.fold` on a stream: ST05, ST06, ST07, ST10 and TG11, as the batch fold gives them, however the stream is cut into triggers.

    A key ends with a row whose column `ends` is true, or, with `quiet`, that
    many seconds after its last row; after that it begins anew. With `ttl` the
    state goes after that many milliseconds without a row, without an end.
    `initial` has one row of stored state for a key, by the names of the
    processor's snapshot. Rows that come in a later trigger than rows behind
    them are taken when they come. A null key is no key of a stream: its rows
    are passed over.
    """
    made = T.StructType.fromDDL(schema)
    known = rows
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    processor = Fold(keys, order, make, made.names, ends, quiet, ttl)
    stored = initial.groupBy(*keys) if initial is not None else None
    clock = "None" if quiet is None and ttl is None else "ProcessingTime"
    return known.groupBy(*keys).transformWithState(processor, made, "append", clock, stored)


def job_stream(events: DataFrame, stored: DataFrame | None = None, key: str = "session_id") -> DataFrame:
    """ST07/ST11 on a stream: job events through the job machine, which goes on from stored jobs.

    Stored jobs are (session_id, status, missing, job), one row a session, as a
    batch leaves them (`last_jobs`).
    """
    kind = events.schema[key].dataType.simpleString()
    return fold_stream(events, [key], ["seq"], Jobs, f"{key} {kind}, seq bigint, job_id string, status string, accepted boolean", initial=stored)


def last_jobs(events: DataFrame, key: str = "session_id") -> DataFrame:
    """The state in which job events leave each session's job: (session_id, status, missing, job)."""
    kind = events.schema[key].dataType.simpleString()
    return fold(events, [key], [F.col("seq")], lambda: LastState(Jobs()), f"{key} {kind}, status string, missing array<string>, job string")


class AbortState(StatefulProcessor):
    """A session's abort flag as a value with a time to live: set by an abort, renewed by a positive check, gone by a reset or with time."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the event's own time decides; the store's clock only removes flags that no row asks about any more
        self.until = handle.getValueState("until", "until double", int(self.ttl * 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        flag = AbortFlag(self.ttl)
        if self.until.exists():
            flag.until = self.until.get()[0]
        out = [f for r in sorted(rows, key=lambda r: (r.t, r.event_id)) for f in flag.row(r.asDict())]
        if flag.until is None:
            self.until.clear()
        else:
            self.until.update((float(flag.until),))
        for f in out:
            yield Row(session_id=key[0], **f)

    def close(self) -> None:
        pass


def abort_stream(events: DataFrame, ttl: int) -> DataFrame:
    """ST02 on a stream of (session_id, event_id, t, action): whether a session is aborted at each of its checks.

    `action` is abort, reset or anything else, which is a check. Flags live
    `ttl` seconds of the events' own time after the abort or the last check that
    found them; the state store drops flags that are quiet for as long.
    """
    kind = events.schema["session_id"].dataType.simpleString()
    known = events.filter(F.col("session_id").isNotNull())
    return known.groupBy("session_id").transformWithState(AbortState(ttl), f"session_id {kind}, event_id bigint, aborted boolean", "append", "ProcessingTime")


def requests_with_aborts(requests: DataFrame, aborts: DataFrame, within: str, late: str | None = None) -> DataFrame:
    """ST06 with ST02: every request (session_id, event_id, ts) with each abort (session_id, ts) of its session from then on `within` an interval, or none.

    The join is an outer one; on streams both sides have a watermark of `late`,
    so a request without an abort is given out once no abort can come for it,
    and rows that are later than that are passed over. On tables it is the same
    join without watermarks.
    """
    left, right = requests.select("session_id", "event_id", "ts"), aborts.select(F.col("session_id").alias("abort_session"), F.col("ts").alias("aborted_at"))
    if late is not None:
        left, right = left.withWatermark("ts", late), right.withWatermark("aborted_at", late)
    on = F.expr(f"session_id = abort_session AND aborted_at >= ts AND aborted_at <= ts + INTERVAL {within}")
    return left.join(right, on, "left_outer").select("session_id", "event_id", "ts", "aborted_at")


def stats_stream(chunks: DataFrame, late: str, within: str) -> DataFrame:
    """AG05–AG08 on a stream of (query_id, rank, section, chunk_type, score, created_at): one statistics row a query.

    A query's rows fall in one window of length `within`; what is kept of it is
    one entry for each type and section, with its first rank, and comes out when
    the watermark has passed the window. Two sums follow one another, the second
    over the first one's windows, as in the batch form.
    """
    watched = chunks.withWatermark("created_at", late)
    few = watched.groupBy(F.window("created_at", within).alias("span"), "query_id", "chunk_type", "section").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.sum("score").alias("total"), F.count("score").alias("scored"), F.max("score").alias("max_score")
    )
    return statistics_of(few, "span", "query_id").drop("span")


class BatchLog:
    """IO09/IO10: a `foreachBatch` sink for telemetry that never raises and keeps every batch once.

    A batch's rows go to a partition of its own (`batch_id`), which a replay
    overwrites with the same rows; the ledger beside them says which batches are
    done, so that a replay of a done one is a no-op. Rows that lack a required
    value are passed over. A batch that fails is told to the ledger with its
    error, if that can be written, and to `report`.
    """

    def __init__(self, path: str, *required: str, report: Callable[[int, str], None] | None = None):
        self.path, self.required, self.report = path.rstrip("/"), required, report

    def ledger(self, spark) -> DataFrame:
        """(batch_id, error) of all batches so far; error is null where it was kept."""
        return spark.read.schema("batch_id bigint, error string").parquet(f"{self.path}/ledger")

    def rows(self, spark) -> DataFrame:
        """The rows that are kept, with their batch_id."""
        return spark.read.parquet(f"{self.path}/rows")

    def _done(self, spark, batch_id: int) -> bool:
        try:
            return not self.ledger(spark).filter((F.col("batch_id") == batch_id) & F.col("error").isNull()).isEmpty()
        except AnalysisException:  # no ledger yet
            return False

    def _tell(self, spark, batch_id: int, error: str | None) -> None:
        spark.createDataFrame([(batch_id, error)], "batch_id bigint, error string").coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            if self._done(spark, batch_id):
                return
            kept = guarded(batch, *self.required).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.path}/rows")
            self._tell(spark, batch_id, None)
        except Exception as failure:  # telemetry must not break its stream
            message = str(failure).split("\n")[0][:500]
            if self.report is not None:
                self.report(batch_id, message)
            try:
                self._tell(spark, batch_id, message)
            except Exception:  # the report above has it
                return


def as_check(kind: Column, sets: str, resets: str) -> Column:
    """ST02: events as actions: abort, reset, or check."""
    return F.when(kind == sets, "abort").when(kind == resets, "reset").otherwise("check")
