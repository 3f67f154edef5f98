"""Sequential processors: each folds the ordered rows of a key with bounded state.

A batch run sorts rows by key within partitions and streams through them, so a
key of any length needs no more memory than its state; a streaming run keeps
the same state in the state store.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators.events import PREFIX, TYPES

# Admitted requests in a trailing window of seconds, streams at a time, seconds of a cached answer, and characters of text that are sent at once.
MOST, SECONDS, STREAMS, CACHE_SECONDS, FLUSH = 30, 60, 2, 30, 20


def fold(df: DataFrame, keys: list[str], order: list[Column], make: Callable, schema: str) -> DataFrame:
    """Rows of each key in order through a fresh processor.

    `make()` gives an object with `row(dict) -> list of dicts` and `end() -> list of dicts`;
    output rows carry the keys. Rows of a key lie in one partition, sorted; a
    null key is a key of its own, and null values reach the processor as None.
    """
    columns, made = df.columns, T.StructType.fromDDL(schema)
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    form = to_arrow_schema(made)
    places = [columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, processor, out = None, None, []

        def put(rows, key):
            out.extend(dict(zip(keys, key, strict=True)) | r for r in rows)

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = tuple(values[k] for k in places)
                if processor is None or now != key:
                    if processor is not None:
                        put(processor.end(), key)
                    key, processor = now, make()
                put(processor.row(dict(zip(columns, values, strict=True))), key)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=form)
                out.clear()
        if processor is not None:
            put(processor.end(), key)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=form)

    return sorted_rows.mapInArrow(run, made)


class Processor:
    """What all processors share: nothing at the end, and a snapshot of the named fields that JSON can hold."""

    fields: tuple[str, ...] = ()

    def end(self) -> list[dict]:
        return []

    def snapshot(self) -> dict:
        return {f: list(v) if isinstance(v := getattr(self, f), deque) else v for f in self.fields}

    def restore(self, state: dict) -> None:
        for f in self.fields:
            setattr(self, f, deque(state[f]) if isinstance(getattr(self, f), deque) else state[f])


class Limiter(Processor):
    """ST03: at most `most` admitted requests in the trailing seconds; rejected ones do not count."""

    fields = ("times",)

    def __init__(self, most: int = MOST, seconds: float = SECONDS, times=()):
        self.most, self.seconds, self.times = most, seconds, deque(times)

    def forget(self, t: float) -> None:
        while self.times and self.times[0] < t - self.seconds:
            self.times.popleft()

    def full(self) -> bool:
        return len(self.times) >= self.most

    def admit(self, t: float) -> bool:
        self.forget(t)
        if self.full():
            return False
        self.times.append(t)
        return True

    def row(self, r: dict) -> list[dict]:
        return [{"event_id": r["event_id"], "admitted": self.admit(r["t"])}]

class Admission(Processor):
    """ST04: a request is admitted if fewer than `most` were in the trailing seconds and fewer than `streams` are running; an admitted one runs until its end.

    Rows have `event_id`, `t` and `until`; a stream that ends at the time of a
    request is released before it.
    """

    def __init__(self, most: int = MOST, seconds: float = SECONDS, streams: int = STREAMS):
        self.limiter, self.streams, self.running = Limiter(most, seconds), streams, []

    def snapshot(self) -> dict:
        return {"times": list(self.limiter.times), "running": self.running}

    def restore(self, state: dict) -> None:
        self.limiter.times, self.running = deque(state["times"]), state["running"]

    def row(self, r: dict) -> list[dict]:
        while self.running and self.running[0] <= r["t"]:
            heapq.heappop(self.running)
        self.limiter.forget(r["t"])
        reason = "rate" if self.limiter.full() else "streams" if len(self.running) >= self.streams else None
        if reason is None:
            self.limiter.admit(r["t"])
            heapq.heappush(self.running, r["until"])
        return [{"event_id": r["event_id"], "admitted": reason is None, "reason": reason}]

class CachedReads(Processor):
    """ST10: reads through a cache that keeps an answer for some seconds from when it was fetched; a forced read always fetches.

    Rows have `event_id`, `t` and `force`.
    """

    fields = ("fetched",)

    def __init__(self, seconds: float = CACHE_SECONDS):
        self.seconds, self.fetched = seconds, None

    def row(self, r: dict) -> list[dict]:
        hit = not r["force"] and self.fetched is not None and r["t"] - self.fetched < self.seconds
        if not hit:
            self.fetched = r["t"]
        return [{"event_id": r["event_id"], "cached": hit}]

class LineBuffer(Processor):
    """TG11: whole lines of pushed chunks, stripped, without empty ones; what follows the last line's end waits and is never a line by itself."""

    fields = ("rest", "n")

    def __init__(self):
        self.rest, self.n = [], 0

    def row(self, r: dict) -> list[dict]:
        *whole, last = (r["chunk"] or "").split("\n")
        out = []
        for part in whole:
            line = ("".join(self.rest) + part).strip()
            self.rest = []
            if line:
                out.append({"k": self.n, "line": line})
                self.n += 1
        self.rest.append(last)
        return out

class SafeStream(Processor):
    """ST06: the frames that a guarded stream passes on, and what is kept of it.

    Rows have `seq`, `chunk`, `aborted` and `failed`. Events pass as they are,
    but a TEXT event becomes its text and a broken one is dropped; an abort or a
    failure ends the stream with an ERROR event and nothing is kept. At the end
    the answer is kept, or a SYSTEM_MESSAGE says that there is none.
    """

    fields = ("parts", "over")

    def __init__(self):
        self.parts, self.over = [], False

    @staticmethod
    def _event(kind: str, message: str) -> str:
        return PREFIX + json.dumps({"type": kind, "message": message}, separators=(",", ":")) + "\n"

    def row(self, r: dict) -> list[dict]:
        put = lambda kind, value: [{"seq": r["seq"], "kind": kind, "value": value}]
        if self.over:
            return []
        if r["aborted"] or r["failed"]:
            self.over = True
            return put("event", self._event("ERROR", "Generation aborted" if r["aborted"] else "Generation failed"))
        chunk = r["chunk"]
        if not chunk:
            return []
        if not chunk.startswith(PREFIX):
            self.parts.append(chunk)
            return put("text", chunk)
        try:
            event = json.loads(chunk[len(PREFIX) :])
            kind = event.get("type")
        except (ValueError, AttributeError):
            return []
        if kind != "TEXT":
            return put("event", chunk)
        self.parts.append(event.get("content") or "")
        return put("text", self.parts[-1])

    def end(self) -> list[dict]:
        if self.over:
            return []
        answer = "".join(self.parts).strip()
        if answer:
            return [{"seq": None, "kind": "kept", "value": answer}]
        return [{"seq": None, "kind": "event", "value": self._event("SYSTEM_MESSAGE", "Model produced no output")}]


class FrameParser(Processor):
    """ST05: text and event frames of pushed chunks; text waits until it looks whole, none is lost.

    An event may be split across chunks, its prefix may not.
    """

    fields = ("buffer", "text")

    def __init__(self):
        self.buffer = self.text = ""

    def push(self, chunk: str | None) -> list[tuple[str, str]]:
        pending, frames = self.buffer + (chunk or ""), []
        if not pending:
            return frames
        self.buffer = ""
        while PREFIX in pending:
            before, rest = pending.split(PREFIX, 1)
            if before:
                frames.append(("text", self.text + before))
                self.text = ""
            body, newline, pending = rest.partition("\n")
            if not newline:
                self.buffer = PREFIX + body
                return frames
            frames.append(("event" if self.is_event(PREFIX + body) else "text", PREFIX + body))
        self.text += pending
        if len(self.text) > FLUSH or self.text != (told := self.text.rstrip()) or told.endswith((".", ",", "!", "?")):
            frames.append(("text", self.text))
            self.text = ""
        return frames

    @staticmethod
    def is_event(line: str) -> bool:
        body = line.removeprefix(PREFIX).lstrip()
        try:
            return line.startswith(PREFIX) and body.startswith("{") and json.loads(body).get("type") in TYPES
        except ValueError:
            return False

    def flush(self) -> list[tuple[str, str]]:
        frames = [("text", t) for t in (self.text, self.buffer) if t]
        self.buffer = self.text = ""
        return frames

    def row(self, r: dict) -> list[dict]:
        return [{"seq": r["seq"], "kind": k, "value": v} for k, v in self.push(r["chunk"])]

    def end(self) -> list[dict]:
        return [{"seq": None, "kind": k, "value": v} for k, v in self.flush()]


class Jobs(Processor):
    """ST07: the job of a session: waiting for metadata, processing, ready or error; events that its state forbids are rejected."""

    fields = ("status", "missing", "job")

    def __init__(self):
        self.status, self.missing, self.job = None, [], None

    def row(self, r: dict) -> list[dict]:
        action, out = r["action"], []
        if action == "create":
            if self.status is not None:
                out.append({"seq": r["seq"], "job_id": self.job, "status": "ERROR", "accepted": True})
            self.missing = list(r["missing"]) if r["missing"] is not None else []
            self.job, self.status = r["job_id"], "WAIT_FOR_METADATA" if self.missing else "PROCESSING"
            return [*out, {"seq": r["seq"], "job_id": self.job, "status": self.status, "accepted": True}]
        ok = self.status is not None
        if action == "update":
            ok = self.status == "WAIT_FOR_METADATA"
            if ok:
                given = set(r["given"]) if r["given"] is not None else set()
                self.missing = [f for f in self.missing if f not in given]
                if not self.missing:
                    self.status = "PROCESSING"
        elif action == "ready":
            ok = self.status == "PROCESSING"
            self.status = "READY" if ok else self.status
        elif action == "error" and ok:
            self.status = "ERROR"
        elif action == "clear" and ok:
            out = [{"seq": r["seq"], "job_id": self.job, "status": None, "accepted": True}]
            self.status, self.missing, self.job = None, [], None
            return out
        return [{"seq": r["seq"], "job_id": self.job, "status": self.status, "accepted": ok}]

class AbortFlag(Processor):
    """ST02: a session's abort flag with a time to live: an abort sets it, a check that finds it renews it, a reset or `ttl` seconds without either drop it.

    Rows have `event_id`, `t` and `action`: abort, reset, or anything else, which is a check.
    """

    fields = ("until",)

    def __init__(self, ttl: float):
        self.ttl, self.until = ttl, None

    def row(self, r: dict) -> list[dict]:
        if r["action"] == "reset":
            self.until = None
            return []
        aborted = self.until is not None and r["t"] < self.until
        if r["action"] == "abort" or aborted:
            self.until = r["t"] + self.ttl
        else:
            self.until = None
        return [] if r["action"] == "abort" else [{"event_id": r["event_id"], "aborted": aborted}]


class LastState(Processor):
    """Another processor's state after its last row, as one row."""

    def __init__(self, of: Processor):
        self.of = of

    def row(self, r: dict) -> list[dict]:
        self.of.row(r)
        return []

    def end(self) -> list[dict]:
        return [self.of.snapshot()]


def limited_stream(requests: DataFrame, key: str = "session_id", most: int = MOST, seconds: int = SECONDS) -> DataFrame:
    """ST03 on a stream of (key, event_id, ts): admitted times are kept per key and expire when a key is silent."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(most, seconds, json.loads(state.get[0]) if state.exists else ())
        # only times and ids of a trigger's rows are held, to bring them in order
        rows = sorted(pair for batch in batches for pair in zip(batch["ts"].map(pd.Timestamp.timestamp), batch["event_id"], strict=True))
        admitted = [limiter.admit(t) for t, _ in rows]
        state.update((json.dumps(list(limiter.times)),))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield pd.DataFrame({key: k[0], "event_id": [i for _, i in rows], "admitted": admitted})

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint, admitted boolean", "times string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ttl_state_stream(writes: DataFrame, key: str = "session_id", seconds: int = 1800) -> DataFrame:
    """ST01 on a stream: event-time sessions of writes less than the TTL apart, closed by the watermark."""
    from pyspark.sql import functions as F

    sessions = writes.withWatermark("ts", "1 hour").groupBy(key, F.session_window("ts", f"{seconds} seconds").alias("w"))
    return sessions.agg(F.count(F.lit(1)).alias("writes")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("expires"), "writes")


def token_stream(messages: DataFrame) -> DataFrame:
    """AG15 on a stream of (session_id, ts, content): estimated tokens by hour."""
    from pyspark.sql import functions as F

    from paperloom.functions.text import estimate_tokens

    hours = messages.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "session_id")
    return hours.agg(F.sum(estimate_tokens(F.col("content"))).alias("tokens")).select(F.col("w.start").alias("hour"), "session_id", "tokens")
