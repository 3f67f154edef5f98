"""Streams cut into triggers against batch folds, plain clocks and batch statistics."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import confidence as K
from paperloom.operators.events import PREFIX
from paperloom.streaming import processors as P
from paperloom.streaming import stateful as S


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed(spark, tmp_path, parts, schema, plan, name, clock=False, wanted=0):
    """The rows of `plan` over a stream that reads one part in each trigger; with `clock`, until all is read and `wanted` rows are there."""
    source = tmp_path / "in"
    source.mkdir(parents=True)
    for k, part in enumerate(parts):
        path = source / f"{k:03d}.json"
        path.write_text("\n".join(map(json.dumps, part)))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in the order of their times
    stream = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    writer = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint"))
    if not clock:
        q = writer.trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        return spark.table(name).collect()
    q, total, until = writer.start(), sum(map(len, parts)), time.monotonic() + 240  # clocks keep such a stream going
    while time.monotonic() < until and (len(spark.table(name).collect()) < wanted or sum(p.numInputRows for p in q.recentProgress) < total):
        assert q.exception() is None
        time.sleep(0.5)
    q.stop()
    return spark.table(name).collect()


def cut(rows, n):
    return [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]


def test_frames_of_a_cut_stream(spark, tmp_path):
    """ST05: events and texts split across chunks and triggers; the stream closes with its last row."""
    rnd = random.Random(5)
    rows = []
    for s in (1, 2, 3):
        event = PREFIX + json.dumps({"type": "PROGRESS", "value": 5}) + "\n"
        whole = "".join(rnd.choice(["some words ", "an end. ", event, "é", "more"]) for _ in range(60))
        at, seq = 0, 0
        while at < len(whole):
            to = at + rnd.randrange(1, 40)
            inside = [p for p in range(at, len(whole)) if whole.startswith(PREFIX, p) and p < to < p + len(PREFIX)]
            to = inside[0] + len(PREFIX) if inside else to  # a prefix is not split
            rows.append({"stream_id": s, "seq": seq, "chunk": whole[at:to], "last": to >= len(whole)})
            at, seq = to, seq + 1
    rows.sort(key=lambda r: (r["seq"], r["stream_id"]))
    schema, out = "stream_id bigint, seq bigint, chunk string, last boolean", "stream_id bigint, seq bigint, kind string, value string"
    got = streamed(spark, tmp_path, cut(rows, 4), schema, lambda df: S.fold_stream(df, ["stream_id"], ["seq"], P.FrameParser, out, ends="last"), "frames")
    want = P.fold(spark.createDataFrame([tuple(r.values()) for r in rows], schema), ["stream_id"], [F.col("seq")], P.FrameParser, out).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 30


def test_a_quiet_stream_ends(spark, tmp_path):
    """ST05: what a parser still holds comes out when its stream has been quiet, and a new row begins anew."""
    rows = [{"stream_id": s, "seq": k, "chunk": c} for s in (1, 2) for k, c in enumerate(["said", " and more"])]
    schema, out = "stream_id bigint, seq bigint, chunk string", "stream_id bigint, seq bigint, kind string, value string"
    got = streamed(spark, tmp_path, cut(rows, 2), schema, lambda df: S.fold_stream(df, ["stream_id"], ["seq"], P.FrameParser, out, quiet=2), "quiet", True, 2)
    assert sorted((r.stream_id, r.seq, r.kind, r.value) for r in got) == [(1, None, "text", "said and more"), (2, None, "text", "said and more")]


def test_snapshots_go_on_where_they_were():
    """Every processor, put away as JSON after each row, gives what it gives in one go."""
    rnd = random.Random(9)
    rows = [{"event_id": k, "seq": k, "t": float(k * 7), "until": k * 7.0 + 40, "force": k % 5 == 0, "chunk": rnd.choice(["a\n", "b c. ", None, PREFIX + '{"type":"SOURCES"}\n']), "aborted": k == 38, "failed": False} for k in range(40)]
    rows = [r | {"action": rnd.choice(["create", "update", "ready", "error", "clear", "abort", "reset"]), "job_id": f"j{r['seq']}", "missing": ["x"] if r["seq"] % 2 else None, "given": ["x"]} for r in rows]
    for make in (lambda: P.Limiter(3, 60), lambda: P.Admission(3, 60, 2), lambda: P.CachedReads(30), P.LineBuffer, P.SafeStream, P.FrameParser, P.Jobs, lambda: P.AbortFlag(50)):
        whole, parts, out = make(), make(), []
        want = [f for r in rows for f in whole.row(r)] + whole.end()
        for r in rows:
            again = make()
            again.restore(json.loads(json.dumps(parts.snapshot())))
            parts = again
            out += parts.row(r)
        assert out + parts.end() == want and want


def test_abort_flags_expire_and_are_renewed(spark, tmp_path):
    """ST02 against a plain clock: set, renewed by a positive check, expired, reset; flags live on across triggers."""
    rnd = random.Random(8)
    rows, t = [], 0.0
    for k in range(300):
        t += rnd.choice([1.0, 5.0, 30.0])
        rows.append({"session_id": f"s{k % 3}", "event_id": k, "t": t, "action": rnd.choice(["abort", "check", "check", "check", "check", "reset"])})
    until, want, renewed = {}, set(), 0
    for r in rows:
        s = r["session_id"]
        if r["action"] == "abort":
            until[s] = r["t"] + 60
        elif r["action"] == "reset":
            until.pop(s, None)
        else:
            alive = s in until and r["t"] < until[s]
            want.add((s, r["event_id"], alive))
            renewed += alive
            until[s] = r["t"] + 60 if alive else -1.0
    schema = "session_id string, event_id bigint, t double, action string"
    assert set(map(tuple, streamed(spark, tmp_path, cut(rows, 5), schema, lambda df: S.abort_stream(df, 60), "flags", True, len(want)))) == want and 20 < renewed < len(want) - 20
    batch = P.fold(spark.createDataFrame([tuple(r.values()) for r in rows], schema), ["session_id"], [F.col("t")], lambda: P.AbortFlag(60), "session_id string, event_id bigint, aborted boolean")
    assert set(map(tuple, batch.collect())) == want


def test_jobs_go_on_from_stored_ones(spark, tmp_path):
    """ST07/ST11: a batch, then a stream with the batch's last jobs as initial state, equals one batch over both."""
    rnd = random.Random(2)
    actions = ["create", "create", "update", "ready", "error", "clear"]
    rows = [{"session_id": k % 7, "seq": k, "job_id": f"job-{k}", "action": rnd.choice(actions), "missing": rnd.choice([None, [], ["title"], ["title", "revision"]]), "given": ["title"]} for k in range(200)]
    schema, out = "session_id bigint, seq bigint, job_id string, action string, missing array<string>, given array<string>", "session_id bigint, seq bigint, job_id string, status string, accepted boolean"
    table = lambda part: spark.createDataFrame([tuple(r.values()) for r in part], schema)
    run = lambda part: set(map(tuple, P.fold(table(part), ["session_id"], [F.col("seq")], P.Jobs, out).collect()))
    stored = S.last_jobs(table(rows[:90])).filter("session_id < 6")
    later = [r for r in rows[90:] if r["session_id"] < 6] + [{**r, "session_id": 99} for r in rows[90:110]]
    got = set(map(tuple, streamed(spark, tmp_path, cut(later, 3), schema, lambda df: S.job_stream(df, stored), "jobs")))
    whole = run([r for r in rows if r["session_id"] < 6])
    assert got == {r for r in whole if r[1] >= 90} | run([{**r, "session_id": 99} for r in rows[90:110]])


def test_requests_meet_aborts(spark, tmp_path):
    """An abort in time, one too late for its request, a request without any, and one that is given out only by the watermark."""
    at = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00"
    kinds = [("request", "a", 1, 0), ("abort", "a", 2, 5), ("request", "b", 3, 1), ("abort", "b", 4, 50), ("request", "c", 5, 2), ("request", "a", 6, 20), ("abort", "d", 7, 200), ("request", "d", 8, 200), ("request", "y", 12, 210)]
    rows = [{"kind": k, "session_id": s, "event_id": e, "ts": at(m)} for k, s, e, m in kinds]
    late = [{"kind": "abort", "session_id": "c", "event_id": 9, "ts": at(4)}, {"kind": "request", "session_id": "z", "event_id": 10, "ts": at(500)}, {"kind": "abort", "session_id": "z", "event_id": 11, "ts": at(501)}]
    schema = "kind string, session_id string, event_id bigint, ts timestamp"
    plan = lambda df: S.requests_with_aborts(df.filter("kind = 'request'"), df.filter("kind = 'abort'"), "10 MINUTES", "30 MINUTES")
    got = {(r.session_id, r.event_id): r.aborted_at and r.aborted_at.strftime("%H:%M") for r in streamed(spark, tmp_path, [rows[:6], rows[6:8], rows[8:], late[:1], late[1:]], schema, plan, "met")}
    # c's abort comes after the watermark has passed its request, which the trigger after that heeds
    assert got == {("a", 1): "00:05", ("b", 3): None, ("c", 5): None, ("a", 6): None, ("d", 8): "03:20", ("y", 12): None, ("z", 10): "08:21"}
    table = spark.createDataFrame([tuple(r.values()) for r in rows + late], "kind string, session_id string, event_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    both = S.requests_with_aborts(table.filter("kind = 'request'"), table.filter("kind = 'abort'"), "10 MINUTES").collect()
    assert {(r.session_id, r.event_id): r.aborted_at and r.aborted_at.strftime("%H:%M") for r in both} == got | {("c", 5): "00:04"}


def test_statistics_of_a_stream(spark, tmp_path):
    """AG05-AG08: the rows of a query that come over several triggers, as the batch counts them."""
    rnd = random.Random(1)
    rows = []
    for k in range(300):
        day = 1 + k // 100
        rows.append({"query_id": f"q{day}-{k % 9}", "rank": k, "section": rnd.choice([None, "", "a", "b", "c"]), "chunk_type": rnd.choice(["text", "parent", None]), "score": str(rnd.randrange(100) / 100), "created_at": f"2024-01-{day:02d}T{k % 24:02d}:00:00"})
    end = {"query_id": "end", "rank": 0, "section": None, "chunk_type": None, "score": None, "created_at": "2024-02-01T00:00:00"}
    schema = "query_id string, rank bigint, section string, chunk_type string, score decimal(10,6), created_at timestamp"
    got = streamed(spark, tmp_path, [*cut(rows, 6), [end]], schema, lambda df: S.stats_stream(df, "1 hour", "1 day"), "stats")
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema.replace("decimal(10,6)", "string").replace("timestamp", "string")).withColumns({"score": F.col("score").cast("decimal(10,6)"), "created_at": F.col("created_at").cast("timestamp")})
    want = K.retrieval_stats(table).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) == 27


def test_a_batch_is_kept_once(spark, tmp_path):
    """IO09/IO10: a replay leaves one copy, with or without the ledger's word; a failing batch is told and never raised."""
    told = []
    log = S.BatchLog(str(tmp_path / "log"), "session_id", report=lambda *r: told.append(r))
    first = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "session_id bigint, value string")
    second = spark.createDataFrame([(3, "d")], "session_id bigint, value string")
    for batch, number in ((first, 0), (second, 1), (first, 0)):
        log(batch, number)
    broken = second.withColumn("value", F.expr("raise_error('lost')").cast("string"))
    log(broken, 2)
    assert sorted((r.batch_id, r.session_id) for r in log.rows(spark).collect()) == [(0, 1), (0, 2), (1, 3)]
    assert [(r.batch_id, r.error is None) for r in log.ledger(spark).orderBy("batch_id").collect()] == [(0, True), (1, True), (2, False)] and told[0][0] == 2
    log(second, 2)  # the replay of a failed batch is kept
    again = S.BatchLog(str(tmp_path / "log"), "session_id")
    again._done = lambda spark, batch_id: False  # written, but stopped before the ledger
    again(first, 0)
    assert sorted((r.batch_id, r.session_id) for r in log.rows(spark).collect()) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    S.BatchLog("nowhere://x", report=lambda *r: told.append(r))(first, 7)
    assert told[-1][0] == 7
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"session_id": 5, "value": "x"}')
    log = S.BatchLog(str(tmp_path / "streamed"), "session_id")
    q = spark.readStream.schema("session_id bigint, value string").json(str(source)).writeStream.foreachBatch(log).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and log.rows(spark).count() == 1
