"""History, keyed state, control streams, events, prompts and client projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import chats as C
from paperloom.operators import events as E
from paperloom.operators import jobs as J
from paperloom.operators import memory as M
from paperloom.operators import retrieval as R
from paperloom.streaming import processors as Q
from paperloom.streaming import stateful as S

from .bindings import chunk_store, messages, questions, quoted, sql, table
from .registry import query
from .text_queries import s_in, s_strip, s_vague, s_words


def logged(spark, d):
    """Control and state events: the user is the session."""
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", "event_type", "value", "props")


LOG = {"logged": "SELECT user_id AS session_id, event_id, ts, event_type, value, props FROM events"}
ORDER = ("ts", "event_id")


@query("wn06_first_messages", sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn)::INTEGER AS n FROM messages) WHERE n <= 3", "messages"))
def wn06(spark, d):
    return M.first_messages(messages(spark, d), 3)


@query("wn07_last_user_messages", sql("SELECT session_id, turn, role, content, row_number() OVER (PARTITION BY session_id ORDER BY turn)::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM messages WHERE role = 'user') WHERE back <= 2", "messages"))
def wn07(spark, d):
    return M.last_user_messages(messages(spark, d), 2)


@query("wn08_history_tail", sql("SELECT session_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM messages) WHERE back <= 4", "messages"))
def wn08(spark, d):
    return M.history_tail(messages(spark, d))


@query(
    "wn09_rewrite_base",
    sql(
        f"""SELECT session_id, turn, last_value(CASE WHEN c <> '' AND NOT {s_in('lower(c)', X.NON_INFORMATIVE)} AND NOT {s_vague('c')} THEN c END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS base
        FROM (SELECT session_id, turn, {s_strip("CASE WHEN turn % 4 = 2 THEN 'explain more' ELSE content END")} AS c FROM messages WHERE role = 'user')""",
        "messages",
    ),
)
def wn09(spark, d):
    said = messages(spark, d).withColumn("content", F.when(F.col("turn") % 4 == 2, "explain more").otherwise(F.col("content")))
    return M.rewrite_bases(said).select("session_id", "turn", "base")


_EPOCHS = LOG | {
    "changes": "SELECT *, CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS changed FROM logged WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)",
    "epochs": "SELECT *, sum(changed) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM changes",
}


@query("wn10_topic_epochs", sql("SELECT session_id, epoch, any_value(event_type) AS topic, count(DISTINCT props) AS used FROM epochs GROUP BY 1, 2", **_EPOCHS))
def wn10(spark, d):
    return M.epochs(logged(spark, d), "session_id", "event_type", *ORDER).groupBy("session_id", "epoch").agg(F.first("event_type").alias("topic"), F.countDistinct("props").alias("used"))


@query("wn10_topic_epochs_in_segments", sql("SELECT session_id, event_id, epoch FROM epochs", **_EPOCHS))
def wn10_segments(spark, d):
    """Epochs with sessions of over ten events cut into segments."""
    return M.epochs(logged(spark, d), "session_id", "event_type", *ORDER, cut=10).select("session_id", "event_id", "epoch")


_LAST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS n FROM logged) WHERE n = 1"


@query("wn11_latest_per_key", sql(_LAST, **LOG))
def wn11(spark, d):
    return M.latest(logged(spark, d), ["session_id"], "ts", "event_id")


@query("wn12_trailing_requests", sql("SELECT event_id, count(*) OVER (PARTITION BY session_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM logged", **LOG))
def wn12(spark, d):
    return M.trailing_count(logged(spark, d), "session_id", 3600).select("event_id", "recent")


@query("wn14_title_messages", sql("SELECT session_id, min(turn) AS turn FROM messages WHERE role = 'user' GROUP BY 1", "messages"))
def wn14(spark, d):
    return C.title_messages(messages(spark, d)).select("session_id", "turn")


@query("wn15_last_assistant_message", sql("SELECT session_id, turn, role = 'assistant' AND turn = max(turn) FILTER (role = 'assistant') OVER (PARTITION BY session_id) AS is_last FROM messages", "messages").replace("AS is_last", "AS is_last"))
def wn15(spark, d):
    return C.marked_last(messages(spark, d)).select("session_id", "turn", "is_last")


@query("fl11_last_user_texts", sql("SELECT session_id, array_to_string(list_slice(list(content ORDER BY turn), -3, -1), chr(10)) AS texts FROM messages WHERE role = 'user' GROUP BY 1", "messages"))
def fl11(spark, d):
    return C.last_user_texts(messages(spark, d))


@query("fl12_chat_search", sql("SELECT session_id FROM messages GROUP BY 1 HAVING bool_or(role <> 'system' AND contains(lower(content), 'thing'))", "messages"))
def fl12(spark, d):
    hit = (F.col("role") != "system") & F.lower("content").contains("thing")
    return messages(spark, d).filter(hit).select("session_id").distinct()


_TITLED = "SELECT DISTINCT session_id, CASE session_id % 7 WHEN 0 THEN 'Some THING else' ELSE 'Chat ' || session_id END AS title FROM messages"


@query("fl12_chat_and_title_search", sql("SELECT m.session_id FROM messages m JOIN titled t ON t.session_id = m.session_id GROUP BY 1 HAVING bool_or(role <> 'system' AND contains(lower(content), 'thing')) OR bool_or(contains(lower(title), 'thing'))", "messages", titled=_TITLED))
def fl12_titles(spark, d):
    titles = messages(spark, d).select("session_id").distinct().select("session_id", F.when(F.col("session_id") % 7 == 0, "Some THING else").otherwise(F.concat(F.lit("Chat "), F.col("session_id").cast("string"))).alias("title"))
    return M.chat_search(messages(spark, d), titles, "Thing")


@query("ag17_session_counts", sql("SELECT session_id, count(*) AS n_messages, count(DISTINCT role) AS n_roles FROM messages GROUP BY 1", "messages"))
def ag17(spark, d):
    return C.session_counts(messages(spark, d))


_TOKENS = "SELECT session_id, CASE session_id % 3 WHEN 0 THEN 'groq' WHEN 1 THEN 'xai' ELSE 'none' END AS provider, sum(ceil(length(content) / 4.0))::BIGINT AS tokens FROM messages GROUP BY ALL"


@query("ag15_token_usage_and_cost", sql(f"SELECT session_id, provider, tokens, round((tokens::DECIMAL(18,0) * CASE provider WHEN 'groq' THEN 0.0005 WHEN 'xai' THEN 0.002 ELSE 0 END::DECIMAL(10,6) / 1000)::DECIMAL(20,9), 6)::DECIMAL(18,6) AS cost FROM ({_TOKENS})", "messages"))
def ag15(spark, d):
    provider = F.when(F.col("session_id") % 3 == 0, "groq").when(F.col("session_id") % 3 == 1, "xai").otherwise("none")
    used = messages(spark, d).groupBy("session_id", provider.alias("provider")).agg(F.sum(X.estimate_tokens(F.col("content"))).alias("tokens"))
    return used.withColumn("cost", E.token_cost(F.col("tokens"), F.col("provider")))


@query("ag16_durations", sql("SELECT session_id, date_diff('millisecond', min(ts), max(ts)) AS duration_ms FROM (SELECT session_id, date_trunc('millisecond', ts) AS ts FROM logged) GROUP BY 1", **LOG))
def ag16(spark, d):
    return C.durations(logged(spark, d))


_TTL_SESSIONS = sql("SELECT session_id, span, min(ts) AS begin, max(ts) AS last_write, count(*) AS writes FROM (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS span FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM logged)) GROUP BY 1, 2", **LOG)


@query("st01_ttl_sessions", _TTL_SESSIONS)
def st01(spark, d):
    return M.ttl_sessions(logged(spark, d), "session_id", 1800)


@query("st01_ttl_sessions_in_segments", _TTL_SESSIONS)
def st01_segments(spark, d):
    """Spans with sessions of over ten events cut into segments."""
    return M.ttl_sessions(logged(spark, d), "session_id", 1800, cut=10)


@query("st02_abort_flags", sql("SELECT session_id, event_id, coalesce(last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'error', false) AS aborted, event_type FROM logged QUALIFY event_type NOT IN ('error', 'signup')", **LOG))
def st02(spark, d):
    return M.abort_flags(logged(spark, d), "session_id", "ts", "event_type", "error", "signup", *ORDER).select("session_id", "event_id", "aborted", "event_type")


_FLAGS = """WITH RECURSIVE numbered AS (SELECT user_id AS session_id, event_id, epoch_us(ts)::DOUBLE / 1e6 AS t, CASE event_type WHEN 'error' THEN 'abort' WHEN 'signup' THEN 'reset' ELSE 'check' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT DISTINCT session_id, NULL::BIGINT AS event_id, 0::BIGINT AS n, NULL::DOUBLE AS flag, 'none' AS action, false AS aborted FROM numbered
    UNION ALL SELECT session_id, event_id, n, CASE WHEN action = 'abort' OR (action = 'check' AND alive) THEN t + 172800 END, action, alive
    FROM (SELECT s.*, coalesce(s.t < r.flag, false) AS alive FROM r JOIN numbered s ON s.session_id = r.session_id AND s.n = r.n + 1))
  SELECT session_id, event_id, aborted FROM r WHERE action = 'check'"""


@query("st02_abort_flags_with_ttl", _FLAGS)
def st02_ttl(spark, d):
    """Flags that live for two days after the abort or the last check that found them."""
    rows = logged(spark, d).select("session_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t"), S.as_check(F.col("event_type"), "error", "signup").alias("action"))
    return Q.fold(rows, ["session_id"], [F.col("t"), F.col("event_id")], lambda: Q.AbortFlag(172800), "session_id bigint, event_id bigint, aborted boolean")


@query("st06_requests_with_aborts", sql("SELECT a.session_id, a.event_id, a.ts, b.ts AS aborted_at FROM logged a LEFT JOIN logged b ON b.event_type = 'error' AND b.session_id = a.session_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAYS WHERE a.event_type = 'click'", **LOG))
def st06_aborts(spark, d):
    """Clicks as requests, with the errors of their session in the two days from then on as aborts."""
    rows = logged(spark, d)
    return S.requests_with_aborts(rows.filter("event_type = 'click'"), rows.filter("event_type = 'error'"), "2 DAYS")


_SPANS = LOG | {"marks": "SELECT session_id, ts AS moment, 1 AS step FROM logged UNION ALL SELECT session_id, ts + to_hours(12), -1 FROM logged"}


@query("st04_concurrent_streams", sql("SELECT session_id, max(open)::BIGINT AS most FROM (SELECT session_id, sum(step) OVER (PARTITION BY session_id ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS open FROM marks) GROUP BY 1", **_SPANS))
def st04(spark, d):
    rows = logged(spark, d).withColumn("end", F.col("ts") + F.expr("INTERVAL 12 HOURS"))
    return M.concurrency(rows, "session_id", "ts", "end")


_REQUESTS = "SELECT user_id AS session_id, event_id, epoch_us(ts)::DOUBLE / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


def requests(spark, d):
    return logged(spark, d).select("session_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t"))


@query("st04_admission", f"""WITH RECURSIVE numbered AS ({_REQUESTS}),
  r AS (SELECT session_id, event_id, n, [t] AS times, [t + 43200] AS ends, true AS admitted, NULL::VARCHAR AS reason FROM numbered WHERE n = 1
    UNION ALL SELECT session_id, event_id, n, CASE WHEN ok THEN list_append(live, t) ELSE live END, CASE WHEN ok THEN list_append(open, t + 43200) ELSE open END, ok, CASE WHEN len(live) >= 4 THEN 'rate' WHEN len(open) >= 2 THEN 'streams' END
    FROM (SELECT *, len(live) < 4 AND len(open) < 2 AS ok FROM (SELECT s.*, list_filter(r.times, lambda x: x >= s.t - 172800) AS live, list_filter(r.ends, lambda x: x > s.t) AS open FROM r JOIN numbered s ON s.session_id = r.session_id AND s.n = r.n + 1)))
  SELECT session_id, event_id, admitted, reason FROM r""")
def st04_admission(spark, d):
    """At most two streams of a session at a time, each twelve hours long, and four requests in two days."""
    rows = requests(spark, d).withColumn("until", F.col("t") + 43200)
    return Q.fold(rows, ["session_id"], [F.col("t"), F.col("event_id")], lambda: Q.Admission(4, 172800, 2), "session_id bigint, event_id bigint, admitted boolean, reason string")


@query("st10_cached_reads", f"""WITH RECURSIVE numbered AS ({_REQUESTS}),
  r AS (SELECT session_id, event_id, n, t AS fetched, false AS cached FROM numbered WHERE n = 1
    UNION ALL SELECT s.session_id, s.event_id, s.n, CASE WHEN s.event_id % 10 <> 0 AND s.t - r.fetched < 86400 THEN r.fetched ELSE s.t END, s.event_id % 10 <> 0 AND s.t - r.fetched < 86400 FROM r JOIN numbered s ON s.session_id = r.session_id AND s.n = r.n + 1)
  SELECT session_id, event_id, cached FROM r""")
def st10_reads(spark, d):
    """A day's cache anchored at each fetch; every tenth read is forced."""
    rows = requests(spark, d).withColumn("force", F.col("event_id") % 10 == 0)
    return Q.fold(rows, ["session_id"], [F.col("t"), F.col("event_id")], lambda: Q.CachedReads(86400), "session_id bigint, event_id bigint, cached boolean")


_GUARDED = f"""SELECT session_id, turn, CASE WHEN session_id % 6 = 1 THEN '' ELSE content END AS content, CASE WHEN turn % 5 = 3 THEN 'unwrapped' WHEN turn % 5 = 2 THEN 'event' ELSE 'plain' END AS form, session_id % 4 = 0 AND turn >= 2 AS aborted, session_id % 7 = 0 AND turn >= 3 AS failed FROM messages"""


@query("st06_safe_stream_frames", sql(f"""SELECT session_id, turn AS seq, kind, value FROM (
    SELECT session_id, turn, CASE WHEN turn = stop THEN 'event' WHEN form = 'event' THEN 'event' ELSE 'text' END AS kind,
      CASE WHEN turn = stop THEN '{E.PREFIX}{{"type":"ERROR","message":"' || CASE WHEN aborted THEN 'Generation aborted' ELSE 'Generation failed' END || '"}}' || chr(10) WHEN form = 'event' THEN '{E.PREFIX}{{"type":"PROGRESS","value":5,"label":"x"}}' || chr(10) ELSE content END AS value
    FROM (SELECT *, min(turn) FILTER (aborted OR failed) OVER (PARTITION BY session_id) AS stop FROM guarded) WHERE (stop IS NULL OR turn <= stop) AND (turn = stop OR form <> 'plain' OR content <> ''))
  UNION ALL SELECT session_id, NULL, CASE WHEN answer = '' THEN 'event' ELSE 'kept' END, CASE WHEN answer = '' THEN '{E.PREFIX}{{"type":"SYSTEM_MESSAGE","message":"Model produced no output"}}' || chr(10) ELSE answer END
  FROM (SELECT session_id, {s_strip("string_agg(CASE WHEN form = 'event' THEN '' ELSE content END, '' ORDER BY turn)")} AS answer FROM guarded GROUP BY 1 HAVING NOT bool_or(aborted OR failed))""", "messages", guarded=_GUARDED))
def st06_frames(spark, d):
    """Streams with TEXT events, other events, aborts, failures, and streams that say nothing."""
    said = F.when(F.col("session_id") % 6 == 1, "").otherwise(F.col("content"))
    unwrapped = E.event_line(F.to_json(F.struct(F.lit("TEXT").alias("type"), said.alias("content"))))
    chunk = F.when(F.col("turn") % 5 == 3, unwrapped).when(F.col("turn") % 5 == 2, E.event_line(E.event("PROGRESS", value=F.lit(5), label=F.lit("x")))).otherwise(said)
    rows = messages(spark, d).select("session_id", F.col("turn").alias("seq"), chunk.alias("chunk"), ((F.col("session_id") % 4 == 0) & (F.col("turn") >= 2)).alias("aborted"), ((F.col("session_id") % 7 == 0) & (F.col("turn") >= 3)).alias("failed"))
    return Q.fold(rows, ["session_id"], [F.col("seq")], Q.SafeStream, "session_id bigint, seq bigint, kind string, value string")


@query("st06_safe_stream_answer", sql(f"SELECT session_id, {s_strip('''string_agg(content, '' ORDER BY turn)''')} AS answer FROM messages WHERE role <> 'system' GROUP BY 1", "messages"))
def st06(spark, d):
    """The answer of a stream: its chunks in order without event lines (here the system turns are event lines)."""
    chunk = F.when(F.col("role") == "system", E.event_line(E.event("ERROR", message=F.col("content")))).otherwise(F.col("content"))
    rows = messages(spark, d).select("session_id", "turn", chunk.alias("chunk")).filter(~F.col("chunk").startswith(E.PREFIX))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "chunk"))), lambda c: c.chunk), "")
    return rows.groupBy("session_id").agg(X.strip(joined).alias("answer"))


@query("st08_job_progress", sql("SELECT session_id, max(progress)::INTEGER AS progress, count(*) FILTER (progress < before) AS steps_back FROM (SELECT *, lag(progress) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before FROM (SELECT *, CASE event_type WHEN 'signup' THEN 5 WHEN 'view' THEN 30 WHEN 'click' THEN 60 WHEN 'purchase' THEN 100 ELSE 0 END AS progress FROM logged)) GROUP BY 1", **LOG))
def st08(spark, d):
    kind = F.col("event_type")
    p = F.when(kind == "signup", 5).when(kind == "view", 30).when(kind == "click", 60).when(kind == "purchase", 100).otherwise(0)
    rows = logged(spark, d).withColumn("progress", p).withColumn("before", F.lag("progress").over(Window.partitionBy("session_id").orderBy(*ORDER)))
    return rows.groupBy("session_id").agg(F.max("progress").alias("progress"), F.count_if(F.col("progress") < F.col("before")).alias("steps_back"))


_STEPS = "[0, 5, 15, 20, 30, 45, 60, 80, 95, 100]"


@query("st08_progress_sequences", sql(f"""SELECT session_id, count(*) FILTER (NOT regular) AS irregular, count(*) AS n FROM (SELECT *, CASE WHEN before IS NULL THEN progress = 5 ELSE (before, progress) IN ((5, 15), (15, 20), (5, 30), (30, 45), (45, 60), (60, 80), (80, 95), (95, 100)) END AS regular
    FROM (SELECT *, lag(progress) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before FROM (SELECT *, {_STEPS}[((event_id + session_id) % 9 + 2)::INTEGER] AS progress FROM logged))) GROUP BY 1""", **LOG))
def st08_sequences(spark, d):
    steps = F.array(*(F.lit(x) for x in (0, 5, 15, 20, 30, 45, 60, 80, 95, 100)))
    rows = logged(spark, d).withColumn("progress", F.get(steps, ((F.col("event_id") + F.col("session_id")) % 9 + 1).cast("int")))
    return M.progress_steps(rows, "session_id", "progress", *map(F.col, ORDER)).groupBy("session_id").agg(F.count_if(~F.col("regular")).alias("irregular"), F.count(F.lit(1)).alias("n"))


_STATUS = "CASE event_type WHEN 'signup' THEN 'WAIT_FOR_METADATA' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'READY' WHEN 'error' THEN 'ERROR' END"


def _status():
    kind = F.col("event_type")
    return F.when(kind == "signup", "WAIT_FOR_METADATA").when(kind == "view", "PROCESSING").when(kind == "purchase", "READY").when(kind == "error", "ERROR")


@query("st09_chat_routes", sql(f"SELECT session_id, event_id, CASE status WHEN 'WAIT_FOR_METADATA' THEN 'request_metadata' WHEN 'PROCESSING' THEN 'processing' WHEN 'ERROR' THEN 'failed' WHEN 'READY' THEN 'retrieve' ELSE 'plain_chat' END AS route FROM (SELECT *, last_value({_STATUS} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS status FROM logged) WHERE event_type = 'click'", **LOG))
def st09(spark, d):
    return J.routed(logged(spark, d), "session_id", _status(), *ORDER).filter("event_type = 'click'").select("session_id", "event_id", "route")


@query("st10_cached_status_windows", sql("SELECT time_bucket(INTERVAL 30 SECONDS, ts) AS begin, count(*) AS n FROM logged GROUP BY 1", **LOG))
def st10(spark, d):
    return logged(spark, d).groupBy(F.window("ts", "30 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), "n")


@query("st11_superseded_jobs", sql("SELECT session_id, event_id, lead(1) OVER (PARTITION BY session_id ORDER BY ts, event_id) IS NOT NULL AS superseded FROM logged WHERE event_type = 'signup'", **LOG))
def st11(spark, d):
    return M.superseded(logged(spark, d).filter("event_type = 'signup'"), "session_id", *ORDER).select("session_id", "event_id", "superseded")


_CLEARS = LOG | {"later": "SELECT *, max((event_type = 'error')::INT) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cleared FROM logged"}


@query("st12_state_after_clears", sql("SELECT session_id, count(*) AS n FROM later WHERE cleared = 0 GROUP BY 1", **_CLEARS))
def st12(spark, d):
    return M.after_clears(logged(spark, d), "session_id", F.col("event_type") == "error", *ORDER).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("so04_used_id_sets", sql("SELECT session_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS used FROM logged GROUP BY 1", **LOG))
def so04(spark, d):
    return logged(spark, d).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("used"))


@query("jn03_used_chunk_restore", sql("SELECT u.session_id, s.chunk_id, 1.0::DOUBLE AS score, -1 AS rank FROM (SELECT DISTINCT session_id, (props::JSON ->> 'k')::BIGINT AS row_id FROM logged) u JOIN chunk_store s ON s.row_id = u.row_id", "chunk_store", **LOG))
def jn03(spark, d):
    used = logged(spark, d).select("session_id", F.get_json_object("props", "$.k").cast("bigint").alias("row_id"))
    return R.restored_hits(used, chunk_store(spark, d))


_RESTORED_FIRST = sql("SELECT session_id, chunk_id, min(pos)::INTEGER AS pos, arg_min(origin, pos) AS origin FROM (SELECT session_id, chunk_id, -1 AS pos, 'restored' AS origin FROM restored UNION ALL SELECT session_id, chunk_id, event_id::INTEGER, 'new' FROM fresh) GROUP BY 1, 2", "chunk_store", **LOG, restored="SELECT DISTINCT u.session_id, s.chunk_id FROM logged u JOIN chunk_store s ON s.row_id = (u.props::JSON ->> 'k')::BIGINT", fresh="SELECT u.session_id, s.chunk_id, u.event_id FROM logged u JOIN chunk_store s ON s.row_id = u.event_id % (SELECT max(row_id) + 1 FROM chunk_store)")


@query("so02_restored_first_union", _RESTORED_FIRST)
@query("so02_restored_first_union_all_ids", _RESTORED_FIRST)
def so02_all(spark, d):
    """New hits over the whole id range of the store."""
    store = chunk_store(spark, d).select("row_id", "chunk_id")
    ids = F.broadcast(store.agg((F.max("row_id") + 1).alias("n_ids")))
    fresh = logged(spark, d).crossJoin(ids).withColumn("row_id", F.col("event_id") % F.col("n_ids")).join(store, "row_id").select("session_id", "chunk_id", F.col("event_id").alias("pos"))
    return R.restored_first(jn03(spark, d), fresh)


_JOBS = LOG | {
    "jobs": f"SELECT 'job-' || event_id AS job_id, session_id, event_id FROM logged WHERE event_type = 'signup'",
    "state": f"SELECT session_id, arg_max({_STATUS}, (ts, event_id)) AS status FROM logged WHERE {_STATUS} IS NOT NULL GROUP BY 1",
}


def _latest_status(spark, d):
    return J.latest_status(logged(spark, d).withColumn("status", _status()), "session_id", "status", *ORDER)


@query("jn04_active_document", sql("SELECT c.customer AS session_id, coalesce(s.status, CASE WHEN o.doc IS NOT NULL THEN 'READY' END) AS status, o.doc AS document FROM (SELECT c_custkey AS customer FROM customer) c LEFT JOIN state s ON s.session_id = c.customer LEFT JOIN (SELECT o_custkey, max(o_orderkey)::VARCHAR AS doc FROM orders GROUP BY 1) o ON o.o_custkey = c.customer", **_JOBS))
def jn04(spark, d):
    stored = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.max("o_orderkey").cast("string").alias("document"))
    sessions = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"))
    return J.active_document(sessions, _latest_status(spark, d), stored)


_ASKED = "SELECT CASE WHEN event_id % 2 = 0 THEN 'job-' || event_id ELSE session_id::VARCHAR END AS identifier, event_id AS ask_id FROM logged"


@query("jn05_job_by_id_or_session", sql("SELECT a.ask_id, coalesce(j.job_id, s.job_id) AS job_id FROM asks a LEFT JOIN jobs j ON j.job_id = a.identifier LEFT JOIN (SELECT session_id::VARCHAR AS sid, arg_max(job_id, event_id) AS job_id FROM jobs GROUP BY 1) s ON s.sid = a.identifier", **_JOBS, asks=_ASKED))
def jn05(spark, d):
    rows = logged(spark, d)
    jobs = rows.filter("event_type = 'signup'").select(F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"), "session_id", "event_id")
    asks = rows.select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("job-"), F.col("event_id").cast("string"))).otherwise(F.col("session_id").cast("string")).alias("identifier"), F.col("event_id").alias("ask_id"))
    return J.resolve_jobs(asks, jobs).select("ask_id", "job_id")


@query("pj09_job_status_summary", sql("SELECT status, count(*) AS n FROM state GROUP BY 1", **_JOBS))
def pj09(spark, d):
    return J.status_summary(_latest_status(spark, d))


@query("rd01_last_topic_reads", sql("SELECT c_custkey AS session_id, l.event_type AS topic FROM customer LEFT JOIN last l ON l.session_id = c_custkey", **LOG, last=_LAST))
def rd01(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("session_id")).join(wn11(spark, d).select("session_id", F.col("event_type").alias("topic")), "session_id", "left")


@query("mu01_session_upsert", sql("SELECT session_id, min(ts) AS created_at, max(ts) AS last_active, count(*) FILTER (event_type <> 'error') AS kept FROM logged GROUP BY 1", **LOG))
def mu01(spark, d):
    return logged(spark, d).groupBy("session_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_active"), F.count_if(F.col("event_type") != "error").alias("kept"))


@query("mu01_messages_after_aborts", sql("SELECT session_id, event_id, event_type FROM (SELECT *, coalesce(last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'error', false) AS aborted FROM logged) WHERE event_type NOT IN ('error', 'signup') AND NOT (event_type = 'view' AND aborted)", **LOG))
def mu01_kept(spark, d):
    """Errors abort, sign-ups start anew, views are the assistant's messages."""
    return M.kept_messages(logged(spark, d), "session_id", "event_type", "error", "signup", "view", *ORDER).select("session_id", "event_id", "event_type")


@query("mu02_topic_hint_upsert", sql("SELECT session_id, turn, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM messages WHERE role = 'user') WHERE n = 1", "messages"))
def mu02(spark, d):
    return M.latest(messages(spark, d).filter("role = 'user'"), ["session_id"], "turn").select("session_id", "turn", "content")


@query("mu03_active_document_upsert", sql("SELECT session_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS n FROM logged WHERE event_type IN ('purchase', 'error')) WHERE n = 1 AND event_type <> 'error'", **LOG))
def mu03(spark, d):
    rows = logged(spark, d).filter("event_type IN ('purchase', 'error')")
    return J.active_bindings(rows, "session_id", F.col("event_type") == "error", *ORDER).select("session_id", "event_id", "value")


@query("mu05_chat_edits", "SELECT conv_id AS id, CASE WHEN conv_id % 7 = 0 THEN 'Renamed' ELSE 'Chat ' || conv_id END AS title, conv_id % 5 = 0 AS pinned FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 11 <> 0")
def mu05(spark, d):
    chats = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return C.edited(chats, F.when(F.col("id") % 7 == 0, "Renamed"), F.col("id") % 5 == 0, F.col("id") % 11 == 0)


_PAGE = "coalesce(try_cast(page AS INTEGER)::VARCHAR, '?')"


@query("pj04_context_text", sql(f"SELECT company_document_id, string_agg('[Page ' || {_PAGE} || ' | Section: ' || coalesce(section, 'General') || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY row_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY company_document_id ORDER BY row_id) AS n FROM chunk_store WHERE chunk_type = 'parent') WHERE n <= 8 GROUP BY 1", "chunk_store"))
def pj04(spark, d):
    """The first eight table chunks of each document, as many as a prompt takes."""
    rows = chunk_store(spark, d).filter("chunk_type = 'parent'").select("company_document_id", "row_id", E.context_block(F.col("page"), F.col("section"), F.col("content")).alias("block"))
    return E.context_text(rows, "company_document_id", "row_id", "block")


@query("pj05_plain_context", sql("SELECT session_id, string_agg(content, chr(10) || chr(10) ORDER BY turn) FILTER (content <> '') AS context FROM messages GROUP BY 1", "messages"))
def pj05(spark, d):
    return messages(spark, d).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("turn", "content")))), lambda m: m.content), "\n\n").alias("context"))


@query("pj03_source_list", sql("SELECT row_id, chunk_id, coalesce(company_document_id || '.pdf', 'Unknown') AS file_name, coalesce(try_cast(page AS INTEGER), 1) AS page, try_cast(revision_number AS INTEGER) AS revision FROM chunk_store", "chunk_store"))
def pj03(spark, d):
    return R.source_list(chunk_store(spark, d))


@query("pj06_chat_normaliser", sql("SELECT session_id, turn, coalesce(role, 'assistant') AS role, CASE turn % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'done' WHEN 2 THEN 'done' ELSE 'error' END AS status, content FROM messages", "messages"))
def pj06(spark, d):
    raw = F.when(F.col("turn") % 4 == 0, "typing").when(F.col("turn") % 4 == 1, "streaming").when(F.col("turn") % 4 == 3, "error")
    role, status, content = C.normalised(F.col("role"), raw, F.col("content"))
    return messages(spark, d).select("session_id", "turn", role.alias("role"), status.alias("status"), content.alias("content"))


_EVENTS_SQL = """SELECT event_id, CASE event_id % 3
  WHEN 0 THEN '{"type":"PROGRESS","value":' || greatest(0, least(100, value::INTEGER - 50)) || ',"label":"' || event_type || '"}'
  WHEN 1 THEN '{"type":"NET_RATE_LIMITED","retryAfterSec":' || greatest(1, value::INTEGER - 60) || ',"provider":null}'
  ELSE '{"type":"ERROR","message":"' || event_type || '"}' END AS event FROM (SELECT event_id, floor(value) AS value, event_type FROM events)"""


def ui_events(spark, d):
    e = table(spark, d, "events").withColumn("v", F.floor("value"))
    made = F.when(F.col("event_id") % 3 == 0, E.progress_event(F.col("v") - 50, F.col("event_type"))).when(F.col("event_id") % 3 == 1, E.rate_limited_event(F.col("v") - 60, F.lit(None).cast("string"))).otherwise(E.event("ERROR", message=F.col("event_type")))
    return e.select("event_id", made.alias("event"))


@query("pj07_ui_events", _EVENTS_SQL)
def pj07(spark, d):
    return ui_events(spark, d)


@query("pj11_event_lines", f"SELECT event_id, '{E.PREFIX}' || event || chr(10) AS line FROM ({_EVENTS_SQL})")
def pj11(spark, d):
    return ui_events(spark, d).select("event_id", E.event_line(F.col("event")).alias("line"))


@query("tg10_parsed_event_lines", f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CASE event_id % 3 WHEN 0 THEN 'PROGRESS' WHEN 1 THEN 'NET_RATE_LIMITED' ELSE 'ERROR' END END AS kind FROM events")
def tg10(spark, d):
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), E.event_line(F.col("event")))).otherwise(F.concat(F.lit(E.PREFIX + "  "), F.col("event")))
    return ui_events(spark, d).select("event_id", E.parsed_type(line).alias("kind"))


@query("tg11_stream_lines", sql("SELECT session_id, turn, k::INTEGER AS k, lines[k + 1] AS line FROM (SELECT session_id, turn, lines, unnest(range(0, len(lines))) AS k FROM (SELECT session_id, turn, string_split(content, chr(10)) AS lines FROM messages))", "messages"))
def tg11(spark, d):
    return messages(spark, d).select("session_id", "turn", F.posexplode(F.split("content", "\n")).alias("k", "line"))


@query("tg11_carried_lines", sql(f"""SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY k) - 1)::BIGINT AS k, line FROM (SELECT session_id, k, {s_strip('lines[k]')} AS line
    FROM (SELECT session_id, lines, unnest(range(1, len(lines))) AS k FROM (SELECT session_id, string_split(string_agg(content, '' ORDER BY turn), chr(10)) AS lines FROM messages GROUP BY 1))) WHERE line <> ''""", "messages"))
def tg11_carried(spark, d):
    """Lines of each session's stream of messages, carried over from one message to the next."""
    rows = messages(spark, d).select("session_id", "turn", F.col("content").alias("chunk"))
    return Q.fold(rows, ["session_id"], [F.col("turn")], Q.LineBuffer, "session_id bigint, k bigint, line string")


@query("tg09_debug_snapshot", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS question, CASE WHEN event_id % 4 <> 0 THEN event_id END AS chunks FROM events")
def tg09(spark, d):
    saved = F.to_json(F.struct(F.col("event_type").alias("question"), F.col("event_id").alias("chunks")))
    stored = F.when(F.col("event_id") % 4 == 0, F.substring(saved, 1, 9)).otherwise(saved)
    back = J.debug_snapshot(stored, "question string, chunks bigint")
    return table(spark, d, "events").select("event_id", back.alias("b")).select("event_id", "b.question", "b.chunks")


_SYSTEM = "You answer from documents."
MODES = {"click": "base", "view": "lite", "purchase": "net"}


@query("sc36_prompts", sql(f"""SELECT qid, '<|start_header_id|>system<|end_header_id|>' || chr(10) || {quoted(_SYSTEM)} || chr(10) || chr(10) || CASE WHEN qid % 2 = 0 THEN {quoted(E.STYLES['one_line'])} ELSE {quoted(E.STYLES['short'])} END || chr(10) || '<|eot_id|>'
  || '<|start_header_id|>user<|end_header_id|>' || chr(10) || 'CONTEXT:' || chr(10) || CASE WHEN qid % 3 = 0 THEN 'ctx' ELSE {quoted(E.NO_CONTEXT)} END || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || '<|eot_id|>' || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) AS prompt FROM questions""", "questions"))
def sc36(spark, d):
    style = E.style_text(F.when(F.col("qid") % 2 == 0, "one_line").otherwise("unknown"))
    return questions(spark, d).select("qid", E.prompt(F.lit(_SYSTEM), style, F.when(F.col("qid") % 3 == 0, "ctx"), F.col("question")).alias("prompt"))


_HEAD = lambda role: f"'<|start_header_id|>{role}<|end_header_id|>' || chr(10)"


@query("sc36_title_prompts", sql(f"SELECT qid, {_HEAD('system')} || chr(10) || {quoted(E.TITLE_TASK)} || chr(10) || chr(10) || '<|eot_id|>' || {_HEAD('user')} || chr(10) || question || '<|eot_id|>' || {_HEAD('assistant')} AS prompt FROM questions", "questions"))
def sc36_title(spark, d):
    return questions(spark, d).select("qid", E.title_prompt(F.col("question")).alias("prompt"))


@query("sc36_refine_prompts", sql(f"SELECT qid, {quoted(E.REFINE_TASK)} || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'DRAFT ANSWER:' || chr(10) || 'draft ' || qid || chr(10) || chr(10) || 'REFINED ANSWER:' AS prompt FROM questions", "questions"))
def sc36_refine(spark, d):
    return questions(spark, d).select("qid", E.refine_prompt(F.col("question"), F.concat(F.lit("draft "), F.col("qid").cast("string"))).alias("prompt"))


@query("sc36_chat_prompts", sql(f"""SELECT qid, {_HEAD('system')} || {quoted(_SYSTEM)} || chr(10) || chr(10) || {quoted(E.STYLES['short'])} || chr(10) || '<|eot_id|>'
    || CASE qid % 3 WHEN 0 THEN '' WHEN 1 THEN {_HEAD('assistant')} || 'm2<|eot_id|>' || {_HEAD('user')} || 'm3<|eot_id|>' || {_HEAD('assistant')} || 'm4<|eot_id|>' || {_HEAD('user')} || 'm5<|eot_id|>' ELSE {_HEAD('user')} || 'm5<|eot_id|>' END
    || {_HEAD('user')} || 'CONTEXT:' || chr(10) || {quoted(E.NO_CONTEXT)} || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || '<|eot_id|>' || {_HEAD('assistant')} AS prompt FROM questions WHERE qid >= 0""", "questions"))
def sc36_chat(spark, d):
    """Without history, with more than four messages of it, and with one; of all questions but the fixed phrases."""
    message = lambda k: F.struct(F.lit("user" if k % 2 else "model").alias("role"), F.lit(f"m{k}").alias("content"))
    history = F.when(F.col("qid") % 3 == 1, F.array(*map(message, range(1, 6)))).when(F.col("qid") % 3 == 2, F.array(message(5)))
    none = F.lit(None).cast("string")
    return questions(spark, d).filter("qid >= 0").select("qid", E.chat_prompt(F.lit(_SYSTEM), E.style_text(none), history, none, F.col("question")).alias("prompt"))


@query("sc28_known_model_ids", "SELECT event_id, CASE event_type WHEN 'click' THEN 'base' WHEN 'view' THEN 'lite' WHEN 'purchase' THEN 'net' END AS model FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def sc28_known(spark, d):
    """The profile in which an unknown mode is an error: over the known ones."""
    rows = table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "purchase"))
    return rows.select("event_id", E.model_id(F.col("event_type"), MODES).alias("model"))


@query("sc27_model_routing", sql(f"SELECT qid, CASE WHEN qid % 4 = 0 THEN CASE WHEN qid % 8 = 0 THEN 'net' ELSE 'base' END WHEN qid % 5 = 0 THEN 'base' WHEN {s_words('question')} <= 6 THEN 'lite' ELSE 'base' END AS model FROM questions", "questions"))
def sc27(spark, d):
    q = F.col("qid")
    return questions(spark, d).select("qid", E.select_model(F.col("question"), q % 5 == 0, F.when(q % 4 == 0, "net"), q % 8 == 0).alias("model"))


@query("sc28_model_ids", "SELECT event_id, CASE event_type WHEN 'click' THEN 'base' WHEN 'view' THEN 'lite' WHEN 'purchase' THEN 'net' ELSE 'lite' END AS model FROM events")
def sc28(spark, d):
    return table(spark, d, "events").select("event_id", E.model_id(F.col("event_type"), MODES, "lite").alias("model"))


@query("sc29_parse_strategy", """SELECT event_id, CASE WHEN memory > 85 OR cpu > 90 OR mb >= 50 THEN 'serial_stream' WHEN mb < 5 THEN 'in_memory' ELSE 'batched_stream' END AS strategy,
  CASE WHEN memory > 85 OR cpu > 90 THEN 1 WHEN mb < 5 THEN cores WHEN mb < 50 THEN greatest(1, floor(cores * 0.75)) ELSE greatest(1, floor(cores * 0.5)) END::INTEGER AS cores, CASE WHEN memory > 85 OR cpu > 90 OR mb >= 50 THEN 1 WHEN mb < 5 THEN 10 ELSE 5 END::INTEGER AS batch
  FROM (SELECT event_id, value AS mb, event_id % 100 AS memory, event_id % 97 AS cpu, (event_id % 9 + 1)::INTEGER AS cores FROM events)""")
def sc29(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", E.strategy(F.col("value"), i % 100, i % 97, (i % 9 + 1).cast("int")).alias("s")).select("event_id", "s.strategy", "s.cores", "s.batch")


@query("sc30_retry_delays", "SELECT event_id, event_id % 2 + 1 AS attempt, (400 * 2 ** (event_id % 2))::BIGINT AS delay_ms FROM events")
def sc30(spark, d):
    a = F.col("event_id") % 2 + 1
    return table(spark, d, "events").select("event_id", a.alias("attempt"), E.retry_delay(a).alias("delay_ms"))


@query("sc32_key_provider", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'groq' WHEN 1 THEN 'xai' END AS provider FROM events")
def sc32(spark, d):
    made = F.concat(F.when(F.col("event_id") % 3 == 0, "gsk_").when(F.col("event_id") % 3 == 1, "xai-").otherwise("key-"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", E.key_provider(made).alias("provider"))


@query("sc35_upload_progress", "SELECT event_id, least((value::DECIMAL(10,2) * 0.4)::DECIMAL(12,4), 40)::DECIMAL(12,4) AS progress FROM events")
def sc35(spark, d):
    return table(spark, d, "events").select("event_id", E.upload_progress(F.col("value")).alias("progress"))


@query("pj10_error_text", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type || '!' WHEN 2 THEN 'a, b' WHEN 3 THEN 'Server error occurred' ELSE event_type END AS message FROM events")
def pj10(spark, d):
    i, kind = F.col("event_id") % 5, F.col("event_type")
    body = F.when(i == 0, F.concat(F.lit('{"detail":"'), kind, F.lit('"}'))).when(i == 1, F.concat(F.lit('{"message":"'), kind, F.lit('!"}'))).when(i == 2, '{"detail":[{"msg":"a"},{"msg":"b"}]}').when(i == 3, "<html>").otherwise(kind)
    return table(spark, d, "events").select("event_id", E.error_text(body).alias("message"))



