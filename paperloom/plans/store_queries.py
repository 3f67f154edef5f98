"""Sources, sinks, the store, and sequential processors."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import chats as C
from paperloom.operators import events as E
from paperloom.operators import jobs as J
from paperloom.operators import memory as M
from paperloom.operators import policy as P
from paperloom.operators.chunking import chunk_elements, table_chunks
from paperloom.sources import files as S
from paperloom.sources import store as T
from paperloom.sources.html_tables import markdown_table
from paperloom.streaming import processors as Q

from .bindings import chunk_store, elements, messages, sql, table
from .chunk_queries import _TABLES
from .registry import query
from .state_queries import LOG, logged


def enriched(spark, d):
    """Enriched chunks of all documents; one in thirteen has no content, one in seventeen no identity struct."""
    c = chunk_store(spark, d)
    meta = F.struct("section", F.col("chunk_type"), F.concat("company_document_id", F.lit(".pdf")).alias("source_file"), F.length("content").alias("tokens"))
    ident = F.struct("company_document_id", "revision_number", F.col("section").alias("revision_code"))
    return c.select("chunk_id", F.when(F.col("row_id") % 13 != 0, F.col("content")).alias("page_content"), meta.alias("metadata"), F.when(F.col("row_id") % 17 != 0, ident).alias("cmetadata"))


@query("io06_load_enriched", sql("SELECT chunk_id, company_document_id, revision_number, section AS meta_section, section AS meta_code, length(content)::VARCHAR AS meta_tokens FROM chunk_store WHERE row_id % 13 <> 0 AND row_id % 17 <> 0 AND content <> ''", "chunk_store"))
def io06(spark, d):
    m = lambda k: F.element_at("meta", k)
    return T.load_enriched(enriched(spark, d)).select("chunk_id", "company_document_id", "revision_number", m("section").alias("meta_section"), m("revision_code").alias("meta_code"), m("tokens").alias("meta_tokens"))


@query("io10_guarded_rows", sql("SELECT row_id FROM chunk_store WHERE section <> '' AND page IS NOT NULL", "chunk_store"))
def io10(spark, d):
    return T.guarded(chunk_store(spark, d), "section", "page").select("row_id")


@query("io07_html_tables", "SELECT r_regionkey, '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS grid FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def io07(spark, d):
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td> "), F.col("n_name"), F.lit("\n</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x.r), "")
    html = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.lit("<p>x</p><table><tr><th>key</th><th>name</th></tr>"), body, F.lit("</table>")).alias("html"))
    return html.select("r_regionkey", markdown_table(F.col("html")).alias("grid"))


@query("io07_page_tables", "SELECT page_id, '' AS grid FROM pages WHERE NOT contains(html, '<table')")
def io07_pages(spark, d):
    return table(spark, d, "pages").select("page_id", markdown_table(F.col("html")).alias("grid"))


@query("io11_object_manifest", "SELECT source || '/v1/' || doc_id || '.txt' AS object_path, sha256(text) AS sha256 FROM documents")
def io11(spark, d):
    docs = table(spark, d, "documents")
    return S.object_manifest(docs, F.col("source"), F.lit("1"), F.concat(F.lit("/tmp/in/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))


@query("jn07_new_objects", "SELECT source || '/v1/' || doc_id || '.txt' AS object_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn07(spark, d):
    present = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.concat("source", F.lit("/v1/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("object_path"))
    return S.new_objects(io11(spark, d), present).select("object_path")


@query("io12_scaled_boxes", "SELECT vec_id, CASE WHEN vec_id % 4 > 2 THEN round(embedding[1]::DOUBLE * (150.0::DOUBLE / 72), 6)::DECIMAL(12,6) END AS first_x FROM embeddings")
def io12(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: F.array(x.cast("double"), x.cast("double"))).alias("p"))
    points = F.slice("p", F.lit(1), (F.col("vec_id") % 4).cast("int"))
    return v.select("vec_id", F.round(F.get(F.get(S.scaled_box(points), F.lit(0)), F.lit(0)), 6).cast("decimal(12,6)").alias("first_x"))


@query("ag04_next_revision", "SELECT l_orderkey, max(l_linenumber) + 1 AS next_revision FROM lineitem GROUP BY 1")
def ag04(spark, d):
    names = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("name"))
    extra = names.select("l_orderkey").distinct().withColumn("name", F.lit("v10.tmp"))
    return S.next_revisions(names.unionByName(extra), "l_orderkey", "name")


@query("fl04_metadata_exists", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS present FROM customer")
def fl04(spark, d):
    return T.exists(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer").select("c_custkey"), ["c_custkey"])


_IDS = "SELECT DISTINCT chunk_id FROM chunk_store JOIN labels ON doc_id = row_id WHERE quality = 0"


@query("fl05_chunks_by_ids", sql(f"SELECT row_id, chunk_id, 1.0::DOUBLE AS score, coalesce(try_cast(page AS INTEGER), 1) AS page_number, chunk_type FROM chunk_store WHERE chunk_id IN ({_IDS})", "chunk_store"))
def fl05(spark, d):
    ids = chunk_store(spark, d).join(table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("row_id")), "row_id", "left_semi")
    return T.chunks_by_ids(chunk_store(spark, d), ids).select("row_id", "chunk_id", "score", "page_number", "chunk_type")


def _fields(spark, d):
    e, known = table(spark, d, "events"), lambda n, v, c: F.struct(F.lit(n).alias("name"), v.alias("value"), c.cast("double").alias("confidence"))
    title = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, F.lit(None)).otherwise(F.col("event_type"))
    return e.select("event_id", F.array(known("title", title, F.lit(0.9)), known("revision", F.col("event_type"), (F.col("event_id") % 10) / 10), known("number", F.col("event_type"), F.lit(None))).alias("fields"))


_MISSING = "CASE WHEN event_id % 4 < 2 THEN ['title'] ELSE [] END || CASE WHEN event_id % 10 < 6 THEN ['revision'] ELSE [] END || ['number']"


@query("fl08_missing_fields", f"SELECT event_id, array_to_string({_MISSING}, ',') AS missing FROM events")
def fl08(spark, d):
    return _fields(spark, d).select("event_id", F.array_join(T.missing_fields(F.col("fields")), ",").alias("missing"))


@query("fl09_duplicate_revision", f"SELECT event_id, array_to_string({_MISSING} || CASE WHEN event_id IN (SELECT doc_id FROM labels) THEN ['revision_code'] ELSE [] END, ',') AS missing FROM events")
def fl09(spark, d):
    dup = table(spark, d, "labels").select(F.col("doc_id").alias("event_id")).distinct().withColumn("dup", F.lit(True))
    rows = _fields(spark, d).join(dup, "event_id", "left")
    return rows.select("event_id", F.array_join(T.with_duplicate(T.missing_fields(F.col("fields")), F.col("dup")), ",").alias("missing"))


def _maps(spark, d):
    return table(spark, d, "events").select("event_id", F.create_map(F.lit("company_document_id"), F.col("event_type"), F.lit("title"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")), F.lit("revision_number"), F.lit("1")).alias("m"))


@query("fl07_mutable_metadata", "SELECT event_id, 'title' AS keys, event_id >= 0 AS rejected FROM events")
def fl07(spark, d):
    return _maps(spark, d).select("event_id", F.array_join(F.array_sort(F.map_keys(T.mutable_only(F.col("m")))), ",").alias("keys"), F.exists(F.map_keys("m"), lambda k: k.isin(*T.IMMUTABLE)).alias("rejected"))


@query("fl14_form_completeness", "SELECT event_id, event_id % 3 = 0 AS blocked FROM events")
def fl14(spark, d):
    return _maps(spark, d).select("event_id", T.form_blocked(F.col("m"), ["title", "revision_number"]).alias("blocked"))


_LABEL = "CASE quality * 2 + toxic WHEN 2 THEN 'correct' WHEN 3 THEN 'partial' WHEN 0 THEN 'incorrect' ELSE 'hallucination' END"


@query("fl15_feedback_guard", f"SELECT doc_id, {_LABEL} AS label, doc_id % 7 AS score FROM labels WHERE doc_id % 11 <> 0 AND doc_id % 7 BETWEEN 1 AND 5")
def fl15(spark, d):
    k = F.col("quality") * 2 + F.col("toxic")
    label = F.when(k == 2, "correct").when(k == 3, "partial").when(k == 0, "incorrect").otherwise("hallucination")
    rows = table(spark, d, "labels").select("doc_id", label.alias("label"), (F.col("doc_id") % 7).alias("score"), F.when(F.col("doc_id") % 11 != 0, "s").alias("session"))
    none = F.lit(None).cast("string")
    return rows.filter(T.valid_feedback(F.col("session"), none, none, F.col("label"), F.col("score"))).drop("session")


@query("tk05_recent_feedback", f"SELECT doc_id, {_LABEL} AS label FROM labels ORDER BY doc_id DESC LIMIT 100")
def tk05_feedback(spark, d):
    k = F.col("quality") * 2 + F.col("toxic")
    label = F.when(k == 2, "correct").when(k == 3, "partial").when(k == 0, "incorrect").otherwise("hallucination")
    return T.recent(table(spark, d, "labels").select("doc_id", label.alias("label")), 100, "doc_id")


@query("so05_key_validation", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'company_document_id' ELSE '' END AS forbidden, CASE WHEN event_id % 2 = 0 THEN 'title' ELSE 'note,title' END AS allowed FROM events")
def so05(spark, d):
    keys = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("title"), F.lit("company_document_id"))).otherwise(F.array(F.lit("title"), F.lit("note")))
    forbidden, allowed = T.checked_keys(keys)
    return table(spark, d, "events").select("event_id", F.array_join(forbidden, ",").alias("forbidden"), F.array_join(allowed, ",").alias("allowed"))


@query("so06_remaining_fields", "SELECT event_id, CASE event_type WHEN 'click' THEN 'view,error' WHEN 'view' THEN 'click,error' WHEN 'error' THEN 'click,view' ELSE 'click,view,error' END AS remaining FROM events")
def so06(spark, d):
    missing = F.array(F.lit("click"), F.lit("view"), F.lit("error"))
    return table(spark, d, "events").select("event_id", F.array_join(T.remaining_fields(missing, F.col("event_type")), ",").alias("remaining"))


@query("tg06_metadata_merge", sql("SELECT row_id, CASE WHEN company_document_id = 'src3' THEN 'New title' ELSE section END AS title, company_document_id AS doc FROM chunk_store", "chunk_store"))
def tg06(spark, d):
    rows = chunk_store(spark, d).withColumn("meta", F.create_map(F.lit("title"), F.col("section"), F.lit("company_document_id"), F.col("company_document_id")))
    merged = T.merge_metadata(rows, "src3", "1", {"title": "New title", "company_document_id": "other"})
    return merged.select("row_id", F.element_at("meta", "title").alias("title"), F.element_at("meta", "company_document_id").alias("doc"))


@query("tg07_job_metadata_update", sql("SELECT session_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS kind FROM logged GROUP BY 1", **LOG))
def tg07(spark, d):
    rows = J.last_metadata(logged(spark, d), "session_id", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("id"), F.col("event_id").cast("string")), "event_id")
    return rows.select("session_id", F.element_at("metadata", "id").cast("bigint").alias("last_event"), F.element_at("metadata", "kind").alias("kind"))


@query("tk07_preview", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3")
def tk07(spark, d):
    return T.preview(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("po01_policy_disabled", sql("SELECT row_id, false AS policy_applied, 'policy_disabled' AS policy_reason FROM chunk_store", "chunk_store"))
def po01(spark, d):
    return P.apply_policy(chunk_store(spark, d).select("row_id", "content")).drop("content")


@query("pj12_policy_result", sql("SELECT true AS valid, count(*) AS n FROM chunk_store", "chunk_store"))
def pj12(spark, d):
    return P.valid_result(P.apply_policy(chunk_store(spark, d), lambda c: c.filter(F.col("content").isNotNull()))).select("valid", "n")


def s_limited(source: str, keys: str, most: int, seconds: int) -> str:
    """SQL of the limiter over rows (keys, event_id, t): one step for each request of a key, with the admitted times so far."""
    same = " AND ".join(f"s.{k} IS NOT DISTINCT FROM r.{k}" for k in keys.split(", "))
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE {source}, numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, event_id) AS n FROM rows_of),
      r AS (SELECT {keys}, event_id, n, [t] AS times, true AS admitted FROM numbered WHERE n = 1
        UNION ALL SELECT {own}, s.event_id, s.n, CASE WHEN len(s.live) < {most} THEN list_append(s.live, s.t) ELSE s.live END, len(s.live) < {most}
        FROM (SELECT s.*, list_filter(r.times, lambda x: x >= s.t - {seconds}) AS live FROM r JOIN numbered s ON {same} AND s.n = r.n + 1) s)
      SELECT {keys}, event_id, admitted FROM r"""


_ROWS_OF = "rows_of AS (SELECT user_id AS session_id, event_id, epoch_us(ts)::DOUBLE / 1e6 AS t FROM events)"


@query("st03_rate_limiter", s_limited(_ROWS_OF, "session_id", 3, 86400))
def st03(spark, d):
    """Requests of a session, at most three a day."""
    rows = logged(spark, d).select("session_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t"))
    return Q.fold(rows, ["session_id"], [F.col("t"), F.col("event_id")], lambda: Q.Limiter(3, 86400), "session_id bigint, event_id bigint, admitted boolean")


@query("st05_stream_frames")
def st05(spark, d):
    line = E.event_line(E.event("PROGRESS", value=F.lit(5), label=F.col("role")))
    rest = lambda n: F.coalesce(F.substring(F.col("content"), F.lit(n), F.length("content")), F.lit(""))
    pieces = F.when(F.col("turn") % 2 == 0, F.array(F.substring("content", 1, 30), F.concat(line, rest(31)))).otherwise(F.array(F.substring("content", 1, 10), rest(11)))
    rows = messages(spark, d).select(F.col("session_id").alias("stream_id"), "turn", F.posexplode(pieces).alias("k", "chunk")).select("stream_id", (F.col("turn") * 10 + F.col("k")).alias("seq"), "chunk")
    return Q.fold(rows, ["stream_id"], [F.col("seq")], Q.FrameParser, "stream_id bigint, seq bigint, kind string, value string")


_JOB_STEPS = """WITH RECURSIVE numbered AS (
    SELECT user_id AS session_id, event_id AS seq, 'job-' || event_id AS job_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'update' WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'error' ELSE 'clear' END AS action,
      CASE WHEN event_id % 2 = 0 THEN ['title'] ELSE [] END AS missing, ['title'] AS given, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  r AS (SELECT DISTINCT session_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS status, []::VARCHAR[] AS missing, NULL::VARCHAR AS job, NULL::VARCHAR AS told, NULL::VARCHAR AS before, false AS accepted FROM numbered
    UNION ALL SELECT session_id, n, seq,
      CASE WHEN action = 'create' THEN CASE WHEN len(own) > 0 THEN 'WAIT_FOR_METADATA' ELSE 'PROCESSING' END WHEN NOT ok THEN status WHEN action = 'update' THEN CASE WHEN len(rest) = 0 THEN 'PROCESSING' ELSE status END
        WHEN action = 'ready' THEN 'READY' WHEN action = 'error' THEN 'ERROR' END,
      CASE WHEN action = 'create' THEN own WHEN action = 'clear' AND ok THEN [] WHEN action = 'update' AND ok THEN rest ELSE missing END,
      CASE WHEN action = 'create' THEN job_id WHEN action = 'clear' AND ok THEN NULL ELSE job END, CASE WHEN action = 'create' THEN job_id ELSE job END,
      CASE WHEN action = 'create' AND status IS NOT NULL THEN job END, ok
    FROM (SELECT s.session_id, s.n, s.seq, s.action, s.job_id, s.missing AS own, r.status, r.missing, r.job, list_filter(r.missing, lambda x: NOT list_contains(s.given, x)) AS rest,
        CASE s.action WHEN 'create' THEN true WHEN 'update' THEN coalesce(r.status = 'WAIT_FOR_METADATA', false) WHEN 'ready' THEN coalesce(r.status = 'PROCESSING', false) ELSE r.status IS NOT NULL END AS ok
      FROM r JOIN numbered s ON s.session_id = r.session_id AND s.n = r.n + 1))
  SELECT session_id, seq, told AS job_id, status, accepted FROM r WHERE n > 0 UNION ALL SELECT session_id, seq, before, 'ERROR', true FROM r WHERE before IS NOT NULL"""


@query("st07_job_states", _JOB_STEPS)
def st07(spark, d):
    kind = F.col("event_type")
    action = F.when(kind == "signup", "create").when(kind == "view", "update").when(kind == "purchase", "ready").when(kind == "error", "error").otherwise("clear")
    rows = logged(spark, d).select("session_id", F.col("event_id").alias("seq"), F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"), action.alias("action"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("title"))).otherwise(F.array().cast("array<string>")).alias("missing"), F.array(F.lit("title")).alias("given"))
    return Q.fold(rows, ["session_id"], [F.col("seq")], Q.Jobs, "session_id bigint, seq bigint, job_id string, status string, accepted boolean")


def lines_parser(content: bytes):
    """A stand-in for a PDF parser: ten lines a page; a page that begins with a blank line fails."""
    lines = content.decode().split("\n")
    for k in range(0, len(lines), 10):
        page = lines[k : k + 10]
        yield None if not page[0].strip() else [("Title" if k + n == 0 else "NarrativeText", t) for n, t in enumerate(page)]


_PAGES = """SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS seq, CASE WHEN k = 1 THEN 'Title' ELSE 'NarrativeText' END AS category, l[k] AS text, (1 + (k - 1) // 10)::INTEGER AS page_number
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(l[1 + ((k - 1) // 10) * 10]) <> ''"""


def _files(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))


@query("io01_pages_of_files", _PAGES)
def io01(spark, d):
    return S.parse_pdfs(_files(spark, d), lines_parser)


@query("io02_first_pages_of_files", f"SELECT * FROM ({_PAGES}) WHERE page_number = 1")
def io02(spark, d):
    return S.parse_pdfs(_files(spark, d), lines_parser, max_pages=1)


@query("io04_element_json_round_trip", sql("SELECT doc_id, seq, category, text, page_number FROM elements", "elements"))
def io04(spark, d):
    path = S.scratch_folder(spark)
    S.write_json(elements(spark, d), path)
    return S.read_elements(spark, path).select("doc_id", "seq", "category", "text", "page_number")


@query("io05_chunk_json_round_trip", sql("SELECT doc_id, seq, chunk_index, type, section, is_parent, page_number, content, table_id, parent_id FROM chunks", "elements", **_TABLES))
def io05(spark, d):
    path = S.scratch_folder(spark)
    S.write_json(table_chunks(elements(spark, d)), path)
    return S.read_chunks(spark, path)


@query("io05_all_chunk_json_round_trip")
def io05_all(spark, d):
    path = S.scratch_folder(spark)
    S.write_json(chunk_elements(elements(spark, d)), path, "gzip")
    return S.read_chunks(spark, path)


@query("io08_store_append", sql("SELECT company_document_id, count(*) + count(DISTINCT chunk_id) AS n FROM chunk_store GROUP BY 1", "chunk_store"))
def io08(spark, d):
    path, rows = S.scratch_folder(spark), chunk_store(spark, d).select("chunk_id", "company_document_id", "revision_number", "content")
    T.append_store(rows, path)
    T.append_store(rows, path, once=True)
    return spark.read.parquet(path).groupBy("company_document_id").agg(F.count(F.lit(1)).alias("n"))


@query("io09_log_append", sql("SELECT row_id, section FROM chunk_store WHERE page <> ''", "chunk_store"))
def io09(spark, d):
    path = S.scratch_folder(spark)
    T.append_log(chunk_store(spark, d).select("row_id", "section", "page"), path, "section", "page")
    return spark.read.parquet(path).select("row_id", "section")


@query("io13_client_store", sql("SELECT session_id AS id, '' AS title, 'base' AS model, false AS pinned, count(*)::INTEGER AS n_messages FROM messages WHERE session_id % 9 <> 0 GROUP BY 1", "messages"))
def io13(spark, d):
    """Stored chats read back with defaults; a corrupt one is reset (it is gone)."""
    stored = messages(spark, d).groupBy("session_id").agg(F.to_json(F.struct(F.col("session_id").alias("id"), F.collect_list(F.struct("role", "content")).alias("messages"))).alias("json"))
    broken = F.when(F.col("session_id") % 9 == 0, F.substring("json", 1, 5)).otherwise(F.col("json"))
    rows = stored.select(C.stored_chats(broken).alias("c")).filter("c IS NOT NULL")
    return rows.select("c.id", "c.title", "c.model", "c.pinned", F.size("c.messages").alias("n_messages"))


@query("io14_truncated_store", "SELECT 0::BIGINT AS n")
def io14(spark, d):
    path, rows = S.scratch_folder(spark), table(spark, d, "region")
    T.append_log(rows, path, "r_name")
    T.truncate(path, rows)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("mu04_revision_overwrite", sql("SELECT row_id, company_document_id, CASE WHEN company_document_id = 'src3' THEN 'new' ELSE section END AS title FROM chunk_store", "chunk_store"))
def mu04(spark, d):
    path = S.scratch_folder(spark)
    rows = chunk_store(spark, d).select("row_id", "company_document_id", "revision_number", F.create_map(F.lit("title"), F.col("section")).alias("meta"))
    T.append_store(rows, path)
    T.overwrite_revision(T.merge_metadata(spark.read.parquet(path).filter("company_document_id = 'src3'").withColumn("revision_number", F.col("revision_number").cast("string")), "src3", "1", {"title": "new"}), path)
    return spark.read.parquet(path).select("row_id", F.col("company_document_id").cast("string").alias("company_document_id"), F.element_at("meta", "title").alias("title"))


_PARENTS = "SELECT c.row_id, p.row_id AS parent_row FROM chunk_store c LEFT JOIN (SELECT table_id, min(row_id) AS row_id FROM chunk_store WHERE chunk_type = 'parent' GROUP BY 1) p ON p.table_id = c.parent_id WHERE c.chunk_type = 'child'"


def _parents(spark, d):
    return T.parents_of(chunk_store(spark, d))


@query("fl13_parent_predicate", sql(f"SELECT * FROM ({_PARENTS}) WHERE parent_row IS NOT NULL", "chunk_store"))
def fl13(spark, d):
    return _parents(spark, d).filter("parent_row IS NOT NULL")


@query("tk06_parent_lookup", sql(_PARENTS, "chunk_store"))
def tk06(spark, d):
    return _parents(spark, d)


@query("tk08_clamped_counts", "SELECT event_id, greatest(1, least(event_id - 100, 200)) AS n FROM events")
def tk08(spark, d):
    return table(spark, d, "events").select("event_id", M.clamped(F.col("event_id") - 100, 200).alias("n"))


@query("sc34_box_points", "SELECT vec_id, round(embedding[2]::DOUBLE * (150.0::DOUBLE / 72), 6)::DECIMAL(12,6) AS y FROM embeddings")
def sc34(spark, d):
    box = S.scaled_box(F.transform(F.slice("embedding", 1, 3), lambda x: F.array(x.cast("double"), x.cast("double"))))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(F.get(box, F.lit(1)), F.lit(1)), 6).cast("decimal(12,6)").alias("y"))


@query("sc38_net_model", "SELECT event_id, provider, provider || '-' || CASE event_id % 2 WHEN 0 THEN 'rank_1' ELSE 'rank_2' END AS model FROM (SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'xai' END, CASE WHEN event_id % 5 <> 0 THEN 'groq' END) AS provider FROM events)")
def sc38(spark, d):
    i = F.col("event_id")
    provider, model = E.net_model(F.when(i % 3 == 0, "xai"), F.when(i % 5 != 0, "groq"), F.when(i % 2 == 0, "rank_1").otherwise("rank_2"))
    return table(spark, d, "events").select("event_id", provider.alias("provider"), model.alias("model"))


_EPOCHS_OF = "rows_of AS (SELECT user_id AS session_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch, event_id, epoch_us(ts)::DOUBLE / 1e6 AS t FROM events)"


@query("st13_limiter_reset", s_limited(_EPOCHS_OF, "session_id, epoch", 2, 86400))
def st13(spark, d):
    """The limiter with a reset at each signup: a client's requests between resets are limited by themselves."""
    from pyspark.sql import Window

    rows = logged(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6)
    epoch = F.sum((F.col("event_type") == "signup").cast("int")).over(Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return Q.fold(rows.withColumn("epoch", epoch).select("session_id", "epoch", "event_id", "t"), ["session_id", "epoch"], [F.col("t"), F.col("event_id")], lambda: Q.Limiter(2, 86400), "session_id bigint, epoch bigint, event_id bigint, admitted boolean")
