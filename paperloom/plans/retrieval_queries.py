"""Search, reranking, confidence and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import confidence as K
from paperloom.operators import retrieval as R
from paperloom.sources import store as T

from .bindings import chunk_store, retrieved, revisions, sql, table, vectors
from .registry import query
from .text_queries import s_in, s_keywords

COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
SIM = "round(" + COS.format(a="q.vector", b="s.embedding") + ", 6)::DECIMAL(12,6)"


def query_vectors(spark, d):
    """The stated query set: every stored vector whose id is divisible by 20."""
    v = vectors(spark, d).filter("vec_id % 20 = 0")
    return v.select(F.col("vec_id").alias("qid"), "company_document_id", "revision_number", F.col("embedding").alias("vector"))


_Q = "SELECT vec_id AS qid, company_document_id, revision_number, embedding AS vector FROM vectors WHERE vec_id % 20 = 0"


def _topk(k: int, on: str) -> str:
    return f"SELECT qid, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.qid, s.chunk_id, {SIM} AS score FROM q JOIN vectors s ON {on})) WHERE rank <= {k}"


_SAME = "s.company_document_id = q.company_document_id AND s.revision_number = q.revision_number"


@query("tk01_vector_topk", sql(_topk(25, _SAME), "vectors", q=_Q))
def tk01(spark, d):
    return R.vector_search(query_vectors(spark, d), vectors(spark, d))


@query("tk01_vector_topk_detailed", sql(_topk(35, _SAME), "vectors", q=_Q))
def tk01_detailed(spark, d):
    return R.vector_search(query_vectors(spark, d), vectors(spark, d), R.DETAILED_CANDIDATES)


@query("jn01_similarity_scores", sql(f"SELECT q.qid, s.chunk_id, {SIM} AS score FROM q JOIN vectors s ON {_SAME}", "vectors", q=_Q))
def jn01(spark, d):
    return R.similarity_scores(query_vectors(spark, d), vectors(spark, d))


@query("tk02_global_topk", sql(_topk(5, "true"), "vectors", q=_Q))
def tk02(spark, d):
    return R.global_search(query_vectors(spark, d), vectors(spark, d))


_LATEST = "SELECT s.* FROM vectors s JOIN (SELECT company_document_id, max(try_cast(revision_number AS INTEGER)) AS latest FROM vectors GROUP BY 1) m ON m.company_document_id = s.company_document_id AND m.latest = try_cast(s.revision_number AS INTEGER)"


@query("tk02_latest_revision_topk", sql(_topk(5, "true").replace("JOIN vectors s", "JOIN latest s"), "vectors", q=_Q, latest=_LATEST))
def tk02_latest(spark, d):
    return R.global_search(query_vectors(spark, d), R.of_latest_revision(vectors(spark, d)))


@query("sc25_normalize_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4)::DECIMAL(12,4) AS norm2, len(embedding)::INTEGER AS n FROM embeddings")
def sc25(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", R.rounded(R.squared_norm(F.col("embedding")), 4).alias("norm2"), F.size("embedding").alias("n"))


@query("sc26_neighbour_similarity", f"SELECT q.vec_id, round({COS.format(a='q.embedding', b='s.embedding')}, 6)::DECIMAL(12,6) AS score FROM embeddings q JOIN embeddings s ON s.vec_id = q.vec_id + 1")
def sc26(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", R.rounded(R.cosine(F.col("embedding"), F.col("other"))).alias("score"))


@query("wn03_latest_revision", sql("SELECT company_document_id, revision_number FROM (SELECT *, rank() OVER (PARTITION BY company_document_id ORDER BY try_cast(revision_number AS INTEGER) DESC) AS r FROM revisions) WHERE r = 1", "revisions"))
def wn03(spark, d):
    return R.of_latest_rank(revisions(spark, d))


@query("ag03_latest_revision", sql("SELECT company_document_id, max(try_cast(revision_number AS INTEGER)) AS latest FROM revisions GROUP BY 1", "revisions"))
def ag03(spark, d):
    return R.latest_revisions(revisions(spark, d))


@query("jn06_rows_of_latest_revision", sql("SELECT s.* FROM revisions s JOIN (SELECT company_document_id, max(try_cast(revision_number AS INTEGER)) AS latest FROM revisions GROUP BY 1) m ON m.company_document_id = s.company_document_id AND m.latest = try_cast(s.revision_number AS INTEGER)", "revisions"))
def jn06(spark, d):
    return R.of_latest_revision(revisions(spark, d)).select("company_document_id", "revision_number")


def asked(spark, d):
    """All benchmark items as questions about one source each."""
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("company_document_id"), F.lit("1").alias("revision_number"))


_ASKED = "SELECT item_id AS qid, text AS question, 'src' || (item_id % 20) AS company_document_id, '1' AS revision_number FROM benchmark"
_KEYWORD = {
    "asked": _ASKED,
    "kw": f"SELECT *, {s_keywords('question')} AS keywords FROM asked",
    "hits": """SELECT qid, chunk_id, n, h, row_number() OVER (PARTITION BY qid ORDER BY n, chunk_id)::INTEGER AS rank FROM (SELECT q.qid, s.chunk_id, length(s.content) AS n, md5(s.content) AS h
      FROM kw q JOIN (SELECT *, lower(content) AS body FROM chunk_store) s ON s.company_document_id = q.company_document_id AND s.revision_number = q.revision_number WHERE len(list_filter(q.keywords, lambda k: contains(s.body, k))) > 0)""",
    "keyword_hits": "SELECT qid, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, h ORDER BY rank) AS again FROM hits WHERE rank <= 10) WHERE again = 1",
}


@query("tk03_keyword_topk", sql("SELECT * FROM keyword_hits", "chunk_store", **_KEYWORD))
def tk03(spark, d):
    return R.keyword_search(asked(spark, d), chunk_store(spark, d))


@query("jn08_keyword_containment", sql("SELECT qid, count(*) AS n_chunks FROM hits GROUP BY 1", "chunk_store", **_KEYWORD))
def jn08(spark, d):
    return R.keyword_counts(asked(spark, d), chunk_store(spark, d))


@query("fl03_keyword_guard", sql("SELECT qid, len(keywords) > 0 AND company_document_id IS NOT NULL AS searchable FROM kw", "chunk_store", **_KEYWORD))
def fl03(spark, d):
    return asked(spark, d).select("qid", R.searchable(asked(spark, d)).alias("searchable"))


@query("fl02_metadata_equality", sql("SELECT chunk_id, row_id FROM chunk_store WHERE company_document_id = 'src3' AND revision_number = '1' AND section = 'en'", "chunk_store"))
def fl02(spark, d):
    return T.of_metadata(chunk_store(spark, d), {"company_document_id": "src3", "revision_number": 1, "section": "en"}).select("chunk_id", "row_id")


@query("fl06_rows_with_identity", sql("SELECT count(*) AS n FROM chunk_store WHERE chunk_id IS NOT NULL AND chunk_id <> ''", "chunk_store"))
def fl06(spark, d):
    return T.with_identity(chunk_store(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("pj01_formatted_results", sql("SELECT chunk_id, content, section, chunk_type, coalesce(try_cast(page AS INTEGER), 1) AS page_number, company_document_id || '.pdf' AS source_file FROM chunk_store", "chunk_store"))
def pj01(spark, d):
    return R.formatted(chunk_store(spark, d)).drop("bbox")


@query("pj02_parsed_boxes", sql("SELECT row_id, CASE WHEN starts_with(bbox, '[') THEN 2 ELSE 0 END::INTEGER AS n_points, CASE WHEN starts_with(bbox, '[') THEN (row_id % 7)::DOUBLE END AS last_y FROM chunk_store", "chunk_store"))
def pj02(spark, d):
    rows = R.formatted(chunk_store(spark, d).withColumn("section", F.col("row_id")))
    return rows.select(F.col("section").alias("row_id"), F.size("bbox").alias("n_points"), F.get(F.get("bbox", F.lit(1)), F.lit(1)).alias("last_y"))


_HYBRID = _KEYWORD | {
    "vec_store": "SELECT s.company_document_id, s.revision_number, s.chunk_id, arg_min(e.embedding, s.row_id) AS embedding FROM chunk_store s JOIN embeddings e ON e.vec_id = s.row_id GROUP BY ALL",
    "vec_hits": f"""SELECT qid, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM (SELECT q.qid, s.chunk_id, {SIM} AS score
      FROM (SELECT a.*, e.embedding AS vector FROM asked a JOIN embeddings e ON e.vec_id = a.qid) q JOIN vec_store s ON {_SAME})) WHERE rank <= 25""",
    "united": "SELECT qid, chunk_id, min(pos)::INTEGER AS pos, arg_max(origin, pos) AS origin FROM (SELECT qid, chunk_id, rank AS pos, 'vector' AS origin FROM vec_hits UNION ALL SELECT qid, chunk_id, rank + 1000, 'keyword' FROM keyword_hits) GROUP BY 1, 2",
}


def _hybrid_hits(spark, d, profile="documented"):
    store = chunk_store(spark, d)
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    of_store = store.join(vec, "row_id").groupBy("company_document_id", "revision_number", "chunk_id").agg(F.min_by("embedding", "row_id").alias("embedding"))
    questions = asked(spark, d).join(vec.select(F.col("row_id").alias("qid"), F.col("embedding").alias("vector")), "qid")
    return R.union_hits(R.vector_search(questions, of_store), R.keyword_search(asked(spark, d), store), profile)


@query("so01_union_hits", sql("SELECT * FROM united", "chunk_store", **_HYBRID))
def so01(spark, d):
    return _hybrid_hits(spark, d)


@query("so01_union_hits_observed", sql("SELECT qid, chunk_id, rank AS pos, 'vector' AS origin FROM vec_hits", "chunk_store", **_HYBRID))
def so01_observed(spark, d):
    return _hybrid_hits(spark, d, "observed")


def reranked(spark, d):
    return R.rerank(R.candidates(_hybrid_hits(spark, d), chunk_store(spark, d), asked(spark, d)))


_RERANK = _HYBRID | {
    "contents": "SELECT chunk_id, arg_min(content, row_id) AS content, arg_min(section, row_id) AS section, min_by(chunk_type, row_id) AS chunk_type, (list(parent_id ORDER BY row_id))[1] AS parent_id FROM chunk_store GROUP BY 1",
    "scored": """SELECT u.qid, u.chunk_id, u.pos, c.section, c.chunk_type, c.parent_id,
      CASE WHEN len(k.keywords) = 0 THEN 0 ELSE round(len(list_filter(k.keywords, lambda w: contains(lower(c.content), w)))::DOUBLE / len(k.keywords), 6) END::DECIMAL(12,6) AS score
      FROM united u JOIN contents c USING (chunk_id) JOIN kw k ON k.qid = u.qid""",
    "ranked": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos, chunk_id)::INTEGER AS rank FROM scored) WHERE rank <= 8",
}


@query("tk04_rerank", sql("SELECT qid, chunk_id, score, rank FROM ranked", "chunk_store", **_RERANK))
def tk04(spark, d):
    return reranked(spark, d).select("qid", "chunk_id", "score", "rank")


_RESOLVED = _RERANK | {
    "resolved": """SELECT qid, chunk_id, score, rank AS place FROM ranked WHERE NOT coalesce(chunk_type = 'child' AND parent_id IS NOT NULL, false)
      UNION ALL SELECT w.qid, p.chunk_id, 0::DECIMAL(12,6), w.rank + 10000 FROM (SELECT qid, parent_id, min(rank) AS rank FROM ranked WHERE chunk_type = 'child' AND parent_id IS NOT NULL GROUP BY 1, 2) w
      JOIN (SELECT table_id AS parent_id, min(chunk_id) AS chunk_id FROM chunk_store WHERE chunk_type = 'parent' GROUP BY 1) p USING (parent_id)""",
}


@query("jn02_resolve_parents", sql("SELECT * FROM resolved", "chunk_store", **_RESOLVED))
def jn02(spark, d):
    return R.resolve_parents(reranked(spark, d), chunk_store(spark, d))


@query("jn02_resolve_parents_observed", sql("SELECT qid, chunk_id, score, rank AS place FROM ranked", "chunk_store", **_RERANK))
def jn02_observed(spark, d):
    return R.resolve_parents(reranked(spark, d), chunk_store(spark, d), "observed")


def _as_chunks(spark, d):
    placed = jn02(spark, d)
    of_store = chunk_store(spark, d).select("chunk_id", "row_id", F.struct("section", "chunk_type").alias("chunk"))
    rows = of_store.join(placed, "chunk_id").groupBy("qid", "chunk_id", "score", "place").agg(F.min_by("chunk", "row_id").alias("chunk")).select("qid", "score", "place", "chunk.*")
    return rows.select(F.col("qid").cast("string").alias("query_id"), F.col("place").alias("rank"), "section", "chunk_type", F.col("score").cast("decimal(10,6)").alias("score"))


def s_confidence(source: str) -> dict[str, str]:
    """Common table expressions up to `conf` over rows (query_id, section, score)."""
    return {
        "per": f"""SELECT query_id, count(*) AS n, count(nullif(section, '')) AS n_sections, count(DISTINCT nullif(section, '')) AS sections,
          coalesce(list(greatest(0, least(1, score)) ORDER BY score DESC) FILTER (greatest(0, least(1, score)) >= 0.15), []) AS scores FROM {source} GROUP BY 1""",
        "sig": """SELECT *, (least(n, 5)::DECIMAL(10,6) / 5)::DECIMAL(10,6) AS count_score, CASE WHEN len(scores) = 1 THEN scores[1] ELSE round_even((0.7 * scores[1] + 0.3 * scores[2])::DECIMAL(12,8), 2) END::DECIMAL(10,6) AS strength,
          CASE WHEN n_sections = 0 THEN 0.4 WHEN sections = 1 THEN 0.3 WHEN sections * 10 <= n_sections * 4 THEN 1.0 WHEN sections * 10 <= n_sections * 6 THEN 0.8 WHEN sections * 10 <= n_sections * 8 THEN 0.6 ELSE 0.4 END::DECIMAL(10,6) AS redundancy FROM per""",
        "val": """SELECT *, len(scores) = 0 OR scores[1] <= 0.15 AS weak, CASE WHEN len(scores) = 0 OR scores[1] <= 0.15 THEN 0.15 ELSE round_even(least(1, 0.30 * count_score + 0.50 * strength + 0.20 * redundancy)::DECIMAL(12,8), 2) END::DECIMAL(10,6) AS confidence FROM sig""",
        "conf": "SELECT query_id, confidence, CASE WHEN weak THEN 'low' WHEN confidence >= 0.75 AND sections >= 2 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM val",
    }


_CHUNKS_OF = {"rows_of": "SELECT r.qid::VARCHAR AS query_id, r.place AS rank, c.section, c.chunk_type, r.score::DECIMAL(10,6) AS score FROM resolved r JOIN contents c USING (chunk_id)"}


@query("entry_hybrid_retrieval", sql("SELECT * FROM conf", "chunk_store", **_RESOLVED, **_CHUNKS_OF, **s_confidence("rows_of")))
def entry_hybrid(spark, d):
    """Question to confidence: hybrid search, rerank, parent resolution, confidence."""
    return K.confidence(_as_chunks(spark, d))


_CONF = s_confidence("retrieved")


@query("ag09_confidence", sql("SELECT * FROM conf", "retrieved", **_CONF))
def ag09(spark, d):
    return K.confidence(retrieved(spark, d))


@query("ag10_count_score", sql("SELECT query_id, count_score FROM sig", "retrieved", **_CONF))
def ag10(spark, d):
    return K.signals(retrieved(spark, d)).select("query_id", "count_score")


@query("ag11_similarity_strength", sql("SELECT query_id, strength FROM sig", "retrieved", **_CONF))
def ag11(spark, d):
    return K.signals(retrieved(spark, d)).select("query_id", "strength")


@query("ag12_redundancy", sql("SELECT query_id, redundancy FROM sig", "retrieved", **_CONF))
def ag12(spark, d):
    return K.signals(retrieved(spark, d)).select("query_id", "redundancy")


@query("ag13_levels", sql("SELECT level, count(*) AS n FROM conf GROUP BY 1", "retrieved", **_CONF))
def ag13(spark, d):
    return K.confidence(retrieved(spark, d)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("ag14_sanitized_scores", sql("SELECT query_id, len(scores)::INTEGER AS kept, scores[1]::DECIMAL(10,6) AS best FROM per", "retrieved", **_CONF))
def ag14(spark, d):
    return K.signals(retrieved(spark, d)).select("query_id", F.col("n_scores").alias("kept"), "best")


_STATS = """SELECT query_id, count(*)::INTEGER AS chunk_count, list(chunk_type ORDER BY rank) FILTER (chunk_type <> '') AS ts, list(section ORDER BY rank) FILTER (section <> '') AS ss,
  round_even((sum(score)::DECIMAL(20,10) / count(*))::DECIMAL(20,10), 4)::DECIMAL(10,4) AS avg_score, round_even(max(score), 4)::DECIMAL(10,4) AS max_score FROM retrieved GROUP BY 1"""
_STATS_ROWS = """SELECT query_id, chunk_count, coalesce(array_to_string(list_slice(list_filter(ts, lambda v, i: list_position(ts, v) = i), 1, 5), ','), '') AS chunk_types,
  coalesce(array_to_string(list_slice(list_filter(ss, lambda v, i: list_position(ss, v) = i), 1, 10), ','), '') AS sections, avg_score, max_score FROM st"""


@query("ag08_retrieval_stats", sql(_STATS_ROWS, "retrieved", st=_STATS))
def ag08(spark, d):
    return K.retrieval_stats(retrieved(spark, d))


@query("ag05_score_stats", sql(f"SELECT query_id, avg_score, max_score FROM ({_STATS_ROWS})", "retrieved", st=_STATS))
def ag05(spark, d):
    return K.retrieval_stats(retrieved(spark, d)).select("query_id", "avg_score", "max_score")


@query("ag06_first_chunk_types", sql(f"SELECT query_id, chunk_types FROM ({_STATS_ROWS})", "retrieved", st=_STATS))
def ag06(spark, d):
    return K.retrieval_stats(retrieved(spark, d)).select("query_id", "chunk_types")


@query("ag07_first_sections", sql(f"SELECT query_id, sections FROM ({_STATS_ROWS})", "retrieved", st=_STATS))
def ag07(spark, d):
    return K.retrieval_stats(retrieved(spark, d)).select("query_id", "sections")


@query("tk05_recent_stats", sql("SELECT query_id, rank, created_at FROM retrieved ORDER BY created_at DESC, rank DESC LIMIT 100", "retrieved"))
def tk05(spark, d):
    return T.recent(retrieved(spark, d).select("query_id", "rank", "created_at"), 100, "created_at", "rank")


@query("so03_content_dedupe", sql("SELECT md5(content) AS h, min(row_id) AS row_id FROM chunk_store GROUP BY 1", "chunk_store"))
def so03(spark, d):
    return T.by_content(chunk_store(spark, d))


@query("so07_keyword_dedupe", sql(f"SELECT qid, len({s_keywords('question')})::INTEGER AS n_keywords, len(list_filter(regexp_extract_all(lower(question), '[a-z0-9\\-.]+'), lambda x: len(x) >= 3 AND NOT {s_in('x', X.STOP_TOKENS)}))::INTEGER AS n_tokens FROM asked", asked=_ASKED))
def so07(spark, d):
    tokens = F.filter(F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z0-9\-.]+"), 0), lambda t: (F.length(t) >= 3) & ~t.isin(*X.STOP_TOKENS))
    return asked(spark, d).select("qid", F.size(F.array_distinct(tokens)).alias("n_keywords"), F.size(tokens).alias("n_tokens"))
