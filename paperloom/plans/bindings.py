"""Canonical views of the data model over the driver's tables: each as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Questions that reach every branch of the text rules; their ids are negative.
PHRASES = (
    "hi", "Hello", "good morning", "hey there friend", "history of the field layout", "highest pressure", "ok", "Thanks", "abc", "p1", "why?", "explain more",
    "tell me more", "What is the NDU-101 pressure in Table 8-4. Pressure?", "what is a separator", "define flange", "How does this work", "compare it with the previous one",
    "list list all valve types and flange sizes", "What is the water depth at the Agogo-1ST1 well?", "give the maximum pressure of pump 7", "Hiiii   there!!!", "What is NDU-101?!?",
    "10000 bar", "a_b é-ü", "Table 8-4...", "!!?? ok", "", "   ", "1O1 5l6 and 1 2 3", "12 34 5o6", "in short, how many wells", "explain fully why the same valve is used above",
    "state the design life in detail", "more info on that", "the quick brown fox", "describe the flare", "minimum temperature", "how much gas is flared", "details", "same again", "clarify the above",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def phrases(spark: SparkSession) -> DataFrame:
    """(qid, question) of the fixed phrases."""
    return spark.createDataFrame([(-1 - k, p) for k, p in enumerate(PHRASES)], "qid bigint, question string")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): the phrases, all benchmark texts and all user messages."""
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 2).alias("qid"), F.col("text").alias("question"))
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").select(((F.col("conv_id") * 1000 + F.col("turn")) * 2 + 1).alias("qid"), F.col("text").alias("question"))
    return phrases(spark).unionByName(items).unionByName(said)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed elements: the lines of all documents, and for each region a title, a table of its nations and a closing line."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    seq = F.col("seq").cast("bigint")
    category = F.when(F.col("seq") == 0, "Title").when(F.col("seq") % 7 == 0, "ListItem").when(F.col("seq") % 11 == 5, "Header").when(F.col("seq") % 13 == 9, "UncategorizedText").otherwise("NarrativeText")
    of_docs = lines.select("doc_id", seq.alias("seq"), category.alias("category"), "text", (F.lit(1) + F.floor(F.col("seq") / 10)).cast("int").alias("page_number"))
    row = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    grids = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x.r), "\n").alias("grid"))
    regions = table(spark, sf_dir, "region").join(grids, F.col("r_regionkey") == F.col("n_regionkey"))
    part = lambda k, cat, text, page: F.struct(F.lit(k).cast("bigint").alias("seq"), F.lit(cat).alias("category"), text.alias("text"), F.lit(page).alias("page_number"))
    parts = F.array(
        part(0, "Title", F.concat(F.lit("Region "), "r_name"), 1),
        part(1, "NarrativeText", F.lit("Nations 1 0 0 of the region:"), 1),
        part(2, "Table", F.concat(F.lit("| key | name |\n|---|---|\n"), "grid"), 2),
        part(3, "NarrativeText", F.lit("After table:"), 2),
        part(4, "NarrativeText", F.lit("ok"), 3),
    )
    of_regions = regions.select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.*")
    return of_docs.unionByName(of_regions)


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed elements as a parser gives them: for each customer a title, a table of all orders (as HTML, but for every fifth customer) with its box, and a line."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"))
    cells = F.struct("o_orderkey", F.concat(F.lit("<tr><td>"), "key", F.lit("</td><td> "), "status", F.lit("</td></tr>")).alias("html"), F.concat(F.lit("| "), "key", F.lit(" | "), "status", F.lit(" |")).alias("line"))
    of = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(cells)).alias("rows"))
    html = F.concat(F.lit("<p>x</p><table><tr><th>key</th><th>status</th></tr>"), F.array_join(F.transform("rows", lambda r: r.html), ""), F.lit("</table>"))
    grid = F.concat(F.lit("| key | status |\n|---|---|\n"), F.array_join(F.transform("rows", lambda r: r.line), "\n"))
    plain = F.col("o_custkey") % 5 == 0
    x = (F.col("o_custkey") % 100).cast("double")
    points = F.array(F.array(x, F.lit(1.5)), F.array(x + 0.25, F.lit(20.0)))
    none = F.lit(None)
    part = lambda k, cat, text, html, points: F.struct(F.lit(k).cast("bigint").alias("seq"), F.lit(cat).alias("category"), text.alias("text"), html.cast("string").alias("text_as_html"), points.cast("array<array<double>>").alias("points"))
    parts = F.array(part(0, "Title", F.concat(F.lit("Customer no "), F.col("o_custkey").cast("string")), none, none), part(1, "Table", F.when(plain, grid).otherwise("key status"), F.when(~plain, html), points), part(2, "NarrativeText", F.lit("After the table."), none, none))
    return of.select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("doc_id"), (F.col("o_custkey") % 7 + 1).cast("int").alias("page_number"), F.explode(parts).alias("p")).select("doc_id", "p.*", "page_number")


def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks: the documents, by source; the first and only revision."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.md5(F.concat("source", F.lit(":1:"), "text")).alias("chunk_id"), F.col("source").alias("company_document_id"), F.lit("1").alias("revision_number"), F.col("text").alias("content"),
        F.col("lang").alias("section"), F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 3 == 0, "parent").when(F.col("doc_id") % 3 == 1, "child").otherwise("text").alias("chunk_type"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("table_id"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("t"), (F.col("doc_id") - 1).cast("string"))).alias("parent_id"),
        F.when(F.col("doc_id") % 4 != 0, (F.col("n_chars") % 9 + 1).cast("string")).alias("page"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[[1.5,2],[3,"), (F.col("doc_id") % 7).cast("string"), F.lit("]]"))).when(F.col("doc_id") % 5 == 0, "none").alias("bbox"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors, under three revisions of ten documents."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id"), F.col("label").cast("string").alias("company_document_id"), (F.col("vec_id") % 3 + 1).cast("string").alias("revision_number"), "embedding")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, revision as text) at volume: the lines of all orders."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("company_document_id"), F.col("l_linenumber").cast("string").alias("revision_number"))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved chunks of queries for the statistics: an event is a chunk, its user and day the query."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("query_id"), F.col("event_id").alias("rank"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("section"), F.when(F.col("event_id") % 4 == 0, "child").when(F.col("event_id") % 4 == 1, "parent").when(F.col("event_id") % 4 == 2, "text").alias("chunk_type"),
        (F.col("value").cast("decimal(10,6)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(10,6)").alias("score"), F.col("ts").alias("created_at"),
    )


_VALUES = ", ".join(f"({-1 - k}, {quoted(p)})" for k, p in enumerate(PHRASES))

#: The same views in SQL.
VIEWS = {
    "questions": f"""SELECT qid::BIGINT AS qid, question FROM (VALUES {_VALUES}) AS v(qid, question)
      UNION ALL SELECT item_id * 2, text FROM benchmark UNION ALL SELECT (conv_id * 1000 + turn) * 2 + 1, text FROM conversations WHERE role = 'user'""",
    "elements": """SELECT doc_id::VARCHAR AS doc_id, (k - 1)::BIGINT AS seq,
        CASE WHEN k - 1 = 0 THEN 'Title' WHEN (k - 1) % 7 = 0 THEN 'ListItem' WHEN (k - 1) % 11 = 5 THEN 'Header' WHEN (k - 1) % 13 = 9 THEN 'UncategorizedText' ELSE 'NarrativeText' END AS category,
        l[k] AS text, (1 + (k - 1) // 10)::INTEGER AS page_number
      FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
      UNION ALL
      SELECT 'region-' || r_regionkey, seq, category, CASE seq WHEN 0 THEN 'Region ' || r_name WHEN 1 THEN 'Nations 1 0 0 of the region:' WHEN 2 THEN '| key | name |' || chr(10) || '|---|---|' || chr(10) || grid WHEN 3 THEN 'After table:' ELSE 'ok' END, page_number
      FROM region JOIN (SELECT n_regionkey, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS grid FROM nation GROUP BY 1) ON n_regionkey = r_regionkey
      CROSS JOIN (VALUES (0, 'Title', 1), (1, 'NarrativeText', 1), (2, 'Table', 2), (3, 'NarrativeText', 2), (4, 'NarrativeText', 3)) AS p(seq, category, page_number)""",
    "ingested_tables": """SELECT 'customer-' || o_custkey AS doc_id, 1::BIGINT AS seq, 'Customer no ' || o_custkey AS section, (o_custkey % 7 + 1)::INTEGER AS page_number,
        '| key | status |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) AS grid,
        '[[' || (o_custkey % 100)::DOUBLE || ', 1.5], [' || ((o_custkey % 100)::DOUBLE + 0.25) || ', 20.0]]' AS bbox FROM orders GROUP BY o_custkey""",
    "chunk_store": """SELECT md5(source || ':1:' || text) AS chunk_id, source AS company_document_id, '1' AS revision_number, text AS content, lang AS section, doc_id AS row_id,
        CASE doc_id % 3 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' ELSE 'text' END AS chunk_type, CASE WHEN doc_id % 3 = 0 THEN 't' || doc_id END AS table_id,
        CASE WHEN doc_id % 3 = 1 THEN 't' || (doc_id - 1) END AS parent_id, CASE WHEN doc_id % 4 <> 0 THEN (n_chars % 9 + 1)::VARCHAR END AS page,
        CASE WHEN doc_id % 2 = 0 THEN '[[1.5,2],[3,' || (doc_id % 7) || ']]' WHEN doc_id % 5 = 0 THEN 'none' END AS bbox FROM documents""",
    "vectors": "SELECT vec_id::VARCHAR AS chunk_id, vec_id, label::VARCHAR AS company_document_id, (vec_id % 3 + 1)::VARCHAR AS revision_number, embedding FROM embeddings",
    "messages": "SELECT conv_id AS session_id, turn, role, text AS content FROM conversations",
    "revisions": "SELECT l_orderkey::VARCHAR AS company_document_id, l_linenumber::VARCHAR AS revision_number FROM lineitem",
    "retrieved": """SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS query_id, event_id AS rank, CASE WHEN event_type <> 'error' THEN event_type END AS section,
        CASE event_id % 4 WHEN 0 THEN 'child' WHEN 1 THEN 'parent' WHEN 2 THEN 'text' END AS chunk_type, (value::DECIMAL(10,6) / 100)::DECIMAL(10,6) AS score, ts AS created_at FROM events""",
}


def sql(body: str, *views: str, **more: str) -> str:
    """A query over canonical views, put in front of it as common table expressions."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
