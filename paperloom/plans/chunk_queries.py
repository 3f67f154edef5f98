"""Elements and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import chunking as C
from paperloom.sources import files as S

from .bindings import elements, ingested, quoted, sql, table
from .registry import query
from .text_queries import WS, _numbers, s_in, s_strip

KEPT = s_in("category", C.KEPT)
_SECTIONED = {
    **_numbers("n", "(SELECT * FROM elements WHERE " + KEPT + ")", "text"),
    "sectioned": f"""SELECT *, coalesce(last_value(CASE WHEN category = 'Title' THEN {s_strip('text')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), {quoted(C.FIRST_SECTION)}) AS section
      FROM n2""",
}
_GROUPED = _SECTIONED | {
    "flags": "SELECT *, lag(category) OVER w AS pc, lag(text) OVER w AS pt FROM sectioned WINDOW w AS (PARTITION BY doc_id ORDER BY seq)",
    "grouped": """SELECT *, sum(CASE WHEN category IN ('Title', 'Table') OR pc IS NULL OR pc = 'Table' OR (pc <> 'Title' AND (ends_with(pt, '.') OR ends_with(pt, ':'))) THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM flags""",
}
_TEXTS = _GROUPED | {
    "joined": f"SELECT doc_id, grp, section, min(seq) AS seq, arg_min(page_number, seq) AS page_number, {s_strip('''string_agg(text, chr(10) ORDER BY seq)''')} AS text FROM grouped WHERE category <> 'Table' GROUP BY ALL",
    **_numbers("j", "joined", "text"),
}
_TABLES = _SECTIONED | {
    "tables": "SELECT *, md5(doc_id || ':' || seq) AS table_id, string_split(text, chr(10)) AS lines FROM sectioned WHERE category = 'Table'",
    "chunks": f"""SELECT doc_id, seq, 0 AS chunk_index, 'parent' AS type, section, true AS is_parent, page_number, '### Table: ' || section || chr(10) || text AS content, table_id, NULL AS parent_id FROM tables
      UNION ALL SELECT doc_id, seq, (k - 2)::INTEGER, 'child', section, false, page_number, 'Context: ' || section || chr(10) || lines[1] || chr(10) || lines[2] || chr(10) || lines[k], NULL, table_id
      FROM (SELECT *, unnest(range(3, len(lines) + 1)) AS k FROM tables) WHERE {s_strip('lines[k]')} <> ''""",
}


@query("io03_elements_source", sql("SELECT * FROM elements", "elements"))
def io03(spark, d):
    """The elements written as one JSON array a document, and read from the files with their order."""
    path = S.scratch_folder(spark)
    S.write_element_arrays(elements(spark, d), path)
    return S.read_elements(spark, path).select("doc_id", "seq", "category", "text", "page_number")


@query("fl01_filter_elements", sql(f"SELECT * FROM elements WHERE {KEPT} AND length({s_strip('text')}) > 2", "elements"))
def fl01(spark, d):
    return C.filter_elements(elements(spark, d))


@query("ag01_count_categories", sql("SELECT category, count(*) AS n FROM elements GROUP BY 1", "elements"))
def ag01(spark, d):
    return C.count_categories(elements(spark, d))


@query("ag02_discard_breakdown", sql(f"SELECT CASE WHEN {KEPT} THEN CASE WHEN coalesce(length({s_strip('text')}) <= 2, true) THEN 'Too Short' ELSE 'kept' END ELSE category END AS reason, count(*) AS n FROM elements GROUP BY 1", "elements"))
def ag02(spark, d):
    return C.discard_breakdown(elements(spark, d))


@query("wn01_section_carry_forward", sql("SELECT doc_id, seq, category, section FROM sectioned", "elements", **_SECTIONED))
def wn01(spark, d):
    return C.sectioned(elements(spark, d)).select("doc_id", "seq", "category", "section")


@query("wn02_flush_groups", sql("SELECT doc_id, seq, grp FROM grouped", "elements", **_GROUPED))
def wn02(spark, d):
    return C.flush_groups(elements(spark, d)).select("doc_id", "seq", "grp")


@query("wn02_flush_groups_in_segments", sql("SELECT doc_id, seq, section, grp FROM grouped", "elements", **_GROUPED))
def wn02_segments(spark, d):
    """Sections and groups with documents of over 40 elements cut into segments."""
    return C.flush_groups(elements(spark, d), cut=40).select("doc_id", "seq", "section", "grp")


@query("wn04_group_text_and_page", sql("SELECT doc_id, grp, section, seq, page_number, text AS content FROM j2 WHERE text <> ''", "elements", **_TEXTS))
def wn04(spark, d):
    return C.text_groups(elements(spark, d))


@query("tg01_recursive_split")
def tg01(spark, d):
    from paperloom.functions.splitter import split_chunks

    return table(spark, d, "documents").select("doc_id", F.posexplode(split_chunks(F.col("text"))).alias("chunk_index", "chunk"))


@query("wn05_chunk_index")
def wn05(spark, d):
    return C.text_chunks(elements(spark, d)).select("doc_id", "seq", "chunk_index", "section", F.length("content").alias("n_chars"))


@query("tg02_text_chunks")
def tg02(spark, d):
    return C.text_chunks(elements(spark, d))


@query("tg03_table_parents", sql("SELECT * FROM chunks WHERE type = 'parent'", "elements", **_TABLES))
def tg03(spark, d):
    return C.table_chunks(elements(spark, d)).filter("type = 'parent'")


@query("tg04_table_children", sql("SELECT * FROM chunks WHERE type = 'child'", "elements", **_TABLES))
def tg04(spark, d):
    return C.table_chunks(elements(spark, d)).filter("type = 'child'")


@query("tg08_table_lines", sql("SELECT doc_id, lines[1] AS head, lines[2] AS rule, (len(lines) - 2)::INTEGER AS n_rows FROM tables", "elements", **_TABLES))
def tg08(spark, d):
    lines = F.split("text", "\n")
    return C.sectioned(elements(spark, d)).filter("category = 'Table'").select("doc_id", lines[0].alias("head"), lines[1].alias("rule"), (F.size(lines) - 2).alias("n_rows"))


_INGESTED = {
    "tables": "SELECT *, md5(doc_id || ':' || seq) AS table_id, string_split(grid, chr(10)) AS lines FROM ingested_tables",
    "chunks": """SELECT doc_id, seq, 0 AS chunk_index, 'parent' AS type, section, true AS is_parent, page_number, '### Table: ' || section || chr(10) || grid AS content, table_id, NULL AS parent_id, bbox FROM tables
      UNION ALL SELECT doc_id, seq, (k - 2)::INTEGER, 'child', section, false, page_number, 'Context: ' || section || chr(10) || lines[1] || chr(10) || lines[2] || chr(10) || lines[k], NULL, table_id, bbox
      FROM (SELECT *, unnest(range(3, len(lines) + 1)) AS k FROM tables)""",
}


@query("tg03_html_table_chunks", sql("SELECT * FROM chunks", "ingested_tables", **_INGESTED))
def tg03_html(spark, d):
    """Parents and children of tables that came as HTML, with their boxes."""
    return C.table_chunks(ingested(spark, d))


@query(
    "tg05_enriched_rows",
    sql(
        """SELECT content AS page_content, md5(doc_id || ':C:' || content) AS chunk_id, parent_id, table_id AS doc_id, section, type AS chunk_type, doc_id || '.pdf' AS source_file, ceil(length(content) / 4.0)::INTEGER AS tokens,
        1700000000::BIGINT AS created_at, page_number, bbox, doc_id AS company_document_id, 'C' AS revision_number, 'IFC' AS revision_code, 1690000000::BIGINT AS revision_date, 'report' AS document_type FROM chunks""",
        "ingested_tables",
        **_INGESTED,
    ),
)
def tg05_rows(spark, d):
    """Stored entities of those tables, their structs laid out as columns."""
    rows = C.enriched_rows(C.table_chunks(ingested(spark, d)), "C", F.concat("doc_id", F.lit(".pdf")), 1_700_000_000, "IFC", 1_690_000_000, "report")
    return rows.select("page_content", "chunk_id", "parent_id", "doc_id", "metadata.*", "cmetadata.*")


_ENRICHED = """SELECT md5(doc_id || ':1:' || content) AS chunk_id, content, section, type AS chunk_type, doc_id || '.pdf' AS source_file, ceil(length(content) / 4.0)::BIGINT AS tokens, page_number,
  doc_id AS company_document_id, '1' AS revision_number, parent_id, table_id FROM chunks"""


@query("tg05_enrich_chunks", sql(_ENRICHED, "elements", **_TABLES))
def tg05(spark, d):
    return C.enrich_chunks(C.table_chunks(elements(spark, d)), "1", F.concat("doc_id", F.lit(".pdf")))


@query("tg05_enrich_all_chunks")
def tg05_all(spark, d):
    """Text and table chunks; the text splitter has no SQL."""
    return C.enrich_chunks(C.chunk_elements(elements(spark, d)), "1", F.concat("doc_id", F.lit(".pdf")))


@query("ag18_ingest_summary", sql("SELECT doc_id AS company_document_id, '1' AS revision_number, doc_id || '.pdf' AS source_file, count(*) AS chunk_count FROM chunks GROUP BY ALL", "elements", **_TABLES))
def ag18(spark, d):
    return C.ingest_summary(tg05(spark, d))


@query("ag18_ingest_summary_all_chunks")
def ag18_all(spark, d):
    return C.ingest_summary(tg05_all(spark, d))


_PAGE_ONE = {
    "p": f"SELECT *, {s_strip('text')} AS t FROM (SELECT *, max(page_number) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seen FROM marked) WHERE seen <= 1",
    "i": "SELECT *, lower(t) AS low, length(t) > 8 AND length(t) < 40 AND regexp_matches(t, '[0-9]') AND NOT contains(t, ' ') AS is_id FROM p WHERE t <> ''",
    "o": f"SELECT *, is_id AND sum(is_id::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AS consumed, regexp_extract(low, '(?:^|[^\\p{{L}}\\p{{N}}_])rev\\.?[{WS}]*([a-z0-9]{{1,3}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1) AS rev FROM i",
}
_MARK = "CASE seq % 5 WHEN 1 THEN 'Doc-' || doc_id || '-000123' WHEN 2 THEN 'Basis of design for ' || substr(text, 1, 20) WHEN 3 THEN 'Project field ' || doc_id || ' Rev. ' || (seq % 10) ELSE text END"


def _marked(spark, d):
    seq, text = F.col("seq"), F.col("text")
    made = F.when(seq % 5 == 1, F.concat(F.lit("Doc-"), "doc_id", F.lit("-000123"))).when(seq % 5 == 2, F.concat(F.lit("Basis of design for "), F.substring(text, 1, 20))).when(seq % 5 == 3, F.concat(F.lit("Project field "), "doc_id", F.lit(" Rev. "), (seq % 10).cast("string"))).otherwise(text)
    return elements(spark, d).withColumn("text", made)


@query(
    "sc24_document_metadata",
    sql(
        """SELECT doc_id, arg_min(t, seq) FILTER (consumed) AS document_number,
        coalesce(arg_min(t, seq) FILTER (NOT consumed AND contains(low, 'basis of design') AND length(t) > 10), arg_min(t, seq) FILTER (NOT consumed AND NOT contains(low, 'basis of design') AND contains(low, 'design basis'))) AS document_title,
        arg_max(upper(rev), seq) FILTER (NOT consumed AND rev <> '') AS revision_code,
        arg_max(t, seq) FILTER (NOT consumed AND (contains(low, 'project') OR contains(low, 'development') OR contains(low, 'field')) AND length(t) > 10 AND length(t) < 100) AS project_name FROM o GROUP BY doc_id""",
        "elements",
        marked=f"SELECT * REPLACE ({_MARK} AS text) FROM elements",
        **_PAGE_ONE,
    ),
)
def sc24(spark, d):
    return C.document_metadata(_marked(spark, d))


@query("wn13_first_page_scan", sql("SELECT doc_id, seq, page_number FROM (SELECT *, max(page_number) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seen FROM elements) WHERE seen <= 1", "elements"))
def wn13(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return elements(spark, d).withColumn("seen", F.max("page_number").over(w)).filter("seen <= 1").select("doc_id", "seq", "page_number")
