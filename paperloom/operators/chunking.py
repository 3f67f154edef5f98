"""From typed elements to enriched chunks: section carry-forward, flush groups, tables with parent and child rows, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.functions.splitter import split_chunks
from paperloom.operators.scan import Scan
from paperloom.sources.html_tables import markdown_table

# Fixed values.
KEPT = ("Title", "NarrativeText", "Table", "ListItem", "UncategorizedText")
FIRST_SECTION = "General / Introduction"


def filter_elements(elements: DataFrame) -> DataFrame:
    """FL01: known categories with more than two characters."""
    return elements.filter(F.col("category").isin(*KEPT) & (F.length(X.strip("text")) > 2))


def count_categories(elements: DataFrame) -> DataFrame:
    """AG01: elements by category."""
    return elements.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def discard_breakdown(elements: DataFrame) -> DataFrame:
    """AG02: kept elements, and removed ones by reason (too short, null texts among them, or the category)."""
    short = F.col("category").isin(*KEPT) & F.coalesce(F.length(X.strip("text")) <= 2, F.lit(True))
    reason = F.when(short, "Too Short").when(F.col("category").isin(*KEPT), "kept").otherwise(F.col("category"))
    return elements.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def sectioned(elements: DataFrame, cut: int | None = None) -> DataFrame:
    """WN01: number-normalised elements with the last title at or before them; other categories are gone.

    With `cut`, documents of more elements are scanned in segments.
    """
    kept = elements.filter(F.col("category").isin(*KEPT)).withColumn("text", X.normalize_numbers(F.col("text")))
    title = F.when(F.col("category") == "Title", X.strip("text"))
    return Scan(kept, "doc_id", ["seq"], cut).last("section", title).result().withColumn("section", F.coalesce("section", F.lit(FIRST_SECTION)))


def flush_groups(elements: DataFrame, cut: int | None = None) -> DataFrame:
    """WN02: sectioned elements with the number of the text group they are flushed in.

    A group begins at a title or table, behind a table, and behind text that
    ends in a full stop or colon; a title does not end its own group. With
    `cut`, documents of more elements are scanned in segments.
    """
    before = F.col("before_category")
    ended = (before != "Title") & F.col("before_ended")
    start = F.col("category").isin("Title", "Table") | before.isNull() | (before == "Table") | ended
    scan = Scan(sectioned(elements, cut), "doc_id", ["seq"], cut)
    scan.lag(before_category=F.col("category"), before_ended=F.col("text").endswith(".") | F.col("text").endswith(":"))
    return scan.sum("grp", start.cast("int")).result().drop("before_category", "before_ended")


def text_groups(elements: DataFrame) -> DataFrame:
    """WN04/TG02: one row per flushed group with its joined text, first page and section."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    joined = X.normalize_numbers(X.strip(F.array_join(F.transform(parts, lambda p: p.text), "\n")))
    groups = flush_groups(elements).filter("category <> 'Table'").groupBy("doc_id", "grp", "section").agg(F.min("seq").alias("seq"), F.min_by("page_number", "seq").alias("page_number"), joined.alias("content"))
    return groups.filter("content <> ''")


def text_chunks(elements: DataFrame) -> DataFrame:
    """TG02/WN05: text chunks with their heading and their index in the group."""
    pieces = text_groups(elements).select("doc_id", "seq", "section", "page_number", F.posexplode(split_chunks(F.col("content"))).alias("chunk_index", "piece"))
    content = F.concat(F.lit("### Section: "), "section", F.lit("\n"), "piece")
    return pieces.select("doc_id", "seq", "chunk_index", F.lit("text").alias("type"), "section", F.lit(False).alias("is_parent"), "page_number", content.alias("content"), F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("string").alias("parent_id"))


def box_text(points: Column) -> Column:
    """The corners of a box as stored text, `[[x, y], ...]`; empty without corners."""
    corner = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, lambda v: v.cast("string")), ", "), F.lit("]"))
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(points, corner), ", "), F.lit("]")), F.lit(""))


def table_chunks(elements: DataFrame) -> DataFrame:
    """TG03/TG04/TG08: each table as a parent chunk, and each of its rows with the two header lines as a child.

    A table's id is the md5 of its document and place, so runs agree. Where
    elements have `text_as_html`, a table's first HTML table is its text, as a
    grid, if there is any HTML; where they have `points`, parent and children
    carry the table's box as `bbox`.
    """
    tables = sectioned(elements).filter("category = 'Table'").withColumn("table_id", F.md5(F.concat("doc_id", F.lit(":"), F.col("seq").cast("string"))))
    if "text_as_html" in elements.columns:
        html = F.col("text_as_html")
        tables = tables.withColumn("text", F.when(html.isNotNull() & (html != ""), markdown_table(html)).otherwise(F.col("text")))
    box = [box_text(F.col("points")).alias("bbox")] if "points" in elements.columns else []
    tables = tables.select("doc_id", "seq", "section", "page_number", "text", "table_id", *box)
    kept = [F.col(c) for c in ("bbox",) if box]
    lines = F.split("text", "\n")
    parent = tables.select("doc_id", "seq", F.lit(0).alias("chunk_index"), F.lit("parent").alias("type"), "section", F.lit(True).alias("is_parent"), "page_number", F.concat(F.lit("### Table: "), "section", F.lit("\n"), "text").alias("content"), "table_id", F.lit(None).cast("string").alias("parent_id"), *kept)
    rows = tables.filter(F.size(lines) > 2).select("*", F.slice(lines, 1, 2).alias("head"), F.posexplode(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))).alias("k", "row")).filter(X.strip("row") != "")
    content = F.concat(F.lit("Context: "), "section", F.lit("\n"), F.array_join("head", "\n"), F.lit("\n"), "row")
    child = rows.select("doc_id", "seq", (F.col("k") + 1).alias("chunk_index"), F.lit("child").alias("type"), "section", F.lit(False).alias("is_parent"), "page_number", content.alias("content"), F.lit(None).cast("string").alias("table_id"), F.col("table_id").alias("parent_id"), *kept)
    return parent.unionByName(child)


def chunk_elements(elements: DataFrame) -> DataFrame:
    """All raw chunks; (doc_id, seq, chunk_index) is their order. Text chunks have no box."""
    return text_chunks(elements).unionByName(table_chunks(elements), allowMissingColumns=True)


def enrich_chunks(chunks: DataFrame, revision: str, source_file: Column) -> DataFrame:
    """TG05: chunks with defaults, token estimate, identity and ids; empty contents go."""
    kept = chunks.filter("content <> ''")
    return kept.select(
        X.chunk_id(F.col("doc_id"), F.lit(revision), F.col("content")).alias("chunk_id"), "content", F.coalesce("section", F.lit("Unknown")).alias("section"), F.coalesce("type", F.lit("text")).alias("chunk_type"),
        source_file.alias("source_file"), X.estimate_tokens(F.col("content")).alias("tokens"), F.coalesce("page_number", F.lit(1)).alias("page_number"), F.col("doc_id").alias("company_document_id"),
        F.lit(revision).alias("revision_number"), "parent_id", "table_id",
    )


def enriched_rows(chunks: DataFrame, revision: str, source_file: Column, created_at: int, revision_code: str | None = None, revision_date: int | None = None, document_type: str | None = None) -> DataFrame:
    """TG05: chunks as stored entities (schemas.ENRICHED_CHUNK): metadata with box and time of creation, identity with the revision's code, date and the document's type.

    The revision's date is the time of creation where none is given; a missing
    section, type, page or box takes its default; empty contents go; without a
    revision it is an error.
    """
    if not revision:
        raise ValueError("a revision number is required")
    box = F.coalesce("bbox", F.lit("")) if "bbox" in chunks.columns else F.lit("")
    text, at = (lambda v: F.lit(v).cast("string")), (lambda v: F.lit(v).cast("bigint"))
    kept = chunks.filter("content <> ''")
    metadata = F.struct(
        F.coalesce("section", F.lit("Unknown")).alias("section"), F.coalesce("type", F.lit("text")).alias("chunk_type"), source_file.alias("source_file"), X.estimate_tokens(F.col("content")).cast("int").alias("tokens"),
        at(created_at).alias("created_at"), F.coalesce("page_number", F.lit(1)).alias("page_number"), box.alias("bbox"),
    )
    identity = F.struct(
        F.col("doc_id").alias("company_document_id"), F.lit(revision).alias("revision_number"), text(revision_code).alias("revision_code"),
        at(created_at if revision_date is None else revision_date).alias("revision_date"), text(document_type).alias("document_type"),
    )
    return kept.select(F.col("content").alias("page_content"), metadata.alias("metadata"), identity.alias("cmetadata"), X.chunk_id(F.col("doc_id"), F.lit(revision), F.col("content")).alias("chunk_id"), "parent_id", F.col("table_id").alias("doc_id"))


def ingest_summary(enriched: DataFrame) -> DataFrame:
    """AG18: chunks by document and revision."""
    return enriched.groupBy("company_document_id", "revision_number", "source_file").agg(F.count(F.lit(1)).alias("chunk_count"))


def document_metadata(elements: DataFrame) -> DataFrame:
    """SC24: number, title, revision and project of a document from the elements before its second page.

    The first element that looks like an identifier is the number and plays no
    other part; the first title wins ("basis of design" over "design basis");
    the last revision and the last project win.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    page = F.max("page_number").over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = elements.withColumn("seen", page).filter("seen <= 1").withColumn("t", X.strip("text")).filter("t <> ''").withColumn("low", F.lower("t"))
    n = F.length("t")
    e = e.withColumn("is_id", (n > 8) & (n < 40) & F.col("t").rlike("[0-9]") & ~F.col("t").contains(" ") & F.col("t").rlike("[A-Z0-9]+"))
    e = e.withColumn("consumed", F.col("is_id") & (F.sum(F.col("is_id").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    open_ = ~F.col("consumed")
    basis = open_ & F.col("low").contains("basis of design") & (n > 10)
    other = open_ & ~F.col("low").contains("basis of design") & F.col("low").contains("design basis")
    rev = F.regexp_extract("low", rf"(?:^|[^\p{{L}}\p{{N}}_])rev\.?[{X.WS}]*([a-z0-9]{{1,3}})(?:$|[^\p{{L}}\p{{N}}_])", 1)
    project = open_ & (F.col("low").contains("project") | F.col("low").contains("development") | F.col("low").contains("field")) & (n > 10) & (n < 100)
    title = F.replace(F.col("t"), F.lit("\n"), F.lit(" "))
    first = lambda v, ok: F.min_by(F.when(ok, v), F.when(ok, F.col("seq")))
    last = lambda v, ok: F.max_by(F.when(ok, v), F.when(ok, F.col("seq")))
    return e.groupBy("doc_id").agg(
        first(F.col("t"), F.col("consumed")).alias("document_number"), F.coalesce(first(title, basis), first(title, other)).alias("document_title"),
        last(F.upper(rev), open_ & (rev != "")).alias("revision_code"), last(F.col("t"), project).alias("project_name"),
    )
