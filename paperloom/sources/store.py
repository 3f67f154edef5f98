"""The chunk store and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
IMMUTABLE = ("company_document_id", "revision_number")
LABELS = ("correct", "partial", "incorrect", "hallucination", "missing_context")
MIN_FIELD_CONFIDENCE = 0.6


def load_enriched(rows: DataFrame) -> DataFrame:
    """IO06: enriched chunks flattened; rows without content or identity struct go, a missing id or identity is an error."""
    kept = rows.filter(F.col("page_content").isNotNull() & (F.col("page_content") != "") & F.col("cmetadata").isNotNull())
    known = F.col("cmetadata.company_document_id").isNotNull() & F.col("cmetadata.revision_number").isNotNull() & F.col("chunk_id").isNotNull()
    checked = kept.withColumn("chunk_id", F.when(known, F.col("chunk_id")).otherwise(F.raise_error(F.lit("an enriched chunk lacks its identity"))))
    meta = lambda s: F.from_json(F.to_json(s), "map<string,string>")
    both = F.map_zip_with(F.coalesce(meta("metadata"), F.create_map().cast("map<string,string>")), meta("cmetadata"), lambda k, a, b: F.coalesce(b, a))
    return checked.select("chunk_id", F.col("page_content").alias("content"), F.col("cmetadata.company_document_id").alias("company_document_id"), F.col("cmetadata.revision_number").alias("revision_number"), both.alias("meta"))


def append_store(rows: DataFrame, path: str, once: bool = False, identity: tuple[str, str] | None = None) -> None:
    """IO08: append chunks, partitioned by document and revision; `once` drops repeated chunk ids of the batch.

    A row without its identity, or, where the ingest's `identity` (document,
    revision) is given, of another one, fails the write before any row is kept.
    """
    own = F.lit(True)
    for k, c in enumerate(IMMUTABLE):
        own = own & (F.col(c).isNotNull() if identity is None else F.col(c).eqNullSafe(F.lit(identity[k])))
    if once:
        rows = rows.dropDuplicates(["chunk_id"])
    checked = F.when(own, F.col(IMMUTABLE[0])).otherwise(F.raise_error(F.lit("a chunk belongs to another document or revision")))
    rows.withColumn(IMMUTABLE[0], checked.cast(rows.schema[IMMUTABLE[0]].dataType)).write.mode("append").partitionBy(*IMMUTABLE).parquet(path)


def merge_metadata(rows: DataFrame, document: str, revision: str, new: dict[str, str]) -> DataFrame:
    """TG06/MU04: chunk metadata of one revision with new values over the old; identity keys never change (FL07)."""
    fresh = F.create_map(*[F.lit(x) for k, v in new.items() if k not in IMMUTABLE for x in (k, v)]) if set(new) - set(IMMUTABLE) else F.create_map().cast("map<string,string>")
    own = (F.col("company_document_id") == document) & (F.col("revision_number") == revision)
    merged = F.map_zip_with("meta", fresh, lambda k, a, b: F.coalesce(b, a))
    return rows.withColumn("meta", F.when(own, merged).otherwise(F.col("meta")))


def overwrite_revision(rows: DataFrame, path: str) -> None:
    """MU04: replace the partitions that the rows belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*IMMUTABLE).parquet(path)


def of_metadata(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """FL02: the rows of which all the given columns equal the given values as texts."""
    keep = F.lit(True)
    for k, v in wanted.items():
        keep = keep & (F.col(k) == F.lit(str(v)))
    return rows.filter(keep)


def with_identity(rows: DataFrame) -> DataFrame:
    """FL06: the rows with a chunk id."""
    return rows.filter(F.col("chunk_id").isNotNull() & (F.col("chunk_id") != ""))


def guarded(rows: DataFrame, *required: str) -> DataFrame:
    """IO10: the rows that have all required values."""
    keep = F.lit(True)
    for c in required:
        keep = keep & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return rows.filter(keep)


def recent(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """TK05/TK07: the last rows by some columns, a bounded report."""
    return rows.orderBy(*(F.desc(c) for c in by)).limit(most)


def preview(rows: DataFrame, by: str, most: int = 3) -> DataFrame:
    """TK07: the first rows by a column."""
    return rows.orderBy(by).limit(most)


def checked_keys(keys: Column) -> tuple[Column, Column]:
    """SO05: of the keys of an update those that may not change, and the others in order."""
    fixed = F.array(*map(F.lit, IMMUTABLE))
    return F.array_intersect(keys, fixed), F.array_sort(F.array_except(keys, fixed))


def remaining_fields(missing: Column, given: Column) -> Column:
    """SO06: the missing fields but one that was given, in their order."""
    return F.filter(missing, lambda f: f != given)


def with_duplicate(missing: Column, duplicate: Column) -> Column:
    """FL09: missing fields, and the revision where the document already has it."""
    return F.array_union(missing, F.when(duplicate, F.array(F.lit("revision_code"))).otherwise(F.array().cast("array<string>")))


def by_content(rows: DataFrame) -> DataFrame:
    """SO03: equal contents once: their hash, and the first row that has them."""
    return rows.groupBy(F.md5("content").alias("h")).agg(F.min("row_id").alias("row_id"))


def parents_of(rows: DataFrame) -> DataFrame:
    """FL13/TK06: child rows with the first parent row of their table, if there is one."""
    parents = rows.filter("chunk_type = 'parent'").groupBy(F.col("table_id").alias("parent_id")).agg(F.min("row_id").alias("parent_row"))
    return rows.filter("chunk_type = 'child'").join(parents, "parent_id", "left").select("row_id", "parent_row")


def exists(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """FL04: for each wanted key whether rows have it."""
    known = rows.select(*keys).distinct().withColumn("present", F.lit(True))
    return wanted.join(known, keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def chunks_by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """FL05: the chunks of a list of ids, with default score, page and type."""
    found = rows.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return found.withColumns({"score": F.lit(1.0), "page_number": F.coalesce(F.expr("try_cast(page AS int)"), F.lit(1)), "chunk_type": F.coalesce("chunk_type", F.lit("text"))})


def mutable_only(m: Column) -> Column:
    """FL07: user metadata without identity keys."""
    return F.map_filter(m, lambda k, v: ~k.isin(*IMMUTABLE))


def missing_fields(fields: Column) -> Column:
    """FL08: names of (name, value, confidence) structs whose value is empty or confidence low."""
    low = F.filter(fields, lambda f: f.value.isNull() | (f.value == "") | f.confidence.isNull() | (f.confidence < MIN_FIELD_CONFIDENCE))
    return F.transform(low, lambda f: f["name"])


def form_blocked(values: Column, keys: list[str]) -> Column:
    """FL14: whether a form field is blank."""
    blocked = F.lit(False)
    for k in keys:
        blocked = blocked | (F.trim(F.coalesce(F.element_at(values, k), F.lit(""))) == "")
    return blocked


def valid_feedback(session: Column, job: Column, document: Column, label: Column, score: Column) -> Column:
    """FL15: feedback with something it belongs to, a known label, and no score or one from 1 to 5."""
    return F.coalesce(session, job, document).isNotNull() & label.isin(*LABELS) & (score.isNull() | score.between(1, 5))


def append_log(rows: DataFrame, path: str, *required: str) -> bool:
    """IO09/IO10: append telemetry rows that have the required values; a failure is reported, never raised."""
    try:
        guarded(rows, *required).write.mode("append").parquet(path)
    except Exception:  # telemetry must not break its caller
        return False
    return True


def truncate(path: str, like: DataFrame) -> None:
    """IO14: leave an empty table of the same columns."""
    like.limit(0).write.mode("overwrite").parquet(path)
