"""Elements and chunks as JSON files, PDF files through a pluggable parser, objects with checksums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import schemas

#: A parser gives the pages of a PDF in order, each a list of (category, text) pairs; a page it cannot read is None.
Parser = Callable[[bytes], Iterable[list[tuple[str, str]] | None]]


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a new temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def read_elements(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """IO03: elements of JSON files: each line (or, for arrays over several lines, each file as a whole) is an array of elements, or one element.

    `seq` is the stored one, or else the place in the array. A text that is no
    JSON is an error.
    """
    element = T.StructType.fromDDL(schemas.ELEMENT)
    lines = spark.read.text(path, wholetext=whole_files).filter(F.trim("value") != "")
    parsed = lines.select(F.posexplode(F.from_json("value", T.ArrayType(element), {"mode": "FAILFAST"})).alias("place", "e"))
    return parsed.select(*(F.coalesce("e.seq", F.col("place").cast("bigint")).alias("seq") if c == "seq" else F.col(f"e.{c}") for c in element.names))


def write_element_arrays(elements: DataFrame, path: str) -> None:
    """IO03: one line a document, the array of its elements in order."""
    parts = F.array_sort(F.collect_list(F.struct("seq", *(c for c in elements.columns if c != "seq"))))
    elements.groupBy("doc_id").agg(F.to_json(parts).alias("value")).select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def write_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    """IO04/IO05: elements or chunks, one JSON object a line; readers tell a compression by the files' names."""
    df.write.mode("overwrite").json(path, compression=compression)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """IO05: raw chunks."""
    return spark.read.schema(schemas.RAW_CHUNK).json(path)


def read_pdfs(spark: SparkSession, path: str, parser: Parser, max_pages: int | None = None) -> DataFrame:
    """IO01/IO02: elements of all PDF files below a path, page by page; pages that fail are skipped.

    `max_pages` stops the parser early, as a limit behind it could not.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return parse_pdfs(files.select("path", "content"), parser, max_pages)


def parse_pdfs(files: DataFrame, parser: Parser, max_pages: int | None = None) -> DataFrame:
    """Elements of files given as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                seq = 0
                for page, parts in enumerate(parser(content), 1):
                    if max_pages and page > max_pages:
                        break
                    if not parts:
                        continue
                    yield pd.DataFrame({"doc_id": name, "seq": range(seq, seq + len(parts)), "category": [c for c, _ in parts], "text": [t for _, t in parts], "page_number": page})
                    seq += len(parts)

    return files.select("path", "content").mapInPandas(run, "doc_id string, seq bigint, category string, text string, page_number int")


def object_manifest(files: DataFrame, document: Column, revision: Column, name: Column, content: Column) -> DataFrame:
    """IO11: where each file is put (`document/vREVISION/name`) and its sha256."""
    return files.select(F.concat_ws("/", document, F.concat(F.lit("v"), revision), F.element_at(F.split(name, "/"), -1)).alias("object_path"), F.sha2(content.cast("binary"), 256).alias("sha256"))


def new_objects(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """JN07: objects that are not there yet (the overwrite guard)."""
    return wanted.join(present.select("object_path").distinct(), "object_path", "left_anti")


def next_revisions(names: DataFrame, key: str, name: str) -> DataFrame:
    """AG04: one more than the greatest `v<digits>` name of each key, else 1."""
    number = F.regexp_extract(name, r"^v([0-9]+)$", 1)
    return names.groupBy(key).agg((F.coalesce(F.max(F.when(number != "", number.cast("int"))), F.lit(0)) + 1).alias("next_revision"))


def scaled_box(points: Column, dpi: int = 150) -> Column:
    """IO12/SC34: a box's points in pixels, or null where there are at most two."""
    factor = dpi / 72
    return F.when(F.size(points) > 2, F.transform(points, lambda p: F.transform(p, lambda v: v * F.lit(factor))))
