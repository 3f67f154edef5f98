"""What the operators of this package share: text blocks in Arrow batches, bounded memo tables, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: UTF-8 bytes of text that a worker handles at a time; one longer text is a block of its own.
BLOCK_BYTES = 2_000_000

#: Rows of an Arrow batch between the JVM and a worker; whole texts make Spark's default of 10,000 rows too much memory.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Entries and characters of a worker's memo table; beyond either it starts anew with what the current block needs.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 16_000_000
#: Longer strings are worked out, but not kept for the next block.
KEPT_CHARS = 256


def blocks(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about `limit` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, text: int = 1) -> list[str]:
    """The texts; null is the empty text."""
    return [t or "" for t in batch.column(text).to_pylist()]


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS rows (a smaller setting stays)."""
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    columns: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    id_as: str | None = None,
) -> DataFrame:
    """One row per document: its id and what the function gives for its text.

    `make` runs once per task and returns the function from a block of texts to
    the columns named in the DDL string `columns`. Other columns of `docs` are
    not read, so their names cannot clash; an id named like one of `columns` is
    an error. Needs no shuffle.
    """
    bound_batches(docs.sparkSession)
    name = id_as or id_col
    if name in T.StructType.fromDDL(columns).names:
        raise ValueError(f"the id column needs another name than {name}, which the result has")
    source = docs.select(docs[id_col].alias(name), docs[text_col].cast("string").alias("__text"))
    kind = source.schema[name].dataType.simpleString()
    made = T.StructType.fromDDL(columns)
    names, kinds = made.names, [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for block in blocks(batches):
            out = fn(texts_of(block))
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(out[c], k) for c, k in zip(names, kinds, strict=True))], names=[name, *names])

    return source.mapInArrow(run, f"`{name}` {kind}, {columns}")


def rewrite_rows(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict]], text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with the same columns, rows dropped or texts replaced.

    The function of a block of texts returns `keep` (booleans) and/or `text`
    (new texts; a null stays null). `length_col`, where present, follows the
    new text. Needs no shuffle and no join, so repeated rows, null ids and
    further columns pass through as they are.
    """
    bound_batches(docs.sparkSession)
    schema, names = docs.schema, docs.columns
    at = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for block in blocks(batches, at):
            out = fn(texts_of(block, at))
            if "text" in out:
                arrays = block.columns
                old = arrays[at].to_pylist()
                new = [None if o is None else n for o, n in zip(old, out["text"], strict=True)]
                arrays[at] = pa.array(new, block.schema.field(at).type)
                if length is not None:
                    sizes = [was if n == o else len(n or "") for n, o, was in zip(new, old, arrays[length].to_pylist(), strict=True)]
                    arrays[length] = pa.array(sizes, block.schema.field(length).type)
                block = pa.RecordBatch.from_arrays(arrays, schema=block.schema)
            if "keep" in out:
                block = block.filter(pa.array(out["keep"], pa.bool_()))
            yield block

    return docs.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` lacks."""
    while name in df.columns:
        name += "_"
    return name


class Memo:
    """Values by string, worked out for many missing strings at once; bounded in entries and characters."""

    def __init__(self, work_out: Callable[[list[str]], list], entries: int = MEMO_ENTRIES, chars: int = MEMO_CHARS):
        self.work_out, self.entries, self.chars = work_out, entries, chars
        self.table, self.held, self.passing = {}, 0, []

    def of(self, *lists: Iterable[str]) -> dict:
        """A table that holds at least the strings of the given lists, until the next call."""
        for s in self.passing:
            del self.table[s]
        self.passing = []
        wanted: set[str] = set()
        for strings in lists:
            wanted.update(strings)
        missing = [s for s in wanted if s not in self.table]
        if missing:
            self.held += sum(map(len, missing))
            if len(self.table) + len(missing) > self.entries or self.held > self.chars:
                self.table = {s: self.table[s] for s in wanted if s in self.table}
                self.held = sum(map(len, wanted))
            self.table.update(zip(missing, self.work_out(missing), strict=True))
            self.passing = [s for s in missing if len(s) > KEPT_CHARS]
            self.held -= sum(map(len, self.passing))
        return self.table


def _shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a new temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{_shared_base(spark)}/{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared file system that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut in the shared folder; a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(_shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def join_values(rows: DataFrame, values: DataFrame, key: str, share: int = 10_000) -> DataFrame:
    """`rows` with the one row of `values` (key, n, ...) for its key, where `n` is the number of rows with that key.

    Keys with over a `share`-th of all rows, fewer than `share` by their
    definition, go by broadcast, so no key's rows meet in one task; all others
    have few rows and are shuffled.
    """
    limit = max(1000, (values.agg(F.sum("n")).first()[0] or 0) // share)
    hot = F.broadcast(values.filter(F.col("n") > limit))
    rest = rows.join(F.broadcast(values.filter(F.col("n") > limit).select(key)), key, "left_anti").join(values.filter(F.col("n") <= limit), key)
    return rows.join(hot, key).unionByName(rest)


def crc_mod(column, by: int):
    """crc32 of the value as text, modulo `by`."""
    return F.crc32(column.cast("string").cast("binary")) % by
