"""TG01: recursive text splitting by separators, with overlap."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunk size and overlap in characters, and the separators from coarse to fine.
SIZE, OVERLAP, SEPARATORS = 3000, 400, ("\n\n", "\n", ". ", " ", "")
#: Chunks that the table function passes on at once.
BATCH = 256


def _pieces(text: str, separator: str) -> Iterator[str]:
    """Cut before each separator, which stays at the start of the next piece."""
    if not separator:
        yield from text
        return
    start, at = 0, text.find(separator)
    while at >= 0:
        if at > start:
            yield text[start:at]
        start, at = at, text.find(separator, at + len(separator))
    if start < len(text):
        yield text[start:]


class _Joined:
    """Chunks of consecutive pieces, each begun with up to `overlap` characters of the one before."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap, self.window, self.total = size, overlap, deque(), 0

    def _chunk(self) -> list[str]:
        chunk = "".join(self.window).strip()
        return [chunk] if chunk else []

    def add(self, piece: str) -> list[str]:
        """Take a piece; gives the chunk that it ends, if there is one."""
        ended, window = [], self.window
        if window and self.total + len(piece) > self.size:
            ended = self._chunk()
            while window and (self.total > self.overlap or self.total + len(piece) > self.size):
                self.total -= len(window.popleft())
        window.append(piece)
        self.total += len(piece)
        return ended

    def end(self) -> list[str]:
        """The last chunk; the next piece begins anew."""
        ended = self._chunk()
        self.window.clear()
        self.total = 0
        return ended


def chunks_of(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Chunks of at most `size` characters one by one, cut at the coarsest separator that occurs; longer pieces are cut at finer ones."""
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer, small = separators[at + 1 :], _Joined(size, overlap)
    for p in _pieces(text, separators[at]):
        if len(p) < size:
            yield from small.add(p)
            continue
        yield from small.end()
        if finer:
            yield from chunks_of(p, size, overlap, finer)
        else:
            yield p
    yield from small.end()


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """All chunks of a text."""
    return list(chunks_of(text, size, overlap, separators))


def _split_long(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: split_text(t) if t is not None else None)


def split_chunks(c: Column) -> Column:
    """Chunks of a text. Only texts of more than one chunk are sent to Python; another is its own chunk."""
    split = F.pandas_udf(_split_long, "array<string>")
    return F.when(F.length(c) <= SIZE, F.array(c)).otherwise(split(F.when(F.length(c) > SIZE, c)))


def splitter(id_type: str = "bigint"):
    """TG01 as a table function of a table (id, text): rows (id, chunk_index, chunk), passed on in batches as they are made, so a text of any length never has its chunks in one array.

    A null or empty text has none; repeated rows are split each; a null id stays
    null. Further columns are not read.
    """

    @F.arrow_udtf(returnType=f"id {id_type}, chunk_index int, chunk string")
    class SplitText:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            for k, text in enumerate(rows.column(1).to_pylist()):
                for part in batched(enumerate(chunks_of(text)) if text else (), BATCH):
                    ids = pa.concat_arrays([rows.column(0).slice(k, 1)] * len(part))
                    yield pa.table({"id": ids, "chunk_index": pa.array([n for n, _ in part], pa.int32()), "chunk": pa.array([c for _, c in part], pa.string())})

    return SplitText


def split_rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The chunks of a table's texts by the table function: (id_col, chunk_index, chunk)."""
    if id_col in ("chunk_index", "chunk"):
        raise ValueError(f"the id column needs another name than {id_col}")
    asked = rows.select(rows[id_col].alias("id"), rows[text_col].alias("text"))
    return splitter(asked.schema["id"].dataType.simpleString())(asked.asTable()).withColumnRenamed("id", id_col)


def register_splitter(spark: SparkSession, name: str = "split_text", id_type: str = "bigint") -> None:
    """Make the table function known to SQL: `SELECT * FROM split_text(TABLE(SELECT doc_id, text FROM documents))`."""
    spark.udtf.register(name, splitter(id_type))
