"""IO01 as a data source whose partitions are page ranges, so that a large file is not one task."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages of a partition where the option `pages` is not given.
PAGES = 16
SCHEMA = "doc_id string, page_number int, place int, category string, text string"


class PagedParser(Protocol):
    """Reads files by their pages. An open file can be sought in, so a parser need not read it whole."""

    def count(self, file: pa.NativeFile) -> int:
        """The number of pages."""

    def pages(self, file: pa.NativeFile, first: int, last: int) -> Iterable[list[tuple[str, str]] | None]:
        """The (category, text) pairs of each of the pages first to last, numbered from 1; None for a page that cannot be read."""


class PageRange(InputPartition):
    """Some pages of one file."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    uri = f"file://{path.removeprefix('file:')}" if path.startswith(("/", "file:/")) and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(uri)


def _files(path: str, ending: str) -> list[str]:
    """The file, or all files with an ending below a folder, in order."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    head = path.rstrip("/")
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(head + f.path[len(inner.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.path.endswith(ending))


class PageReader(DataSourceReader):
    """Plans by the files' page counts, which the parser tells from open files while the plan is made; page ranges are read by tasks.

    This is for large files. Folders of very many small ones are better read by
    `files.read_pdfs`, which opens each file once, in a task.
    """

    def __init__(self, parser: PagedParser, options: dict[str, str]):
        self.parser, self.path, self.ending, self.size = parser, options["path"], options.get("ending", ".pdf"), int(options.get("pages", PAGES))
        if self.size < 1:
            raise ValueError("a partition has at least one page")

    def partitions(self) -> list[PageRange]:
        ranges = []
        for path in _files(self.path, self.ending):
            system, inner = _opened(path)
            with system.open_input_file(inner) as file:
                n = self.parser.count(file)
            ranges += [PageRange(path, k, min(k + self.size - 1, n)) for k in range(1, n + 1, self.size)]
        return ranges or [PageRange("", 1, 0)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, inner = _opened(partition.path)
        with system.open_input_file(inner) as file:
            for number, parts in enumerate(self.parser.pages(file, partition.first, partition.last), partition.first):
                if parts:
                    n = len(parts)
                    columns = [pa.array([partition.path] * n), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([c for c, _ in parts], pa.string()), pa.array([t for _, t in parts], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page_number", "place", "category", "text"])


def page_source(spark: SparkSession, parser: PagedParser, name: str = "pages") -> None:
    """Register a parser as a batch source: `spark.read.format(name).option("pages", 16).load(path)`.

    Rows are (doc_id, page_number, place, category, text): the file, the page,
    and the element's place on it; together they are the order of elements.
    Options: `ending` of the files below a folder (`.pdf`), `pages` of a
    partition. Pages that cannot be read, and empty ones, give no rows; a folder
    without files gives none. Any file system that Arrow opens by URI will do.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> PageReader:
            return PageReader(parser, self.options)

    spark.dataSource.register(Pages)


class LinePages:
    """A parser of text files: a page is the lines that begin in `size` bytes of a file, an element of the category Line each."""

    def __init__(self, size: int = 1 << 18):
        self.size = size

    def count(self, file: pa.NativeFile) -> int:
        return -(-file.size() // self.size)

    def pages(self, file: pa.NativeFile, first: int, last: int) -> Iterator[list[tuple[str, str]]]:
        lines = io.BufferedReader(file)
        at = (first - 1) * self.size
        if at:
            # the line that byte at - 1 belongs to, or ends, began on an earlier page
            lines.seek(at - 1)
            at += len(lines.readline()) - 1
        for page in range(first, last + 1):
            parts = []
            while at < page * self.size and (line := lines.readline()):
                at += len(line)
                parts.append(("Line", line.rstrip(b"\n").decode("utf-8", "replace")))
            yield parts
        lines.detach()
