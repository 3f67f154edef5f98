"""IO07: the first table of an HTML text as a Markdown grid."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Table(HTMLParser):
    """Cells of the first table."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth, self.done, self.cell = 0, False, None

    def handle_starttag(self, tag, attrs):
        if tag == "table" and not self.done:
            self.depth += 1
        elif self.depth == 1 and not self.done:
            if tag == "tr":
                self._end_cell()
                self.rows.append([])
            elif tag in ("td", "th"):
                self._end_cell()
                self.cell = []

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("td", "th", "tr"):
            self._end_cell()
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self._end_cell()
                self.done = True

    def handle_data(self, data):
        if self.cell is not None and not self.done:
            self.cell.append(data)

    def _end_cell(self):
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def html_to_markdown(html: str | None) -> str:
    """The first table's grid, its first row as the header; empty where there is none."""
    parser = _Table()
    parser.feed(html or "")
    parser.close()
    rows = [r for r in parser.rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * width, *map(line, rows[1:])])


def _convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(html_to_markdown)


def markdown_table(html: Column) -> Column:
    """The grid of each text's first table; only texts with a table are sent to Python."""
    has = F.lower(html).contains("<table")
    return F.when(has, F.pandas_udf(_convert, "string")(F.when(has, html))).otherwise("")
