"""Queries that SQL cannot state, against plain Python on small fixtures."""

import hashlib
import re

import pytest

from paperloom.functions.splitter import SIZE, split_text
from paperloom.plans import QUERIES

KEPT = ("Title", "NarrativeText", "Table", "ListItem", "UncategorizedText")
REGIONS = {0: ("AFRICA", [(0, "ALGERIA"), (5, "ETHIOPIA")]), 1: ("ASIA", [(8, "INDIA")])}
LONG = " ".join(f"word{k} and 1 {k} more." for k in range(700))
TEXTS = {
    1: "Scope of it\nFirst line\nends here.\nNext 1O1 5l6\n\nin a header\nmore text:\nitem\nlast",
    2: LONG,
    3: "Title\n" + "\n".join(f"line {k}{'.' if k % 4 == 0 else ''}" for k in range(30)) + "\n" + LONG,
    4: "",
}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, name) for k, (name, _) in REGIONS.items()], "r_regionkey int, r_name string").write.parquet(f"{d}/region.parquet")
    spark.createDataFrame([(n, name, k) for k, (_, nations) in REGIONS.items() for n, name in nations], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    return str(d)


def numbers(t):
    t = re.sub(r"(?<=\d)[lI](?=\d)", "1", re.sub(r"(?<=\d)[Oo](?=\d)", "0", t))
    return re.sub(r"(\d)\s+(\d)", r"\1\2", t)


def elements():
    for doc, text in TEXTS.items():
        lines = text.split("\n")
        kind = lambda k: "Title" if k == 0 else "ListItem" if k % 7 == 0 else "Header" if k % 11 == 5 else "UncategorizedText" if k % 13 == 9 else "NarrativeText"
        yield str(doc), [(k, kind(k), t, 1 + k // 10) for k, t in enumerate(lines)]
    for r, (name, nations) in REGIONS.items():
        grid = "| key | name |\n|---|---|\n" + "\n".join(f"| {n} | {t} |" for n, t in nations)
        yield f"region-{r}", [(0, "Title", f"Region {name}", 1), (1, "NarrativeText", "Nations 1 0 0 of the region:", 1), (2, "Table", grid, 2), (3, "NarrativeText", "After table:", 2), (4, "NarrativeText", "ok", 3)]


def chunks():
    """(doc_id, seq, chunk_index, type, section, is_parent, page_number, content, table_id, parent_id) of all elements."""
    for doc, rows in elements():
        section, groups, before = "General / Introduction", [], None
        for seq, kind, text, page in rows:
            if kind not in KEPT:
                continue
            text = numbers(text)
            section = text.strip() if kind == "Title" else section
            if kind == "Table":
                table, lines = hashlib.md5(f"{doc}:{seq}".encode()).hexdigest(), text.split("\n")
                yield doc, seq, 0, "parent", section, True, page, f"### Table: {section}\n{text}", table, None
                for k, line in enumerate(lines[2:], 1):
                    if line.strip():
                        yield doc, seq, k, "child", section, False, page, "\n".join([f"Context: {section}", *lines[:2], line]), None, table
            elif kind == "Title" or before is None or before[0] == "Table" or (before[0] != "Title" and before[1].endswith((".", ":"))):
                groups.append((seq, page, section, [text]))
            else:
                groups[-1][3].append(text)
            before = kind, text
        for seq, page, section, texts in groups:
            content = numbers("\n".join(texts).strip())
            for k, piece in enumerate(split_text(content) if len(content) > SIZE else [content] if content else []):
                yield doc, seq, k, "text", section, False, page, f"### Section: {section}\n{piece}", None, None


def rows_of(df, *names):
    return sorted(map(repr, map(tuple, df.select(*names).collect())))


def test_enriched_chunks_of_all_documents(spark, small):
    want = [(hashlib.md5(f"{c[0]}:1:{c[7]}".encode()).hexdigest(), c[7], c[4], c[3], f"{c[0]}.pdf", -(-len(c[7]) // 4), c[6], c[0], "1", c[9], c[8]) for c in chunks()]
    assert {c[3] for c in want} == {"text", "parent", "child"} and any(c[2] > 0 for c in chunks() if c[3] == "text")
    names = "chunk_id content section chunk_type source_file tokens page_number company_document_id revision_number parent_id table_id".split()
    assert rows_of(QUERIES["tg05_enrich_all_chunks"](spark, small), *names) == sorted(map(repr, want))


def test_text_chunks_of_all_documents(spark, small):
    want = [c for c in chunks() if c[3] == "text"]
    names = "doc_id seq chunk_index type section is_parent page_number content table_id parent_id".split()
    assert rows_of(QUERIES["tg02_text_chunks"](spark, small), *names) == sorted(map(repr, want))
    assert rows_of(QUERIES["wn05_chunk_index"](spark, small), "doc_id", "seq", "chunk_index", "section", "n_chars") == sorted(repr((c[0], c[1], c[2], c[4], len(c[7]))) for c in want)
    split = [(doc, k, piece) for doc, text in TEXTS.items() for k, piece in enumerate(split_text(text) if len(text) > SIZE else [text])]
    assert rows_of(QUERIES["tg01_recursive_split"](spark, small), "doc_id", "chunk_index", "chunk") == sorted(map(repr, split))
    # whatever the splitter does: no piece is too long, and the words of a text are all there
    words = lambda t: {w.strip(".") for w in t.split()} - {""}
    for doc, text in TEXTS.items():
        pieces = [p for d, _, p in split if d == doc]
        assert all(len(p) <= SIZE for p in pieces) and words(text) == set().union(*map(words, pieces))


def test_summary_counts_all_documents(spark, small):
    docs = [c[0] for c in chunks()]
    got = QUERIES["ag18_ingest_summary_all_chunks"](spark, small)
    assert rows_of(got, "company_document_id", "revision_number", "source_file", "chunk_count") == sorted(repr((d, "1", f"{d}.pdf", docs.count(d))) for d in set(docs))


def test_all_chunks_come_back_from_json(spark, small):
    names = "doc_id seq chunk_index type section is_parent page_number content table_id parent_id".split()
    assert rows_of(QUERIES["io05_all_chunk_json_round_trip"](spark, small), *names) == sorted(map(repr, chunks()))


def test_stream_frames_lose_no_text(spark, tmp_path):
    said = {1: ["short", LONG[:31], "", LONG, LONG[:1011], "x" * 2500], 2: [None, None, LONG + "end"]}
    rows = [(s, turn, "user" if turn % 2 == 0 else "assistant", t) for s, texts in said.items() for turn, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    frames = QUERIES["st05_stream_frames"](spark, str(tmp_path)).collect()
    for stream, texts in said.items():
        own = [f for f in frames if f.stream_id == stream]
        assert "".join(f.value for f in own if f.kind == "text") == "".join(t or "" for t in texts)
        assert [f.seq for f in own if f.kind == "event"] == [turn * 10 + 1 for turn in range(0, len(texts), 2)]


PAGES = {
    1: ("<p>none</p>", ""),
    2: (None, ""),
    3: ("", ""),
    4: ("<p>x</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td> 2\n3</td></tr></table><p>y</p>", "| a | b |\n|---|---|\n| 1 | 2 3 |"),
    5: ("<TABLE><TR><TD>up</TD></TR></TABLE>", "| up |\n|---|"),
    6: ("<table><tr><td>out <table><tr><td>in</td></tr></table></td><td>next</td></tr></table><table><tr><td>other</td></tr></table>", "| out in | next |\n|---|---|"),
    7: ("a &lt;table&gt; in words", ""),
}


def test_tables_of_all_pages(spark, tmp_path):
    spark.createDataFrame([(k, html) for k, (html, _) in PAGES.items()], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.grid for r in QUERIES["io07_page_tables"](spark, str(tmp_path)).collect()}
    assert got == {k: grid for k, (_, grid) in PAGES.items()}


def test_new_hits_reach_the_whole_store(spark, sf):
    from pyspark.sql import functions as F

    last = spark.read.parquet(f"{sf}/documents.parquet").agg(F.max("doc_id")).first()[0]
    far = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id >= 100").select(F.md5(F.concat("source", F.lit(":1:"), "text")).alias("chunk_id"))
    assert last >= 100
    got = QUERIES["so02_restored_first_union_all_ids"](spark, sf)
    assert got.filter("origin = 'new'").join(far, "chunk_id", "left_semi").count() > 0
