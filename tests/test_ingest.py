"""Tables as they are ingested: HTML, boxes, stored entities and the guard of the store."""

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.operators import chunking as C
from paperloom.operators import retrieval as R
from paperloom.sources import store as T

GRID = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"


@pytest.fixture(scope="module")
def elements(spark):
    rows = [
        ("d", 0, "Title", "First part", 1, None, None),
        ("d", 1, "Table", "a b 1 2 3", 2, GRID, [[1.0, 2.5], [3.0, 4.0]]),
        ("d", 2, "Table", "| x |\n|---|\n| 1 |\n|  |\n\n", 3, None, None),
        ("d", 3, "Table", "left as it is", 4, "", []),
        ("d", 4, "Table", "lost", 5, "<p>no table</p>", [[0.0, 0.0]]),
        ("d", 5, "NarrativeText", "A line of text.", 6, None, [[9.0, 9.0]]),
    ]
    return spark.createDataFrame(rows, schemas.ELEMENT)


def test_tables_of_html(elements):
    """TG03/TG04: HTML is converted where there is any; children inherit page and box."""
    got = {(r.seq, r.chunk_index): (r.content, r.bbox, r.page_number) for r in C.table_chunks(elements).collect()}
    grid = "| a | b |\n|---|---|"
    assert got[1, 0] == (f"### Table: First part\n{grid}\n| 1 | 2 |\n| 3 |  |", "[[1.0, 2.5], [3.0, 4.0]]", 2)
    assert got[1, 1] == (f"Context: First part\n{grid}\n| 1 | 2 |", "[[1.0, 2.5], [3.0, 4.0]]", 2) and got[1, 2][0].endswith("| 3 |  |")
    assert got[2, 0][1] == "" and {k for k in got if k[0] == 2} == {(2, 0), (2, 1), (2, 2)}
    assert got[3, 0][:2] == ("### Table: First part\nleft as it is", "[]") and got[4, 0][:2] == ("### Table: First part\n", "[[0.0, 0.0]]")
    assert "bbox" not in C.table_chunks(elements.drop("points", "text_as_html")).columns


def test_stored_entities(spark, elements):
    """TG05, then PJ02: the box that a viewer parses is the element's."""
    rows = C.enriched_rows(C.chunk_elements(elements), "B", F.lit("f.pdf"), 100, "IFC")
    plain = lambda t: "".join(c for c in t if c not in " `")
    want = {f.name: plain(f.dataType.simpleString()) for f in spark.createDataFrame([], schemas.ENRICHED_CHUNK).schema}
    assert {f.name: plain(f.dataType.simpleString()) for f in rows.schema} == want
    got = rows.collect()
    assert {(r.cmetadata.revision_number, r.cmetadata.revision_code, r.cmetadata.revision_date, r.cmetadata.document_type, r.metadata.created_at) for r in got} == {("B", "IFC", 100, None, 100)}
    assert {r.metadata.bbox for r in got if r.metadata.chunk_type == "text"} == {""}
    store = rows.select("chunk_id", F.col("page_content").alias("content"), "metadata.section", "metadata.chunk_type", F.col("metadata.page_number").cast("string").alias("page"), "metadata.bbox", F.col("cmetadata.company_document_id").alias("company_document_id"))
    boxes = [r.bbox for r in R.formatted(store).filter("chunk_type = 'child' AND page_number = 2").collect()]
    assert boxes == [[[1.0, 2.5], [3.0, 4.0]]] * 2
    with pytest.raises(ValueError, match="revision"):
        C.enriched_rows(C.chunk_elements(elements), "", F.lit("f.pdf"), 100)


def test_the_store_refuses_other_documents(spark, tmp_path):
    """IO08: a row of another document, of another revision or of none fails the write, and nothing is kept."""
    schema = "chunk_id string, company_document_id string, revision_number string, content string"
    path = str(tmp_path / "store")
    good = spark.createDataFrame([("1", "D", "1", "a"), ("1", "D", "1", "a"), ("2", "D", "1", "b")], schema)
    T.append_store(good, path, once=True, identity=("D", "1"))
    for row in (("3", "E", "1", "c"), ("3", "D", "2", "c"), ("3", None, "1", "c"), ("3", "D", None, "c")):
        with pytest.raises(Exception, match="another document"):
            T.append_store(good.unionByName(spark.createDataFrame([row], schema)), path, identity=("D", "1"))
    with pytest.raises(Exception, match="another document"):
        T.append_store(spark.createDataFrame([("3", "D", None, "c")], schema), path)
    assert spark.read.parquet(path).count() == 2
