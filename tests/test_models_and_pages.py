"""Models as plug-ins, the splitter as a table function, and page ranges as partitions."""

import os

import pytest
from pyspark.sql import functions as F

from paperloom.functions.splitter import chunks_of, register_splitter, split_rows, split_text
from paperloom.operators import models as M
from paperloom.operators import retrieval as R
from paperloom.sources import pages as P


def counting(folder):
    """A loader that leaves a file for each time it is called."""

    def load():
        with open(f"{folder}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    return load


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    texts = spark.range(0, 400, 1, 16).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("content"))
    rows = M.embedded(texts, counting(tmp_path), batch=5)
    for _ in range(2):  # the same column again: workers that are still there have the model
        found = rows.collect()
    assert all(r.embedding == pytest.approx([len(r.content) / (len(r.content) ** 2 + 1) ** 0.5, 1 / (len(r.content) ** 2 + 1) ** 0.5]) for r in found)
    pids = (tmp_path / "loads").read_text().split()
    assert len(pids) == len(set(pids)) < 16


def test_a_model_sees_each_text_once(spark, tmp_path):
    def load():
        def embed(texts):
            with open(f"{tmp_path}/seen", "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[1.0, float(t[1:])] for t in texts]

        return embed

    chunks = spark.range(60).select(F.format_string("c%02d", "id").alias("chunk_id"), F.lit("d").alias("company_document_id"), F.lit("1").alias("revision_number"), F.concat(F.lit("t"), "id").alias("content"))
    asked = chunks.filter("chunk_id = 'c07'").select(F.lit(1).alias("qid"), "company_document_id", "revision_number", F.array(F.lit(1.0), F.lit(7.0)).alias("vector"))
    found = R.vector_search(asked, M.embedded_once(chunks, load), 1).collect()
    assert [r.chunk_id for r in found] == ["c07"] and sorted((tmp_path / "seen").read_text().split()) == sorted(f"t{k}" for k in range(60))
    questions = spark.createDataFrame([(f"t{k} which of the wells flows", k) for k in range(9)], "question string, k int")
    (tmp_path / "asked").mkdir()

    def counted():
        def score(texts):
            with open(f"{tmp_path}/asked/seen", "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[0.1, 0.9] for _ in texts]

        return score

    assert {r.intent for r in M.classified(questions, counted, ["greeting", "definition"]).collect()} == {"definition"}
    assert len((tmp_path / "asked" / "seen").read_text().splitlines()) == 9


def test_null_texts_and_wrong_models(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (1, "ab")], "id int, content string")
    got = {r.id: r.embedding for r in M.embedded(rows, lambda: lambda texts: [[0.0, 3.0 * len(t)] for t in texts]).collect()}
    assert got == {1: [0.0, 1.0], 2: None, 3: [0.0, 0.0]}
    assert M.embedded(rows.limit(0), counting(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="embedding"):
        M.embedded(rows.withColumn("embedding", F.lit(1)), counting(tmp_path))
    with pytest.raises(Exception, match="results for"):
        M.embedded(rows.coalesce(1), lambda: lambda texts: [[1.0]]).collect()


def test_zero_shot(spark):
    labels = ["greeting or casual conversation", "definition question", "follow-up question"]
    scores = {"what would the flow be": [0.2, 0.9, 0.3], "the flow once more here": [0.1, 0.2, 0.3], "close call of two labels": [0.7, 0.7, 0.1], "weak scores all of them": [0.4, 0.1, 0.1]}
    rows = spark.createDataFrame([*((q,) for q in scores), (None,), ("hello there",)], "question string")
    got = {r.question: r.intent for r in M.classified(rows, lambda: lambda texts: [scores[t] for t in texts], labels).collect()}
    assert got == {
        "what would the flow be": "definition", "the flow once more here": "follow_up", "close call of two labels": "fact_lookup", "weak scores all of them": "fact_lookup", None: "fact_lookup", "hello there": "greeting",
    }


def test_reranking_by_a_model(spark):
    rows = spark.createDataFrame([(1, "a", 0, "q", "long text"), (1, "b", 1, "q", "t"), (1, "c", 2, "q", None), (2, "a", 0, "r", "t")], "qid int, chunk_id string, pos int, question string, content string")
    scorer = M.model_scorer(lambda: lambda questions, contents: [1.0 / len(c) for c in contents])
    got = [(r.qid, r.chunk_id, r["rank"]) for r in R.rerank(rows, 2, scorer).orderBy("qid", "rank").collect()]
    assert got == [(1, "b", 1), (1, "a", 2), (2, "a", 1)]


TEXTS = ["", None, "short", "word " * 3000, "a. b\n" * 900 + "\n\n" + "x" * 7000 + "\n\n" + "tail. " * 40, "\n\n".join("par %d " % k * 100 for k in range(40)), "x" * 6500, " \n\n " * 2000]


def test_table_function(spark):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "id bigint, text string, chunk string")
    want = sorted((k, n, c) for k, t in enumerate(TEXTS) if t for n, c in enumerate(split_text(t)))
    got = split_rows(rows, "id", "text")
    assert got.columns == ["id", "chunk_index", "chunk"] and sorted(map(tuple, got.collect())) == want
    assert split_rows(rows.limit(0), "id", "text").collect() == []
    with pytest.raises(ValueError, match="another name"):
        split_rows(rows, "chunk", "text")
    register_splitter(spark)
    rows.createOrReplaceTempView("split_rows")
    assert sorted(map(tuple, spark.sql("SELECT * FROM split_text(TABLE(SELECT id, text FROM split_rows))").collect())) == want


def test_chunks_come_one_by_one():
    text = "some words of a sentence. " * 400_000
    chunks = chunks_of(text)
    first = next(chunks)
    assert text.startswith(first) and len(first) <= 3000
    assert sum(1 for _ in chunks) > 3000


class Lettered:
    """Pages of ten bytes; a page that begins with z cannot be read."""

    def count(self, file):
        return -(-file.size() // 10)

    def pages(self, file, first, last):
        for k in range(first - 1, last):
            file.seek(10 * k)
            body = file.read(10).decode()
            yield None if body.startswith("z") else [("Letter", c) for c in body.strip()]


def test_page_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "one.pdf").write_text("abc       z23456789 d         " + " " * 10 + "e")
    (tmp_path / "in" / "two.pdf").write_text("f")
    (tmp_path / "in" / "empty.pdf").write_text("")
    (tmp_path / "other.txt").write_text("no")
    P.page_source(spark, Lettered(), "lettered")
    df = spark.read.format("lettered").option("pages", 2).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4  # three ranges of one file, one of the other
    got = sorted((os.path.basename(r.doc_id), r.page_number, r.place, r.text) for r in df.collect())
    assert got == [("one.pdf", 1, 0, "a"), ("one.pdf", 1, 1, "b"), ("one.pdf", 1, 2, "c"), ("one.pdf", 3, 0, "d"), ("one.pdf", 5, 0, "e"), ("two.pdf", 1, 0, "f")]
    assert spark.read.format("lettered").load(str(tmp_path / "in" / "two.pdf")).count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format("lettered").load(str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="missing"):
        spark.read.format("lettered").load(str(tmp_path / "missing")).collect()


@pytest.mark.parametrize("size", [1, 5, 7, 1000])
def test_line_pages(spark, tmp_path, size):
    lines = ["", "ab", "a long line of many bytes", "ü", "", "end"] * 3
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    P.page_source(spark, P.LinePages(size), f"lines_{size}")
    rows = spark.read.format(f"lines_{size}").option("ending", ".txt").option("pages", 3).load(str(tmp_path)).orderBy("page_number", "place").collect()
    assert [r.text for r in rows] == lines
