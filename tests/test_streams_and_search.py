"""Processors, element files and searches against plain Python, with nulls, ties and small blocks."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import retrieval as R
from paperloom.operators.events import PREFIX
from paperloom.plans import QUERIES
from paperloom.sources import files as S
from paperloom.streaming import processors as P


def test_null_keys_are_one_key(spark):
    big = (1 << 62) + 1
    rows = [(None, 1, 0.0), (None, 2, 1.0), (None, 3, 2.0), (big, 4, 0.0), (big, 5, 500.0), (big + 1, 6, 1.0)]
    df = spark.createDataFrame(rows, "session_id bigint, event_id bigint, t double").repartition(3)
    got = P.fold(df, ["session_id"], [F.col("t")], lambda: P.Limiter(1, 60), "session_id bigint, event_id bigint, admitted boolean").collect()
    assert {(r.session_id, r.event_id): r.admitted for r in got} == {(None, 1): True, (None, 2): False, (None, 3): False, (big, 4): True, (big, 5): True, (big + 1, 6): True}
    assert P.fold(df.limit(0), ["session_id"], [F.col("t")], P.Limiter, "session_id bigint, event_id bigint, admitted boolean").count() == 0


def test_admission():
    a = P.Admission(3, 60, 2)
    step = lambda t, until: a.row({"event_id": 0, "t": t, "until": until})[0]["reason"]
    assert [step(0, 10), step(1, 5), step(2, 9), step(5, 8), step(7, 9), step(9, 99), step(61, 99), step(62, 99), step(63, 99), step(70, 99)] == [None, None, "streams", None, "rate", "rate", None, None, "rate", "streams"]


def test_cached_reads():
    c = P.CachedReads(30)
    step = lambda t, force=False: c.row({"event_id": 0, "t": t, "force": force})[0]["cached"]
    assert [step(0), step(29), step(30), step(59), step(59, True), step(60), step(88), step(89)] == [False, True, False, True, False, True, True, False]


def test_line_buffer():
    b = P.LineBuffer()
    assert [b.row({"chunk": c}) for c in ("a", None, "b\n\n c", "\n", "rest")] == [[], [], [{"k": 0, "line": "ab"}], [{"k": 1, "line": "c"}], []] and b.end() == []


def test_safe_stream():
    def run(*chunks, abort=None, fail=None):
        s = P.SafeStream()
        out = [f for k, c in enumerate(chunks) for f in s.row({"seq": k, "chunk": c, "aborted": k == abort, "failed": k == fail})]
        return [(f["kind"], f["value"]) for f in out + s.end()]

    text = PREFIX + json.dumps({"type": "TEXT", "content": " b"}) + "\n"
    other = PREFIX + '{"type":"SOURCES"}\n'
    assert run("a", text, None, "", PREFIX + "{broken", PREFIX + "3", other, "c ") == [("text", "a"), ("text", " b"), ("event", other), ("text", "c "), ("kept", "a bc")]
    assert run("a", "b", "c", abort=1) == [("text", "a"), ("event", PREFIX + '{"type":"ERROR","message":"Generation aborted"}\n')]
    assert run("a", "b", fail=1)[-1] == ("event", PREFIX + '{"type":"ERROR","message":"Generation failed"}\n')
    assert run(" ", other) == [("text", " "), ("event", other), ("event", PREFIX + '{"type":"SYSTEM_MESSAGE","message":"Model produced no output"}\n')]


def test_element_arrays(spark, tmp_path):
    items = [{"doc_id": "d", "category": "Title", "text": "é"}, {"doc_id": "d", "category": "Table", "text": None, "page_number": 2}]
    (tmp_path / "pretty").mkdir()
    (tmp_path / "pretty" / "a.json").write_text(json.dumps(items, indent=2))
    got = S.read_elements(spark, str(tmp_path / "pretty"), whole_files=True).orderBy("seq").collect()
    assert [(r.seq, r.category, r.text, r.page_number) for r in got] == [(0, "Title", "é", None), (1, "Table", None, 2)]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        S.read_elements(spark, str(tmp_path / "pretty")).collect()
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join([json.dumps(items), "", json.dumps({"doc_id": "e", "seq": 7, "category": "Title", "text": "x"})]))
    assert sorted((r.doc_id, r.seq) for r in S.read_elements(spark, str(tmp_path / "lines")).collect()) == [("d", 0), ("d", 1), ("e", 7)]


@pytest.fixture(scope="module")
def library(spark):
    """Chunks of three documents with equal contents, equal lengths and nulls, and questions about them."""
    rnd = random.Random(4)
    words = ["valve", "pump", "flare", "pressure", "depth", "Well", "ndu-101", "field", "oil", "gas"]
    chunks = [(f"c{k:03d}" if k % 9 else f"c{k - 1:03d}", f"d{k % 3}", "1", None if k % 31 == 0 else " ".join(rnd.choices(words, k=rnd.randrange(1, 6)))) for k in range(300)]
    asked = [(q, f"d{q % 4}", "1", " ".join(rnd.choices([*words, "the", "zz"], k=rnd.randrange(0, 4)))) for q in range(40)] + [(90, None, "1", "valve"), (91, "d1", None, "valve"), (92, "d1", "1", None)]
    identity = "company_document_id string, revision_number string"
    return chunks, asked, spark.createDataFrame(chunks, f"chunk_id string, {identity}, content string").repartition(5), spark.createDataFrame(asked, f"qid bigint, {identity}, question string")


def keywords_of(spark, asked):
    df = spark.createDataFrame([(q, t) for q, _, _, t in asked], "qid bigint, question string")
    return {r.qid: r.k or [] for r in df.select("qid", X.extract_keywords(F.col("question")).alias("k")).collect()}


@pytest.mark.parametrize(("block", "hot", "automaton"), [(4096, 16_384, True), (2, 3, True), (4096, 16_384, False)])
def test_keyword_search(spark, library, monkeypatch, block, hot, automaton):
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    monkeypatch.setattr(R, "HOT", hot)
    if not automaton:
        monkeypatch.setattr(R, "ahocorasick", None)
    chunks, asked, store, questions = library
    keywords, want, counts = keywords_of(spark, asked), set(), {}
    for q, document, revision, _ in asked:
        hits = sorted((len(t), c, t) for c, d, r, t in chunks if t is not None and (d, r) == (document, revision) and any(w in t.lower() for w in keywords[q]))
        seen = set()
        for rank, (_, c, t) in enumerate(hits[:10], 1):
            if t not in seen:
                want.add((q, c, rank))
            seen.add(t)
        if hits:
            counts[q] = len(hits)
    # chunks with one id and length may change places, so ranks are compared with their ids
    assert {tuple(r) for r in R.keyword_search(questions, store).collect()} == want and want
    assert {r.qid: r.n_chunks for r in R.keyword_counts(questions, store).collect()} == counts
    assert R.keyword_search(questions.limit(0), store).count() == 0 and R.keyword_search(questions, store.limit(0)).count() == 0
    # rows without ids take no part
    odd = store.unionByName(store.withColumn("chunk_id", F.lit(None).cast("string")))
    asking = questions.unionByName(questions.withColumn("qid", F.lit(None).cast("bigint")))
    assert {tuple(r) for r in R.keyword_search(asking, odd).collect()} == want


@pytest.mark.parametrize(("block", "hot"), [(4096, 16_384), (3, 7)])
def test_vector_search(spark, monkeypatch, block, hot):
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    monkeypatch.setattr(R, "HOT", hot)
    rnd = random.Random(7)
    vector = lambda: [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    chunks = [(f"c{k}", f"d{k % 3}", "1", vector() if k % 13 else None) for k in range(120)]
    asked = [(q, f"d{q % 4}", "1", vector() if q != 5 else None) for q in range(12)] + [(50, None, "1", vector())]
    identity = "company_document_id string, revision_number string"
    store = spark.createDataFrame(chunks, f"chunk_id string, {identity}, embedding array<float>").repartition(4)
    queries = spark.createDataFrame(asked, f"qid bigint, {identity}, vector array<float>")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0

    def best(q, among, k):
        return {(q[0], c, rank) for rank, (_, c) in enumerate(sorted((-cosine(q[3], v), c) for c, d, r, v in among if v is not None)[:k], 1)}

    want = set().union(*(best(q, [c for c in chunks if c[1:3] == q[1:3]], 5) for q in asked if q[3] is not None))
    assert {(r.qid, r.chunk_id, r["rank"]) for r in R.vector_search(queries, store, 5).collect()} == want
    want = set().union(*(best(q, chunks, 3) for q in asked if q[3] is not None))
    assert {(r.qid, r.chunk_id, r["rank"]) for r in R.global_search(queries, store, 3).collect()} == want
    assert R.vector_search(queries.limit(0), store).count() == 0 and R.global_search(queries, store.limit(0)).count() == 0
    # null ids, vectors with nulls and vectors of another length are passed over, on both sides
    odd = [(None, "d1", "1", [1.0] * 4), ("x", "d1", "1", [1.0, None, 1.0, 1.0]), ("y", "d1", "1", [1.0] * 3), ("z", "d1", "1", [])]
    more = store.unionByName(spark.createDataFrame(odd, store.schema))
    asking = queries.unionByName(spark.createDataFrame([(None, "d1", "1", [1.0] * 4), (60, "d1", "1", [1.0] * 2), (61, "d1", "1", [None] * 4), (62, "d1", "1", [])], queries.schema))
    assert {(r.qid, r.chunk_id, r["rank"]) for r in R.global_search(asking, more, 3).collect()} == want
    assert {r.chunk_id for r in R.vector_search(spark.createDataFrame([(63, "d1", "1", [1.0] * 3)], queries.schema), more, 3).collect()} == {"y"}


def by_pairs(asked, chunks):
    """(qid, chunk_id, score in millionths) of all pairs of one identity; halves are rounded away from zero."""

    def millionths(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        dot = aa = bb = 0.0
        for x, y in zip(a, b, strict=True):
            dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
        score = max(-1.0, min(dot / math.sqrt(aa * bb), 1.0)) * 1e6
        return int(math.copysign(math.floor(abs(score)) + (abs(score) % 1 >= 0.5), score))

    return [(q, c, millionths(v, w)) for q, *of, v in asked for c, *by, w in chunks if of == by and None not in of]


@pytest.mark.parametrize(("block", "scored"), [(4096, 4096), (7, 20)])
def test_scores_of_all_pairs(spark, monkeypatch, block, scored):
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    monkeypatch.setattr(R, "SCORED", scored)
    rnd = random.Random(9)
    odd = [None, [], [0.0] * 5, [1.0] * 4, [1.0, None, 1.0, 1.0, 1.0]]
    half = [1.0, 0.0, 0.0, 0.0, 0.0], [1.0, 127.0, 15.0, 5.0, 2.0], [-1.0, 127.0, 15.0, 5.0, 2.0]  # similarities of 1/128 and -1/128
    vector = lambda: [rnd.uniform(-1, 1) for _ in range(5)]
    rows = lambda name, n, of: [(name(k), f"d{k % 2 if k < 60 else 0}", "1", (odd + list(half))[k // 2] if k < 16 else vector()) for k in range(n)] + [(name(n), None, "1", vector()), (name(n + 1), "d0", None, vector()), (name(n + 2), of, "1", vector())]
    chunks, asked = rows("c{}".format, 400, "unasked"), rows(int, 130, "absent")
    identity = "company_document_id string, revision_number string"
    store = spark.createDataFrame(chunks, f"chunk_id string, {identity}, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(asked, f"qid bigint, {identity}, vector array<double>")
    got = R.similarity_scores(queries, store)
    assert got.schema["score"].dataType.simpleString() == "decimal(12,6)"
    key = lambda r: (r[0], r[1])
    found = sorted(((r.qid, r.chunk_id, None if r.score is None else int(r.score.scaleb(6))) for r in got.collect()), key=key)
    assert found == sorted(by_pairs(asked, chunks), key=key) and (10, "c12", 7813) in found and (10, "c14", -7813) in found and (0, "c12", None) in found
    assert len(found) > 32_768 and R.similarity_scores(queries.limit(0), store).count() == 0 and R.similarity_scores(queries, store.limit(0)).count() == 0


def test_score_query_takes_blocks_not_pairs(spark, tmp_path):
    """Vectors without a similarity keep their pairs, and no join puts two vectors into a row."""
    rows = [(k, [1.0, float(k)] if k < 100 else [] if k < 120 else None, 7) for k in range(180)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["jn01_similarity_scores"](spark, str(tmp_path))
    by = lambda name: [(name(k), k % 3, v) for k, v, _ in rows]
    assert sorted((r.qid, r.chunk_id, r.score is None) for r in got.collect()) == sorted((q, c, s is None) for q, c, s in by_pairs([x for x in by(int) if x[0] % 20 == 0], by(str)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "zip_with" not in plan


def test_searches_run_nothing_while_planned(spark):
    """No job before the result is read, whatever the questions, and one pass over the cells."""
    queries = spark.range(3).selectExpr("id AS qid", "'d' AS company_document_id", "'1' AS revision_number", "if(id < 2, array(1D, raise_error('read')), array(0D, 1D)) AS vector", "'which pump pressure' AS question")
    chunks = spark.range(9).selectExpr("string(id) AS chunk_id", "'d' AS company_document_id", "'1' AS revision_number", "array(1D, id) AS embedding", "concat('pump ', id) AS content")
    plans = [R.vector_search(queries, chunks), R.global_search(queries, chunks), R.keyword_search(queries, chunks)]
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for df in plans] == [1, 1, 1]


def test_token_plug_in(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    assert [r.n for r in df.select(X.count_tokens(F.col("t"), lambda texts: [len(t.split()) for t in texts]).alias("n")).collect()] == [2, 0, 0]
    assert [r.n for r in df.select(X.count_tokens(F.col("t")).alias("n")).collect()] == [1, 0, 0]


def test_unknown_models(spark):
    from paperloom.operators.events import model_id

    df = spark.createDataFrame([("x",), (None,)], "m string")
    assert {r.n for r in df.select(model_id(F.col("m"), {"a": "b"}, "lite").alias("n")).collect()} == {"lite"}
    with pytest.raises(Exception, match="unknown model"):
        df.select(model_id(F.col("m"), {"a": "b"})).collect()
