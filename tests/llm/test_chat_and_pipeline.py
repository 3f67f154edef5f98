"""Operator 6, the pipeline, and the queries' SQL."""

import json
import os
import random

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece

import __spark_entry__
import corpus_pipeline
from paperloom.llm import pii, queries, tool_calls
from paperloom.llm.common import shared_dir

SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 1}, "k": {"enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "string", "minLength": 2}}}}}


def test_schema_problems():
    check = lambda v: tool_calls.problems(v, SCHEMAS["f"])
    assert check({"x": 1, "k": "a", "l": ["ab"]}) == []
    assert check({"x": True}) == ["$.x: not integer"] and check({"x": 0}) == ["$.x: out of range"] and check({}) == ["$.x: missing"]
    assert check({"x": 1, "z": 1, "k": "c", "l": ["a"]}) == ["$.k: not in enum", "$.l[0]: too short", "$.z: unknown"] and check([]) == ["$: not object"]


def brute_order(edges, positions):
    """(key, cyclic) of each call: keys by recursion; what recursion cannot reach is on or behind a cycle."""
    keys = {}
    while True:
        free = [c for c in positions if c not in keys and all(d in keys for d in edges.get(c, ()) if d in positions)]
        if not free:
            return {c: (keys[c], False) if c in keys else ((positions[c], 0), True) for c in positions}
        for c in free:
            keys[c] = max([(positions[c], 0), *((keys[d][0], keys[d][1] + 1) for d in edges.get(c, ()) if d in positions)])


@pytest.mark.parametrize("block", [4096, 7])
def test_order_against_brute_force(spark, monkeypatch, block):
    """Long chains of forward references, references over blocks, cycles and what lies behind them."""
    monkeypatch.setattr(tool_calls, "BLOCK_TURNS", block)
    rnd = random.Random(block)
    cases = {1: {k: [k + 1] for k in range(70)}, 2: {k: [rnd.randrange(60) for _ in range(rnd.randrange(3))] for k in range(40)}, 3: {k: [rnd.randrange(k + 1, 40)] if k < 39 and rnd.random() < 0.4 else [max(0, k - 1)] if k else [] for k in range(40)}, 4: {0: [0], 1: [0], 2: [77]}, 6: {k: [k - 1] for k in range(1, 50)}}
    if block > 100:
        cases[5] = {k: [k + 1] for k in range(1000)} | {1000: [1200]}
    rows, want = [], {}
    for conv, edges in cases.items():
        positions = {k: k for k in range(max(max(d, default=0) for d in edges.values()) + 1)} if conv != 4 else {0: 0, 1: 1, 2: 2}
        rows += [(conv, str(k), {"turn": k, "k": 0}, "f", "1", [str(d) for d in edges.get(k, ())]) for k in positions]
        want |= {(conv, str(k)): (key[0], key[1], bad) for k, (key, bad) in brute_order(edges, positions).items()}
    calls = spark.createDataFrame(rows, "conv_id bigint, call_id string, position struct<turn:bigint,k:int>, name string, arguments string, depends_on array<string>")
    got = {(r.conv_id, r.call_id): (r.after.turn, r.hop, r.cyclic) for r in tool_calls.ordered(calls).collect()}
    assert got == want and not any(bad for (conv, _), (_, _, bad) in want.items() if conv in (1, 5, 6)) and want[4, "1"][2]


@pytest.mark.parametrize("widest", [1 << 18, 4096])
def test_a_chain_to_and_fro(spark, monkeypatch, widest):
    """Blocks grow, so a chain that changes blocks with each call takes few rounds; at the widest block it takes as many as it must."""
    monkeypatch.setattr(tool_calls, "WIDEST", widest)
    rounds = []
    peel = tool_calls.peel_blocks
    monkeypatch.setattr(tool_calls, "peel_blocks", lambda *a: rounds.append(1) or peel(*a))
    n = 400 if widest > 4096 else 5
    turn = lambda k: k + (5000 if k % 2 else 0)
    rows = [(1, str(k), {"turn": turn(k), "k": 0}, "f", "1", [str(k + 1)] if k + 1 < n else []) for k in range(n)]
    calls = spark.createDataFrame(rows, "conv_id bigint, call_id string, position struct<turn:bigint,k:int>, name string, arguments string, depends_on array<string>")
    want = brute_order({k: [k + 1] for k in range(n - 1)}, {k: turn(k) for k in range(n)})
    got = {int(r.call_id): ((r.after.turn, r.hop), r.cyclic) for r in tool_calls.ordered(calls).collect()}
    assert got == want and len(rounds) == (2 if widest > 4096 else n)


def test_arguments_that_are_no_json(spark):
    bad = ["NaN", "[1e400]", "[" * 100000, "{", '{"x": Infinity}', None]
    odd = ['"\\ud800"', "true", "[1, {}]"]
    schemas = {"f": {"enum": [1, "\ud800", [1, {}]]}}
    rows = [(1, str(k), {"turn": k, "k": 0}, "f", a, []) for k, a in enumerate(bad + odd)]
    calls = spark.createDataFrame(rows, "conv_id bigint, call_id string, position struct<turn:bigint,k:int>, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id bigint, call_id string, position struct<turn:bigint,k:int>, content string")
    got = {int(r.call_id): r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    assert [got[k].problems for k in range(5)] == ["$: not JSON"] * 5 and [got[k].valid for k in range(5, 9)] == [False, True, False, True]
    assert all(json.loads(got[k].line)["arguments"] == bad[k] for k in range(6)) and json.loads(got[6].line)["arguments"] == "\ud800"


def test_linking(spark):
    call = lambda i, a, deps=(), name="f": {"id": i, "name": name, "arguments": a, "depends_on": list(deps)}
    messages = [
        (1, 0, "user", "hello"), (1, 1, "assistant", json.dumps({"tool_calls": [call("a", {"x": 1}, ["b"]), call("b", {"x": 2}, ["zzz"])]})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "é"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "q", "content": None})), (1, 4, "assistant", json.dumps({"tool_calls": [call("c", {"x": 0}, ["a"], "g")]})), (2, 0, "assistant", "{broken"), (2, 1, "assistant", None),
        (3, 0, "assistant", json.dumps({"tool_calls": [call("p", {"x": 1}, ["q"]), call("q", {"x": 1}, ["p"])]})),
    ]
    df = spark.createDataFrame([(*m, 0) for m in messages], "conv_id bigint, turn bigint, role string, text string, status int")
    rows = tool_calls.link_tool_calls(*tool_calls.extract_calls(df), SCHEMAS).collect()
    by = {(r.conv_id, r.call_id): r for r in rows}
    assert {k: (r.status, r.valid, r.cyclic) for k, r in by.items()} == {
        (1, "a"): ("linked", True, False), (1, "b"): ("pending", True, False), (1, "c"): ("pending", False, False), (1, "q"): ("orphan", False, False), (3, "p"): ("pending", True, True), (3, "q"): ("pending", True, True),
    }
    order = [r.call_id for r in sorted((r for r in rows if r.conv_id == 1 and r.status != "orphan"), key=lambda r: (r.after_turn, r.after_k, r.hop))]
    assert order == ["b", "a", "c"]
    assert by[1, "a"].line == '{"arguments":{"x":1},"conversation":1,"id":"a","name":"f","result":"é","status":"linked","valid":true}'
    assert by[1, "c"].problems == "no schema" and tool_calls.link_tool_calls(*tool_calls.extract_calls(df.limit(0)), SCHEMAS).count() == 0


def test_turns_with_repeats_and_nulls(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, 0, "user", None), (2, None, "user", "x"), (3, 5, "assistant", "late")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted((r.conv_id, r.status, r.valid, json.loads(r.line)["result"] or "") for r in tool_calls.link_tool_calls(*tool_calls.calls_of_turns(df), tool_calls.REPLY_SCHEMAS).collect())
    assert got == [(1, "linked", True, "a"), (1, "linked", True, "a"), (2, "pending", False, ""), (3, "orphan", False, "late")]


def test_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        want = c.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        assert sorted(map(repr, (tuple(r) for r in df.select(names).collect()))) == sorted(map(repr, want.fetchall()))


def test_names():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} and "pipeline" in __spark_entry__.queries()


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, sf).filter("predicted = 1").collect()}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    from tests.llm.test_documents import brute_components, brute_contamination, brute_fingerprint

    ids = sorted(text)
    roots = brute_components([brute_fingerprint(text[i]) for i in ids])
    text = {i: text[i] for k, i in enumerate(ids) if roots[k] == k}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, v in brute_contamination(text.items(), items).items() if v[4]}
    model = pii.trained_tagger()
    text = {i: pii.redacted(t, pii.all_spans([t], model)[0][1]) for i, t in text.items() if i not in bad}
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: len(library.encode(t)) for i, t in text.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "sentencepiece"]


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), sf).schema == docs.schema


def test_stages_with_odd_rows(spark, sf, tmp_path):
    """Null ids and texts, repeated rows, a very long text, clashing columns, and empty tables through every stage."""
    long = "lorem ipsum dolor " * 60000
    clashes = ("__key", "__text", "id", "fp", "n", "score", "__rows", "__rows_", "keep", "spans", "uid", "hash", "component_id", "fingerprint", "n_tokens", "ids_sha256", "y", "toxic")
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "unique words here", "en", "s", 17), (4, long, "en", "s", len(long)), (5, "mail joe@site.com", "en", None, 17)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in clashes)
    docs = spark.createDataFrame([(*r, *("x" if r[0] != 2 else None for _ in clashes)) for r in rows], columns)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert {r[c] for r in docs.filter("doc_id <> 2").collect() for c in clashes} == {"x"}
    got = docs.collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 4, 5]
    empty = spark.createDataFrame([], columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_leaves_its_last_folder_alone(spark, sf, monkeypatch):
    """Earlier stages' folders are gone when the run is over, and its rows are still there."""
    made = []
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda s: made.append(shared_dir(s)) or made[-1])
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, d, f: d.limit(5)), ("two", lambda s, d, f: d), ("three", lambda s, d, f: d.select("doc_id"))])
    out = corpus_pipeline.run(spark, sf)
    left = [os.path.exists(f"{path}-{name}") for path, name in zip(made, ("one", "two", "three"), strict=True)]
    assert left == [False, False, True] and out.count() == 5
