"""Operators 5, 7 and 8 against the tokenizer libraries."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paperloom.llm import bpe, queries
from paperloom.llm.common import Memo
from paperloom.llm.sentencepiece_bpe import PieceModel, piece_digests
from paperloom.llm.sstable import Reader, WordEncoder, filesystem, id_of, key_of, read_shards, token_shards, write_shards
from paperloom.llm.token_counts import ByteLevelCounter, token_counts

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n a\n b ", "don't we'll I'VE", "x" * 3000, "ab" * 700, "日本語テキスト 123 ４５", "😀😀 é é", "\x1c\x1d a\x85b\xa0c", "▁ a▁▁b", "<|endoftext|>",
    "a<|endoftext|> b<|endoftext|>", "</s><s><unk> <0x41>", "\0a\0", "﻿hi​", "aaa   bbb\t\tccc\n\n\n", "1234567 12.5e-7", "٣٤", "Ἑλληνικά Σ ΑΣ", "İstanbul ǅ ﬁ", "the cat " * 20000,
]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    return ODD + ["".join(rnd.choice("ab c\n'd▁é日1  <|>tΣ²ª.") for _ in range(rnd.randrange(1, 60))) for _ in range(1500)]


def data(path):
    with open(P.path(path), "rb") as f:
        return f.read()


def test_byte_level_counts(texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert ByteLevelCounter(data("byte_bpe_50k.json")).counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_whole_tokens_are_proved():
    c = ByteLevelCounter(data("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = sorted(w for w in c.whole if w.isalpha())[::500]
    assert len(c.whole) > 40000 and all(len(library.encode(w.decode(), add_special_tokens=False).ids) == 1 for w in some)


def test_sentencepiece_round_trip(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    model = PieceModel(data("piece_bpe_32k.model"))
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids
        assert model.decode(ids) == library.decode(ids)
    out = model.digests(texts)
    assert out["n_tokens"] == [len(library.encode(t)) for t in texts]
    assert out["ids_sha256"] == [hashlib.sha256(",".join(map(str, library.encode(t))).encode()).hexdigest() for t in texts]
    assert out["decoded_sha256"] == [hashlib.sha256(library.decode(library.encode(t)).encode()).hexdigest() for t in texts]


def sequential(symbols, ranks):
    """Merge the leftmost pair of the least rank until none is left."""
    s = list(symbols)
    while True:
        found = [(ranks[p][0], k) for k, p in enumerate(zip(s, s[1:], strict=False)) if p in ranks]
        if not found:
            return s
        _, k = min(found)
        s[k : k + 2] = [ranks[s[k], s[k + 1]][1]]


def test_merges_equal_one_at_a_time():
    rnd = random.Random(9)
    for _ in range(40):
        size = rnd.randrange(5, 14)
        pairs = rnd.sample([(a, b) for a in range(size) for b in range(size)], rnd.randrange(3, 20))
        ranks = {p: (r, rnd.randrange(size)) for r, p in enumerate(pairs)}
        product_rank = {}
        ok = {}
        for p, (r, out) in ranks.items():  # one product per symbol beyond the letters, as in vocabularies
            ok[p] = (r, product_rank.setdefault(p, size + len(product_rank)))
        table = bpe.PairTable([a for a, _ in ok], [b for _, b in ok], [v[0] for v in ok.values()], [v[1] for v in ok.values()], size + len(product_rank))
        words = [[rnd.randrange(size) for _ in range(rnd.randrange(0, 30))] for _ in range(30)]
        flat, lengths = bpe.merge_words(np.array([s for w in words for s in w], np.int64), [len(w) for w in words], table)
        ends = np.cumsum(lengths)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [sequential(w, ok) for w in words]


def test_heap_and_cuts_equal_one_at_a_time(monkeypatch):
    monkeypatch.setattr(bpe, "CUT", 4)
    monkeypatch.setattr(bpe, "HEAP", 9)
    test_merges_equal_one_at_a_time()


LONG = {
    "the": "the" * 20000, "a": "a" * 60000, "base64": base64.b64encode(random.Random(1).randbytes(45000)).decode(), "chinese": "".join(chr(0x4E00 + random.Random(k).randrange(3000)) for k in range(20000)), "signs": "=" * 9000,
    "letters": "".join(random.Random(k).choice("etaoinshrdlu") for k in range(60000)), "syllables": "".join(random.Random(k).choice(["the", "ing", "tion", "er", "an"]) for k in range(20000)),
}


@pytest.mark.parametrize("name", LONG)
def test_long_words(name):
    text = LONG[name]
    began = time.perf_counter()
    ids, n = PieceModel(data("piece_bpe_32k.model")).encode(text), ByteLevelCounter(data("byte_bpe_50k.json")).counts([text])
    assert time.perf_counter() - began < 30
    assert ids == sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(text)
    assert n == [len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)]


def test_memo_is_bounded_on_real_white_space():
    """Paragraphs, lists and trailing newlines share the words' entries; long strings are not kept."""
    rnd = random.Random(2)
    texts = ["\n\n".join(" ".join(rnd.choice(["alpha", "beta", "gamma", "1.", "-"]) for _ in range(30)) for _ in range(5)) + rnd.choice(["\n", "", "  ", "\t\n"]) for _ in range(500)] + ["x" * 300 + str(k) for k in range(50)]
    c, m = ByteLevelCounter(data("byte_bpe_50k.json")), PieceModel(data("piece_bpe_32k.model"))
    library, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert c.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert m.digests(texts)["n_tokens"] == [len(pieces.encode(t)) for t in texts]
    c.counts([]), m.digests([])
    assert len(c.chunks.table) < 60 and len(m.words.table) < 60 and c.chunks.held == sum(map(len, c.chunks.table))
    memo = Memo(lambda missing: [len(s) for s in missing], entries=10, chars=50)
    for k in range(40):
        assert memo.of([str(k), "y" * k])["y" * k] == k and len(memo.table) <= 12 and memo.held <= 100


def test_queries_on_driver_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    text = {r.doc_id: r.text or "" for r in rows}
    library, pieces, lower = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5_token_counts(spark, sf).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in text.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_sentencepiece(spark, sf).collect()}
    assert got == {i: (len(ids := pieces.encode(t)), sha(",".join(map(str, ids)).encode()), sha(pieces.decode(ids).encode())) for i, t in text.items()}
    start, want = 0, {}
    for i in sorted(text):
        ids = [*lower.encode(text[i], add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_shards(spark, sf).collect()} == want


def test_count_queries(spark):
    rows = [(1, "hello world"), (1, "hello world"), (None, "x"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(docs, P.path("byte_bpe_50k.json"), limit=1).collect()), key=str)
    assert got == sorted([(1, 11, 2, True), (1, 11, 2, True), (None, 1, 1, False), (2, 0, 0, False), (3, 0, 0, False)], key=str)
    assert token_counts(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_digests(docs, P.path("piece_bpe_32k.model")).collect()}
    assert got[2] == got[3] == (0, empty, empty)


def test_word_encoder(texts):
    encoder = WordEncoder(data("word_bpe_49k.json"), 2)
    assert encoder.by_word
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == [*encoder.library.encode(t, add_special_tokens=False).ids, 2]


def test_shards(spark, tmp_path, texts):
    vocabulary = P.path("word_bpe_49k.json")
    rows = [(k * 7 % 4001 - 50, t, "clash") for k, t in enumerate(texts)] + [(None, "null id", "c"), (5, None, "c"), (5, "again", "c"), (5, "again", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(5)
    folder = f"file://{tmp_path}/shards"
    shards = write_shards(docs, vocabulary, folder)
    got = read_shards(shards, folder).collect()
    library = Tokenizer.from_file(vocabulary)
    want = sorted((-(10**9) if i is None else i, len(ids := [*library.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((-(10**9) if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order)])[:-1].tolist()
    assert [r.doc_id for r in in_order if r.doc_id is not None] == sorted(i for i, _, _ in rows if i is not None)
    fs, _ = filesystem(folder)
    for s in shards.collect():
        with fs.open_input_file(s.path) as f:
            reader = Reader(f)
            keys = [k for k, _ in reader.scan()]
            assert keys == sorted(keys)
            for k in keys[:: max(1, len(keys) // 20)]:
                assert len(reader.get(id_of(k))) == keys.count(k)
            assert sum(reader.may_hold(key_of(10**7 + k)) for k in range(500)) < 40 and not reader.get(10**7)
    assert token_shards(docs.limit(0), vocabulary).count() == 0


def test_keys_sort_as_identifiers():
    ids = [None, -(2**63), -5, -1, 0, 1, 7, 2**62]
    assert [id_of(key_of(i)) for i in ids] == ids and [key_of(i) for i in ids] == sorted(key_of(i) for i in ids)
    assert id_of(key_of("é")) == "é"
