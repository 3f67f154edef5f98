"""Operators 11 to 13 against brute force and SQL, with odd rows."""

import os
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import collocations, jaccard_join, queries, whitening

TABLES = ("documents", "embeddings")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", ["op11_jaccard_join", "op13_collocations"])
def test_queries_match_sql(spark, sf, name):
    sf = f"{os.path.dirname(sf)}/sf0.01"
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(int(v) if isinstance(v, Decimal) else v for v in r) for r in result.fetchall())
    assert want and sorted(map(tuple, got.select(names).collect())) == want


def brute_components(rows, size=5, similar=80):
    """{(id, n, component)} of rows (id, text), as sorted list."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= similar * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return sorted(out, key=repr)


def clustered(rnd, groups, members, words=60):
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append(" ".join(own[rnd.randrange(3) :]))
    return rows


@pytest.mark.parametrize(("paired", "thinned", "common"), [(64, 3, 4096), (2, 2, 4), (3, 0, 4096)])
def test_jaccard_components(spark, monkeypatch, paired, thinned, common):
    """Near copies on both sides of the bound, odd rows, and a shared passage, with large groups thinned or not and shingles counted either way."""
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rnd = random.Random(paired)
    texts = clustered(rnd, 6, 8) + clustered(rnd, 2, 20, 25)
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"x{rnd.random()}" for _ in range(rnd.randrange(12))) for _ in range(15)]
    texts += ["one two", "One  TWO", "two one", "a b c d e", "a b c d e f", "", "   ", "Été été", "été été", "a b c d e " * 50]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, "another text of the same id it is"), (None, texts[4]), (None, None), (500, None)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id bigint, text string, n int, node string, root string").repartition(5)
    got = jaccard_join.jaccard_components(docs, paired=paired, thinned=thinned)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_far_members(spark, monkeypatch):
    """Near copies of which many link with no hub are met by their differences, not each with all others."""
    rnd, met = random.Random(5), []
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(260):
        own = list(base)
        for j in range(rnd.choice((1, 2, 3, 4, 5, 7))):
            at = rnd.randrange(len(own) - 1)
            own[at : at + rnd.choice((1, 1, 2))] = [f"x{rnd.randrange(40) if j % 2 else rnd.random()}"] * rnd.choice((0, 1, 1, 2))
        rows.append((k, " ".join(own[rnd.randrange(3) :])))
    verified = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *rest: met.append(pairs.count()) or verified(pairs, *rest))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_components(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len({c for _, _, c in want}) > 20 and sum(met) < 5000


def test_jaccard_differences_share(spark):
    """Of two linked sets of which at most one links with the home, the parts of their differences that are shown share a shingle."""
    rng, seen = np.random.default_rng(6), 0
    counts = rng.integers(0, 50, 1 << jaccard_join.BUCKET_BITS)
    for _ in range(4000):
        pool = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2))
        n, few = int(rng.integers(5, 90)), int(rng.integers(0, 24))
        home = pool[:n]
        a = np.setxor1d(home, rng.choice(pool[: n + 20], few, replace=False))
        b = np.setxor1d(a, rng.choice(pool[: n + 20], int(rng.integers(1, 12)), replace=False))
        if not len(a) or not len(b) or not jaccard_join.linked(a, b, 80):
            continue
        both = [jaccard_join.shown(np.setdiff1d(x, home), np.setdiff1d(home, x), len(x), n, counts, 50, 80) for x in (a, b)]
        (la, da, fa, na, pa), (lb, db, fb, nb, pb) = both
        assert (la, lb) == (jaccard_join.linked(home, a, 80), jaccard_join.linked(home, b, 80))
        if not la or not lb:
            assert len(np.intersect1d(pa[: na if lb else fa], pb[: nb if la else fb]))
            seen += 1
    assert seen > 100


def test_jaccard_prefixes_and_names(spark):
    """Linked sets share as many prefix shingles as the smaller m asks for, whatever each chose; ids may be strings."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 5000, 1 << jaccard_join.BUCKET_BITS)
    chosen = set()
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[: max(1, len(a) - int(rng.integers(0, n // 9 + 1)))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            (pa, _, ma), (pb, _, mb) = (jaccard_join.prefix(s, counts, noise) for s, noise in ((a, 0.0), (b, float(rng.integers(0, 5000)))))
            m = min(ma, mb)
            assert len(np.intersect1d(pa[: len(a) // 5 + m], pb[: len(b) // 5 + m])) >= m
            chosen.update((ma, mb))
    assert len(chosen) > 1
    docs = spark.createDataFrame([("b", "x y z"), ("a", "X y  z"), (None, "q")], "name string, body string")
    got = jaccard_join.jaccard_components(docs, id_col="name", text_col="body")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 1, "a"), ("b", 1, "a"), (None, 1, None)], key=repr)
    with pytest.raises(ValueError, match="another name"):
        jaccard_join.jaccard_components(docs, id_col="component_id")


def brute_whitening(vectors, components=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    y = np.array((n * x - s) / n, float)
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return deviation.tolist(), y @ axes / np.sqrt(values), values / (deviation.sum() / n**3)


def compare_whitening(rows, vectors, ids):
    deviation, whitened, shares = brute_whitening(vectors)
    by = defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    k = whitened.shape[1]
    assert len(rows) == len(vectors) * k and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    got = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i in ids])
    assert [by[i][1].deviation for i in ids] == deviation and {r.n for r in rows} == {len(vectors)}
    assert np.allclose([by[ids[0]][c].explained for c in range(1, k + 1)], shares, rtol=1e-10)
    signs = np.sign((got * whitened).sum(0))
    assert np.abs(got * signs - whitened).max() < 1e-7


def test_whitening_query(spark, sf):
    own = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    own = [(i, v) for i, v in own if v and all(c is not None and np.isfinite(c) for c in v)]
    compare_whitening(queries.op12_whitening(spark, sf).collect(), [v for _, v in own], [i for i, _ in own])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(60, 5)) * [9, 5, 3, 2, 1]]
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [1e300] * 5]
    rows = [(k, v, "c", 1.0) for k, v in enumerate([*vectors, vectors[0], *odd])]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, x string, whitened double").repartition(4)
    got = whitening.whiten(frame)
    assert got.columns == ["vec_id", *whitening.RESULT]
    compare_whitening(got.collect(), [*vectors, vectors[0]], list(range(61)))
    assert whitening.whiten(frame.limit(0)).collect() == [] and whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id int, embedding array<double>")).count() == 0
    flat = spark.createDataFrame([(None, [float(k), 2.0 * k, 7.0]) for k in range(9)], "vec_id int, embedding array<double>")
    assert {(r.component, round(r.explained, 9)) for r in whitening.whiten(flat).collect()} == {(1, 1.0)}
    large = spark.createDataFrame([(k, [2.0**36 * k, -(2.0**36) * k]) for k in range(9)], "vec_id int, embedding array<double>")
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(large).collect()} == {(k, 0 if k == 4 else None) for k in range(9)}
    with pytest.raises(ValueError, match="another name"):
        whitening.whiten(frame.withColumnRenamed("vec_id", "n"), id_col="n")


@pytest.mark.parametrize("values", [np.ones(64), np.r_[np.full(20, 5.0), np.arange(180) / 100], [3, 2, 2, 0, 0], 0.9 ** np.arange(300), np.r_[np.ones(100), np.full(40, 7.0)]])
def test_lanczos(values):
    """Equal eigenvalues in numbers over the block's width, rank below the block, and a basis that never gets full."""
    rng = np.random.default_rng(2)
    values = np.array(values, float)
    turn = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    matrix = turn * values @ turn.T
    got, axes = whitening.block_lanczos(lambda v: matrix @ v, len(values), 32)
    want = np.sort(values)[::-1][:32]
    assert np.abs(got - want).max() < 1e-12 * want[0] and np.abs(axes.T @ axes - np.eye(len(want))).max() < 1e-12
    assert np.abs(matrix @ axes - axes * got).max() < 1e-11 * want[0]


def brute_collocations(rows, least, top):
    f = defaultdict(Counter)
    for lang, t in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(t)):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        often = {p: c for p, c in counts.items() if c >= least}
        best = []
        for p, a in often.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if len(p) > 1 and not any(len(q) > len(p) and 100 * c >= 80 * a and inside(q) for q, c in often.items()):
                score, _, left, right = min((2_000_000 * a // (counts[p[:j]] + counts[p[j:]]), j, counts[p[:j]], counts[p[j:]]) for j in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("sent", "held"), [(1 << 20, 1_000_000), (3, 1_000_000), (1 << 20, 12)])
def test_collocations(spark, monkeypatch, sent, held):
    """Keys sent as they are, and as a table of bits; counts sent in many parts; a null language is und; ties go by bytes."""
    monkeypatch.setattr(collocations, "PHRASES_HELD", held)
    monkeypatch.setattr(collocations, "SLICE", min(held, 500_000))
    monkeypatch.setattr(collocations, "WORDS_HELD", min(held, 300_000))
    rnd = random.Random(6)
    words = ["New", "york", "CITY", "the", "of", "a", "été", "zwölf", "x'y", "-", " ", "b\x1cc", "\x00"]
    texts = []
    for k in range(300):
        run = [rnd.choice(words[: 4 + k % 9]) for _ in range(rnd.randrange(0, 30))]
        texts.append("".join(w + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]) for w in run))
    rows = [(rnd.choice(["en", "en", "de", None, "und"]), t) for t in texts] + [("en", None), ("fr", None), ("fr", ""), ("la", "ave " * 400), ("en", texts[0])]
    docs = spark.createDataFrame([(k, lang, t, 1, "c") for k, (lang, t) in enumerate(rows)], "doc_id int, lang string, text string, f int, w0 string").repartition(4)
    for least, top in ((30, 2000), (4, 7)):
        got = collocations.collocations(docs, least, top, sent=sent)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocation_scores_are_exact(spark):
    """Counts whose products pass 64 bits."""
    a, left, right = 4 * 10**13 + 7, 5 * 10**13 + 1, 9 * 10**13 + 3
    tables = [spark.createDataFrame([(1, left, "en", "p"), (2, right, "en", "q")], "w0 bigint, f bigint, lang string, word string"), spark.createDataFrame([(1, 2, a)], "w0 bigint, w1 bigint, f bigint")]
    row = collocations.scored(tables).first()
    assert (row.a, row.l, row.r, row.score) == (a, left, right, 2_000_000 * a // (left + right))


def test_collocations_rank_few_rows(spark):
    """All that can be among a language's first by score and count reaches the ranking, and little else of a large language does."""
    rnd = random.Random(9)
    scores = {"en": lambda: rnd.choice([0, 1, rnd.randrange(1000), rnd.randrange(1_000_001)]), "de": lambda: 1_000_000, "fr": lambda: 7, "la": lambda: rnd.randrange(50)}
    rows = [(lang, scores[lang](), rnd.choice([30, 31, rnd.randrange(30, 10**9)]), k) for k in range(20_000) for lang in scores if lang != "fr" or k < 15]
    got = [tuple(r) for r in collocations.leading(spark.createDataFrame(rows, "lang string, score bigint, a bigint, id int").repartition(3), 20).collect()]
    assert len(got) == len(set(got))
    for lang in scores:
        best = sorted((r[1:3] for r in rows if r[0] == lang), reverse=True)
        kept = [r for r in got if r[0] == lang]
        assert {r for r in rows if r[0] == lang and r[1:3] >= best[:20][-1]} <= set(kept)
        assert len(kept) < (1000 if lang == "la" else 250), lang


def test_word_counts_flush(spark, monkeypatch):
    monkeypatch.setattr(collocations, "WORDS_HELD", 3)
    source = spark.createDataFrame([("en", "a b c d a"), ("en", "a. e f g b")], "lang string, text string")
    assert {(r.word, r.f) for r in collocations.word_counts(source).collect()} == {("a", 3), ("b", 2), ("c", 1), ("d", 1), ("e", 1), ("f", 1), ("g", 1)}
    assert source.select(F.col("text")).count() == 2
