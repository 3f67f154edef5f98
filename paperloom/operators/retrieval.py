"""Vector and keyword search, union, reranking, parent resolution and result formatting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X

try:
    import ahocorasick
except ModuleNotFoundError:  # keywords are then looked for one by one
    ahocorasick = None

# Fixed values.
CANDIDATES, RESULTS, KEYWORD_LIMIT = 25, 8, 10
DETAILED_CANDIDATES, DETAILED_RESULTS = 35, 10
#: Questions that a cell of a search holds, and chunks of one identity from which on it is cut.
QUERY_BLOCK, HOT = 4096, 16_384
#: Where all pairs are scored: chunks of one identity from which on it is cut, and pairs that a task passes on at once.
SCORED, PAIRS = 4096, 32_768


def cosine(a: Column, b: Column) -> Column:
    """SC26: cosine similarity of two vectors, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rounded(c: Column, places: int = 6) -> Column:
    """A similarity as a decimal, so ties and hashes do not hang on the last bits."""
    return F.round(c, places).cast(f"decimal(12,{places})")


def top(df: DataFrame, per: str, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered; a window that Spark limits before its shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col(name) <= k)


IDENTITY = ("company_document_id", "revision_number")


def _cells(asking: DataFrame, store: DataFrame, keys: tuple[str, ...], hot: int | None = None, tasks: int | None = None) -> DataFrame:
    """Both sides of a search, exchanged into cells that a task can work through one after the other.

    A cell is an identity (`keys`), a salt and a block: identities with many
    chunks are cut into salts, and those with many questions into blocks; the
    questions of an identity go to all its salts, its chunks to all its blocks.
    Only identities with over a ten-thousandth of all rows (and `hot`, else HOT,
    or QUERY_BLOCK) are cut, so their table, which is broadcast, has under 10,000
    rows. Cells are dealt to `tasks` tasks, or as Spark chooses by bytes. `asking`
    has `qid` and `store` has `chunk_id`; rows without them or without a whole
    identity take no part, and chunks that nobody asks about stay where they
    are. Each cell's questions come first (`side` 0), then its chunks, shortest
    first where they have a length `n`. Nothing runs until the result is read.
    """
    asking, store = asking.filter(F.col("qid").isNotNull()), store.filter(F.col("chunk_id").isNotNull())

    def cut(rows: DataFrame, least: int, name: str) -> DataFrame:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("of"))
        share = F.greatest(F.lit(least), F.expr("cast(total div 10000 as bigint)"))
        total = counts.agg(F.sum("of").alias("total"))
        return F.broadcast(counts.join(F.broadcast(total)).filter(F.col("of") > share).select(*keys, F.ceil(F.col("of") / share).cast("int").alias(name)))

    salts, blocks = cut(store.select(*keys), hot or HOT, "salts"), cut(asking.select(*keys), QUERY_BLOCK, "blocks")
    many = asking.join(salts, list(keys), "left").join(blocks, list(keys), "left")
    spread = many.withColumn("block", F.pmod(F.xxhash64("qid"), F.coalesce("blocks", F.lit(1))).cast("int")).withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")))
    asked = spread.drop("salts", "blocks").withColumn("side", F.lit(0))
    wanted = asked.select(*keys, "salt", "block").distinct()
    salted = store.join(salts, list(keys), "left").withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    chunks = salted.join(wanted, [*keys, "salt"]).withColumn("side", F.lit(1))
    cell = [*keys, "salt", "block"]
    both = asked.unionByName(chunks, allowMissingColumns=True)
    order = [*cell, "side", *(["n", "chunk_id"] if "n" in both.columns else [])]
    return both.repartition(*([tasks] if tasks else []), *cell).sortWithinPartitions(*order)


def _by_cell(batches: Iterator[pa.RecordBatch], cell: list[str], *more: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of one cell and one side, and one value of `more`, each with whether it begins a new cell."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*(batch.column(c).to_pylist() for c in [*cell, "side", *more]), strict=True))
        starts = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1])]
        for at, to in zip(starts, [*starts[1:], len(marks)], strict=True):
            now = marks[at][: len(cell)]
            yield now != last, batch.slice(at, to - at)
            last = now


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1))


def _nearest(queries: DataFrame, store: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """For queries (qid, keys, vector) the k nearest chunks among those with the same keys.

    Questions and chunks meet in cells (see `_cells`), of which each multiplies
    its chunks with its questions and passes on the k best of each question, so
    no pair is shuffled, the store is exchanged once for any number of
    questions, and the driver sees none. Vectors that are null, empty or hold a
    null have no neighbours and are none; vectors of different lengths are not
    compared, so the length is part of the cell. Null qids and chunk ids are
    passed over.
    """
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull())
    asking = queries.select("qid", *keys, F.col("vector").cast("array<double>").alias("vector")).filter(usable).withColumn("length", F.size("vector"))
    chunks = store.select("chunk_id", *keys, F.col("embedding").cast("array<double>").alias("vector")).filter(usable).withColumn("length", F.size("vector"))
    cell = [*keys, "length"]
    met = _cells(asking, chunks, tuple(cell)).select(*cell, "salt", "block", "side", F.col("qid").cast("bigint").alias("qid"), "chunk_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, parts, matrix, least = [], [], None, None
        for new, rows in _by_cell(batches, [*cell, "salt", "block"]):
            if new:
                qids, parts, matrix = [], [], None
            if not rows.column("side")[0].as_py():
                qids.append(rows.column("qid").to_numpy())
                parts.append(_matrix(rows.column("vector")))
                continue
            if not parts:
                continue
            if matrix is None:
                matrix, asked, least = np.concatenate(parts), np.concatenate(qids), np.full(sum(map(len, qids)), -2.0)
            ids = np.array(rows.column("chunk_id").to_pylist(), object)
            by_id = np.argsort(ids, kind="stable")
            sims = np.round(matrix @ _matrix(rows.column("vector"))[by_id].T, 6)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            scores = np.take_along_axis(sims, best, 1)
            keep = scores >= least[:, None]  # a cell's earlier chunks may already have k better ones
            if best.shape[1] == k:
                least = np.maximum(least, scores[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, best.shape[1])[keep.ravel()]), pa.array(ids[by_id[best[keep]]].tolist(), pa.string()), pa.array(scores[keep])], names=["qid", "chunk_id", "score"])

    found = met.mapInArrow(run, "qid bigint, chunk_id string, score double")
    return top(found.withColumn("score", F.col("score").cast("decimal(12,6)")), "qid", k, F.desc("score"), F.col("chunk_id"))


def vector_search(queries: DataFrame, store: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """TK01: for queries (qid, company_document_id, revision_number, vector) the k nearest chunks of their document's revision."""
    return _nearest(queries, store, k, IDENTITY)


def global_search(queries: DataFrame, store: DataFrame, k: int = 5) -> DataFrame:
    """TK02: for queries (qid, vector) the k nearest chunks of the whole store."""
    return _nearest(queries, store, max(1, min(k, 20)), ())


def _dimensions(vectors: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of n entries, one row a dimension, and their squared lengths, added up one dimension after the other."""
    rows = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n).T)
    squares = np.zeros(rows.shape[1])
    for x in rows:
        squares += x * x
    return rows, squares


def _scores(a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine similarities of all vectors of `a` with all of `b` (see `_dimensions`) in millionths, and which of them exist.

    Products are added up one dimension after the other and halves are rounded
    away from zero, as SQL does, so no last digit hangs on the size of a block.
    """
    dot, term = np.zeros((len(aa), len(bb))), np.empty((len(aa), len(bb)))
    for x, y in zip(a, b, strict=True):
        dot += np.multiply(x[:, None], y, out=term)
    with np.errstate(all="ignore"):
        score = np.clip(dot / np.sqrt(np.multiply.outer(aa, bb)), -1, 1) * 1e6
    exists = ~np.isnan(score)
    score[~exists] = 0
    whole = np.trunc(score)
    return (whole + np.copysign(np.abs(score - whole) >= 0.5, score)).astype(np.int64), exists


def similarity_scores(queries: DataFrame, store: DataFrame) -> DataFrame:
    """JN01: the similarity of queries (qid, company_document_id, revision_number, vector) with every chunk of their document's revision.

    All pairs are the result, so it grows with the square of an identity.
    Questions and chunks meet in cells (see `_cells`) of at most about SCORED
    chunks, so the work of any identity is dealt to many tasks, and a task keeps
    a cell's questions and passes its pairs on PAIRS at a time. As work is in
    pairs, not bytes, Spark does not put small cells together. A vector that is
    null, empty, all zero, of another length or with a null has no similarity:
    the pair stays, its score is null. Null ids are passed over.
    """

    def side(rows: DataFrame, name: str, vector: str) -> DataFrame:
        rows = rows.select(F.col(name), *IDENTITY, F.col(vector).alias("vector"))
        return rows.withColumn("n", F.when(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()), F.size("vector")).otherwise(0))

    tasks = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = [*IDENTITY, "salt", "block"]
    met = _cells(side(queries, "qid", "vector"), side(store, "chunk_id", "embedding"), IDENTITY, SCORED, tasks)
    met = met.select(*cell, "side", "n", F.col("qid").cast("bigint").alias("qid"), "chunk_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for new, rows in _by_cell(batches, cell, "n"):
            if new:
                asked = []
            n, m = rows.column("n")[0].as_py(), rows.num_rows
            vectors, squares = _dimensions(rows.column("vector"), n) if n else (None, None)
            if not rows.column("side")[0].as_py():
                asked.append((n, rows.column("qid").to_numpy(), vectors, squares))
                continue
            step = max(1, PAIRS // m)
            ids = pa.concat_arrays([rows.column("chunk_id")] * min(step, max((len(qids) for _, qids, _, _ in asked), default=1)))
            for length, qids, a, aa in asked:
                for at in range(0, len(qids), step):
                    to = slice(at, at + step)
                    of = len(qids[to]) * m
                    units, exists = _scores(a[:, to], aa[to], vectors, squares) if n and n == length else (np.zeros(of, np.int64), np.zeros(of, bool))
                    known = None if exists.all() else pa.py_buffer(np.packbits(exists.ravel(), bitorder="little"))
                    wide = np.stack([units.ravel(), units.ravel() >> 63], axis=1)  # decimals are numbers of 128 bits
                    score = pa.Array.from_buffers(pa.decimal128(12, 6), of, [known, pa.py_buffer(wide)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[to], m)), ids.slice(0, of), score], names=["qid", "chunk_id", "score"])

    return met.mapInArrow(run, "qid bigint, chunk_id string, score decimal(12,6)")


class Keywords:
    """The keywords of a cell's questions, and which questions have each."""

    def __init__(self):
        self.qids: list[int] = []
        self.postings: dict[str, list[int]] = {}
        self.machine = self.asking = None

    def add(self, qid: int, keywords: list[str]) -> None:
        for w in keywords:
            self.postings.setdefault(w, []).append(len(self.qids))
        self.qids.append(qid)

    def asked_by(self, body: str) -> np.ndarray:
        """The places of the questions of which the text contains a keyword; one pass over the text if the automaton library is there."""
        if self.asking is None:
            self.asking = [np.array(n, np.int64) for n in self.postings.values()]
            if ahocorasick is not None:
                self.machine = ahocorasick.Automaton()
                for k, w in enumerate(self.postings):
                    self.machine.add_word(w, k)
                self.machine.make_automaton()
        hits = {k for _, k in self.machine.iter(body)} if self.machine is not None else [k for k, w in enumerate(self.postings) if w in body]
        return np.unique(np.concatenate([self.asking[k] for k in hits])) if hits else np.zeros(0, np.int64)


def _asked(questions: DataFrame) -> DataFrame:
    """FL03: the questions with identity and keywords."""
    keyed = questions.withColumn("keywords", X.extract_keywords(F.col("question")))
    return keyed.filter(F.col("company_document_id").isNotNull() & F.col("revision_number").isNotNull() & (F.size("keywords") > 0)).select("qid", *IDENTITY, "keywords")


def _hits(questions: DataFrame, store: DataFrame, limit: int | None) -> DataFrame:
    """(qid, chunk_id, n, h) of the `limit` shortest chunks in each cell with one of a question's keywords; without a limit (qid, n), their number.

    Questions and chunks meet in cells (see `_cells`), so each chunk is read
    once for all of a block's questions about its document. Chunks without id
    or content are passed over, as are null qids.
    """
    body = store.select(*IDENTITY, "chunk_id", F.lower("content").alias("body"), F.length("content").cast("bigint").alias("n"), F.md5("content").alias("h")).filter("body IS NOT NULL")
    cell = [*IDENTITY, "salt", "block"]
    met = _cells(_asked(questions), body, IDENTITY).select(*cell, "side", F.col("qid").cast("bigint").alias("qid"), "keywords", "chunk_id", "body", "n", "h")
    names = ["qid", "chunk_id", "n", "h"] if limit else ["qid", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, counts, rows = Keywords(), np.zeros(0, np.int64), []

        def close():
            if limit is None:
                rows.extend((q, n) for q, n in zip(asked.qids, counts.tolist(), strict=False) if n)
            out = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)] if rows else []
            rows.clear()
            return out

        for new, part in _by_cell(batches, cell):
            if new:
                yield from close()
                asked, counts = Keywords(), np.zeros(0, np.int64)
            if not part.column("side")[0].as_py():
                for qid, keywords in zip(part.column("qid").to_pylist(), part.column("keywords").to_pylist(), strict=True):
                    asked.add(qid, keywords)
                counts = np.zeros(len(asked.qids), np.int64)
                continue
            for chunk, text, n, h in zip(*(part.column(c).to_pylist() for c in ("chunk_id", "body", "n", "h")), strict=True):
                if limit is not None and (counts >= limit).all():
                    break  # shorter chunks came first
                places = asked.asked_by(text)
                if limit is not None:
                    places = places[counts[places] < limit]
                    rows.extend((asked.qids[q], chunk, n, h) for q in places.tolist())
                counts[places] += 1
        yield from close()

    return met.mapInArrow(run, "qid bigint, chunk_id string, n bigint, h string" if limit else "qid bigint, n bigint")


def keyword_search(questions: DataFrame, store: DataFrame, limit: int = KEYWORD_LIMIT) -> DataFrame:
    """TK03/SO03: chunks of the question's document that contain one of its keywords, shortest first; equal contents once, after the limit.

    Questions are (qid, company_document_id, revision_number, question); those
    without identity or keywords find nothing (FL03).
    """
    best = top(_hits(questions, store, limit), "qid", limit, F.col("n"), F.col("chunk_id"))
    return best.withColumn("again", F.row_number().over(Window.partitionBy("qid", "h").orderBy("rank"))).filter("again = 1").select("qid", "chunk_id", "rank")


def keyword_counts(questions: DataFrame, store: DataFrame) -> DataFrame:
    """JN08: how many chunks of its document contain one of a question's keywords; questions without any do not appear."""
    return _hits(questions, store, None).groupBy("qid").agg(F.sum("n").alias("n_chunks"))


def union_hits(vector: DataFrame, keyword: DataFrame, profile: str = "documented") -> DataFrame:
    """SO01: hits of both kinds once by chunk: at their first place, with their last value; hits without a chunk id are passed over.

    In the "observed" profile keyword hits carry no identity, so the union passes over them (§0.1 Q1).
    """
    if profile == "observed":
        keyword = keyword.limit(0)
    v = vector.select("qid", "chunk_id", F.col("rank").alias("pos"), F.lit("vector").alias("origin"))
    k = keyword.select("qid", "chunk_id", (F.col("rank") + 1000).alias("pos"), F.lit("keyword").alias("origin"))
    return v.unionByName(k).filter(F.col("chunk_id").isNotNull()).groupBy("qid", "chunk_id").agg(F.min("pos").alias("pos"), F.max_by("origin", "pos").alias("origin"))


def candidates(hits: DataFrame, store: DataFrame, questions: DataFrame, scorer=X.keyword_match_score) -> DataFrame:
    """Hits (qid, chunk_id, pos) with their chunks' section, chunk_type, parent_id and score; of rows with one chunk_id the first by row_id counts.

    Only the hits' chunks are taken from the store, and their contents are
    scored where they are read.
    """
    asked = hits.join(questions.select("qid", "question"), "qid")
    found = store.join(asked, "chunk_id").select("qid", "chunk_id", "pos", "row_id", F.struct("section", "chunk_type", "parent_id", rounded(scorer(F.col("question"), F.col("content"))).alias("score")).alias("chunk"))
    return found.groupBy("qid", "chunk_id", "pos").agg(F.min_by("chunk", "row_id").alias("chunk")).select("qid", "chunk_id", "pos", "chunk.*")


def rerank(candidates: DataFrame, k: int = RESULTS, scorer=X.keyword_match_score) -> DataFrame:
    """TK04: the k candidates (qid, chunk_id, pos, and score or question and content) with the best score; `scorer` is any function of two columns."""
    if "score" not in candidates.columns:
        candidates = candidates.withColumn("score", rounded(scorer(F.col("question"), F.col("content"))))
    return top(candidates, "qid", k, F.desc("score"), F.col("pos"), F.col("chunk_id"))


def searchable(questions: DataFrame) -> Column:
    """FL03: whether a question can be searched for by keywords: it has some, and an identity."""
    return (F.size(X.extract_keywords(F.col("question"))) > 0) & F.col("company_document_id").isNotNull()


def restored_hits(used: DataFrame, store: DataFrame) -> DataFrame:
    """JN03: chunks that sessions have used (session_id, row_id), as hits with a full score before all others."""
    return used.distinct().join(store.select("row_id", "chunk_id"), "row_id").select("session_id", "chunk_id", F.lit(1.0).alias("score"), F.lit(-1).alias("rank"))


def restored_first(restored: DataFrame, fresh: DataFrame) -> DataFrame:
    """SO02: restored chunks before new hits (session_id, chunk_id, pos), each chunk once."""
    old = restored.select("session_id", "chunk_id", F.lit(-1).alias("pos"), F.lit("restored").alias("origin")).distinct()
    new = fresh.select("session_id", "chunk_id", F.col("pos").cast("int").alias("pos"), F.lit("new").alias("origin"))
    return old.unionByName(new).groupBy("session_id", "chunk_id").agg(F.min("pos").alias("pos"), F.min_by("origin", "pos").alias("origin"))


def source_list(rows: DataFrame) -> DataFrame:
    """PJ03: the sources of an answer: file, page and revision."""
    number = lambda c: F.expr(f"try_cast({c} AS int)")
    return rows.select("row_id", "chunk_id", F.coalesce(F.concat("company_document_id", F.lit(".pdf")), F.lit("Unknown")).alias("file_name"), F.coalesce(number("page"), F.lit(1)).alias("page"), number("revision_number").alias("revision"))


def squared_norm(v: Column) -> Column:
    """SC25: the squared length of a vector, in double precision."""
    return F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)


def of_latest_rank(rows: DataFrame) -> DataFrame:
    """WN03: the rows of the greatest revision of each document, by rank."""
    w = Window.partitionBy("company_document_id").orderBy(F.expr("try_cast(revision_number AS int)").desc())
    return rows.withColumn("r", F.rank().over(w)).filter("r = 1").drop("r")


def resolve_parents(hits: DataFrame, store: DataFrame, profile: str = "documented") -> DataFrame:
    """JN02/FL13/TK06: child rows are replaced by their table, once each, behind all other hits; parents have score 0.

    In the "observed" profile no row is known as a child, so all stay as they are (§0.1 Q2).
    """
    if profile == "observed":
        return hits.filter(F.col("chunk_id").isNotNull()).select("qid", "chunk_id", "score", F.col("rank").alias("place"))
    child = (F.col("chunk_type") == "child") & F.col("parent_id").isNotNull()
    others = hits.filter(~F.coalesce(child, F.lit(False)) & F.col("chunk_id").isNotNull())
    wanted = hits.filter(child).groupBy("qid", "parent_id").agg(F.min("rank").alias("rank"))
    parents = store.filter("chunk_type = 'parent'").groupBy(F.col("table_id").alias("parent_id")).agg(F.min("chunk_id").alias("chunk_id"))
    found = wanted.join(parents, "parent_id").select("qid", "chunk_id", F.lit(0).cast("decimal(12,6)").alias("score"), (F.col("rank") + 10000).alias("place"))
    return others.select("qid", "chunk_id", "score", F.col("rank").alias("place")).unionByName(found)


def formatted(store: DataFrame) -> DataFrame:
    """PJ01/PJ02: stored chunks as result rows, with defaults and the parsed box."""
    box = F.when(F.ltrim("bbox").startswith("["), F.from_json("bbox", "array<array<double>>")).otherwise(F.array().cast("array<array<double>>"))
    return store.select("chunk_id", "content", "section", "chunk_type", F.coalesce(F.expr("try_cast(page AS int)"), F.lit(1)).alias("page_number"), box.alias("bbox"), F.coalesce(F.concat("company_document_id", F.lit(".pdf")), F.lit("")).alias("source_file"))


def latest_revisions(rows: DataFrame) -> DataFrame:
    """AG03: the greatest whole-number revision of each document."""
    return rows.groupBy("company_document_id").agg(F.max(F.expr("try_cast(revision_number AS int)")).alias("latest"))


def of_latest_revision(rows: DataFrame) -> DataFrame:
    """JN06: the rows of each document's latest revision."""
    return rows.join(latest_revisions(rows), "company_document_id").filter(F.expr("try_cast(revision_number AS int)") == F.col("latest")).drop("latest")
