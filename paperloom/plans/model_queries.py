"""Models as plug-ins, the splitter as a table function, and files read by page ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.functions.splitter import split_rows
from paperloom.operators import models as M
from paperloom.operators import retrieval as R
from paperloom.sources import files as S
from paperloom.sources import pages as P

from .bindings import chunk_store, elements, questions, quoted, sql, table
from .registry import query
from .retrieval_queries import _ASKED, _HYBRID, _SAME, _hybrid_hits, _topk, asked
from .text_queries import LABELS, s_any, s_low, s_starts, s_words

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts():
    """A model for the query below: a text's vector is one and how often it has each letter."""
    return lambda texts: [[1.0, *(float(t.count(x) + t.count(x.upper())) for x in LETTERS)] for t in texts]


def _letters(t: str) -> str:
    return "[1.0::DOUBLE, " + ", ".join(f"(length({t}) - length(replace(replace({t}, '{x}', ''), '{x.upper()}', '')))::DOUBLE" for x in LETTERS) + "]"


@query(
    "sc25_embed_and_search",
    sql(
        _topk(5, _SAME).replace("vectors s", "stored s"),
        "chunk_store",
        q=f"SELECT *, {_letters('question')} AS vector FROM ({_ASKED})",
        stored=f"SELECT *, {_letters('content')} AS embedding FROM chunk_store",
    ),
)
def sc25_search(spark, d):
    """Chunks and questions embedded by a plug-in, each once, and searched."""
    asking = M.embedded_once(asked(spark, d), letter_counts, "question", "vector")
    chunks = chunk_store(spark, d).select("chunk_id", "company_document_id", "revision_number", "content")
    return R.vector_search(asking, M.embedded_once(chunks, letter_counts).drop("content"), 5)


def label_words():
    """A model for the query below: a label's score is the share of its words that a question contains."""
    of = [label.split() for label in LABELS]
    return lambda texts: [[sum(w in t.lower() for w in words) / len(words) for words in of] for t in texts]


_SCORES = "[" + ", ".join(f"len(list_filter([{', '.join(map(quoted, label.split()))}], lambda w: contains(lower(question), w)))::DOUBLE / {len(label.split())}" for label in LABELS) + "]"
_BY_PLACE = " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(("greeting", "definition", "fact_lookup", "reasoning"), 1))


@query(
    "sc17_classify_by_model",
    sql(
        """SELECT qid, CASE WHEN fast IS NOT NULL THEN fast WHEN best = 5 THEN 'follow_up' WHEN top < 0.5::DOUBLE OR top - second < 0.08::DOUBLE THEN 'fact_lookup'"""
        f""" ELSE CASE best {_BY_PLACE} END END AS intent FROM (SELECT *, list_position(scores, top) AS best, list_reverse_sort(scores)[2] AS second FROM (SELECT *, list_max(scores) AS top FROM s))""",
        "questions",
        s=f"""SELECT qid, {_SCORES} AS scores, CASE WHEN t = '' THEN 'fact_lookup' WHEN {s_starts('t', X.FAST_GREETINGS)} THEN 'greeting' WHEN {s_words('t')} <= 5 AND {s_any('t', X.FOLLOW_UPS)} THEN 'follow_up'
          WHEN {s_words('t')} <= 2 THEN 'fact_lookup' END AS fast FROM (SELECT *, {s_low('question')} AS t FROM questions)""",
    ),
)
def sc17_model(spark, d):
    """Questions by the cheap rules, the others by a plug-in's scores."""
    return M.classified(questions(spark, d), label_words, LABELS).select("qid", "intent")


def lengths_alike():
    """A model for the query below: question and content are the closer, the more alike in length."""
    return lambda asked_, contents: [1.0 / (1 + abs(len(q) - len(c))) for q, c in zip(asked_, contents, strict=True)]


@query(
    "tk04_rerank_by_model",
    sql(
        "SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos, chunk_id)::INTEGER AS rank FROM scored) WHERE rank <= 8",
        "chunk_store",
        **_HYBRID,
        scored="""SELECT u.qid, u.chunk_id, u.pos, round(1.0::DOUBLE / (1 + abs(length(q.question) - length(c.content))), 6)::DECIMAL(12,6) AS score
          FROM united u JOIN (SELECT chunk_id, arg_min(content, row_id) AS content FROM chunk_store GROUP BY 1) c USING (chunk_id) JOIN asked q ON q.qid = u.qid""",
    ),
)
def tk04_model(spark, d):
    """The hybrid search's candidates by a plug-in's scores."""
    scored = R.candidates(_hybrid_hits(spark, d), chunk_store(spark, d), asked(spark, d), M.model_scorer(lengths_alike))
    return R.rerank(scored).select("qid", "chunk_id", "score", "rank")


@query("tg01_split_by_table_function")
def tg01_function(spark, d):
    """The chunks of all documents by the table function."""
    return split_rows(table(spark, d, "documents"), "doc_id", "text")


@query("io01_page_ranges", sql("SELECT doc_id, seq, category, text, page_number FROM elements", "elements"))
def io01_ranges(spark, d):
    """All elements written as lines, and read by ranges of pages of the files."""
    path = S.scratch_folder(spark)
    S.write_json(elements(spark, d), path)
    P.page_source(spark, P.LinePages(), "line_pages")
    lines = spark.read.format("line_pages").option("ending", ".json").option("pages", 16).load(path)
    element = "doc_id string, seq bigint, category string, text string, page_number int"
    return lines.select(F.from_json("text", element, {"mode": "FAILFAST"}).alias("e")).select("e.*")
