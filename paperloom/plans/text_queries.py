"""Text functions over questions, messages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import memory as M

from .bindings import messages, questions, quoted, sql, table
from .registry import query

WS = X.WS


def s_strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def s_any(e: str, parts) -> str:
    return "(" + " OR ".join(f"contains({e}, {quoted(p)})" for p in parts) + ")"


def s_starts(e: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({e}, {quoted(p)})" for p in parts) + ")"


def s_in(e: str, parts) -> str:
    return f"{e} IN ({', '.join(map(quoted, parts))})"


def s_words(e: str) -> str:
    return f"len(list_filter(regexp_split_to_array({e}, '[{WS}]+'), lambda x: x <> ''))"


def s_low(e: str) -> str:
    return s_strip(f"lower(coalesce({e}, ''))")


def s_distinct(e: str) -> str:
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def s_sentences(e: str) -> str:
    return f"string_split(regexp_replace({e}, '([.!?])[{WS}]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


_RUNS = "list_filter(l, lambda c, i: NOT (c <> chr(10) AND coalesce(c = l[i - 1], false) AND i > 1 AND ((i > 2 AND coalesce(c = l[i - 2], false)) OR coalesce(c = l[i + 1], false))))"


@query(
    "sc01_normalize_text",
    sql(
        f"SELECT qid, {s_strip(f'''regexp_replace(t, '[{WS}]{{2,}}', ' ', 'g')''')} AS normalized FROM c",
        "questions",
        a=f"SELECT qid, {s_low('question')} AS t FROM questions",
        b=f"SELECT qid, coalesce(array_to_string({_RUNS}, ''), '') AS t FROM (SELECT qid, string_split(t, '') AS l FROM a)",
        c=f"SELECT qid, regexp_replace(regexp_replace(t, '([!?])[!?]+', '\\1', 'g'), '[^\\p{{L}}\\p{{N}}_{WS}?!.]', ' ', 'g') AS t FROM b",
    ),
)
def sc01(spark, d):
    return questions(spark, d).select("qid", X.normalize_text(F.col("question")).alias("normalized"))


@query("sc02_token_count", sql(f"SELECT qid, {s_words('question')}::INTEGER AS n_tokens FROM questions", "questions"))
def sc02(spark, d):
    return questions(spark, d).select("qid", X.token_count(F.col("question")).alias("n_tokens"))


def _digits(letters: str, to: str) -> str:
    return f"array_to_string(list_transform(l, lambda c, i: CASE WHEN c IN {letters} AND i > 1 AND coalesce(l[i - 1] BETWEEN '0' AND '9', false) AND coalesce(l[i + 1] BETWEEN '0' AND '9', false) THEN '{to}' ELSE c END), '')"


def _numbers(name: str, source: str, column: str) -> dict[str, str]:
    return {
        f"{name}1": f"SELECT * REPLACE (coalesce({_digits('''('O', 'o')''', '0')}, '') AS {column}) FROM (SELECT *, string_split(coalesce({column}, ''), '') AS l FROM {source})",
        f"{name}2": f"SELECT * EXCLUDE (l) REPLACE (regexp_replace(coalesce({_digits('''('l', 'I')''', '1')}, ''), '([0-9])[{WS}]+([0-9])', '\\1\\2', 'g') AS {column}) FROM (SELECT * EXCLUDE (l), string_split({column}, '') AS l FROM {name}1)",
    }


@query("sc03_normalize_numbers", sql("SELECT qid, t AS normalized FROM n2", "questions", q="SELECT qid, question AS t FROM questions", **_numbers("n", "q", "t")))
def sc03(spark, d):
    return questions(spark, d).select("qid", X.normalize_numbers(F.col("question")).alias("normalized"))


@query("sc04_normalize_numbers_twice", sql("SELECT qid, t AS normalized FROM m2", "questions", q="SELECT qid, question AS t FROM questions", **_numbers("n", "q", "t"), **_numbers("m", "n2", "t")))
def sc04(spark, d):
    return questions(spark, d).select("qid", X.normalize_numbers(X.normalize_numbers(F.col("question"))).alias("normalized"))


def s_keywords(e: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower(coalesce({e}, '')), '[a-z0-9\\-.]+'), lambda x: len(x) >= 3 AND NOT {s_in('x', X.STOP_TOKENS)})"
    return s_distinct(kept)


@query("sc05_extract_keywords", sql(f"SELECT qid, array_to_string({s_keywords('question')}, ' ') AS keywords FROM questions", "questions"))
def sc05(spark, d):
    return questions(spark, d).select("qid", F.array_join(X.extract_keywords(F.col("question")), " ").alias("keywords"))


@query(
    "sc06_keyword_match_score",
    sql(
        "SELECT session_id, turn, CASE WHEN len(kw) = 0 THEN 0 ELSE round_even((len(list_filter(kw, lambda k: contains(body, k)))::DOUBLE / len(kw))::DECIMAL(10,6), 4) END::DECIMAL(10,4) AS score FROM p",
        "messages",
        p=f"SELECT a.session_id, a.turn, {s_keywords('a.content')} AS kw, lower(b.content) AS body FROM messages a JOIN messages b ON b.session_id = a.session_id AND b.turn = a.turn + 1",
    ),
)
def sc06(spark, d):
    m = messages(spark, d)
    after = m.select("session_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("reply"))
    score = X.keyword_match_score(F.col("content"), F.col("reply"))
    return m.join(after, ["session_id", "turn"]).select("session_id", "turn", F.bround(score.cast("decimal(10,6)"), 4).cast("decimal(10,4)").alias("score"))


@query(
    "sc07_topic_hint",
    sql(
        f"SELECT qid, nullif(array_to_string(list_slice(list_filter(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9\\-]+'), lambda x: len(x) > 2 AND NOT {s_in('x', X.TOPIC_STOPWORDS)}), 1, 5), ' '), '') AS topic FROM questions",
        "questions",
    ),
)
def sc07(spark, d):
    return questions(spark, d).select("qid", X.topic_hint(F.col("question")).alias("topic"))


@query("sc08_chunk_id", "SELECT doc_id, md5(source || ':' || '1' || ':' || text) AS chunk_id FROM documents")
def sc08(spark, d):
    return table(spark, d, "documents").select("doc_id", X.chunk_id(F.col("source"), F.lit("1"), F.col("text")).alias("chunk_id"))


@query(
    "sc09_document_id",
    """WITH s AS (SELECT p_partkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8' || hex(lower(trim(p_name || '.pdf'))))) AS h FROM part)
    SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17:17]), 1) || h[18:20] || '-' || h[21:32] AS document_id FROM s""",
)
def sc09(spark, d):
    return table(spark, d, "part").select("p_partkey", X.document_id(F.concat("p_name", F.lit(".pdf"))).alias("document_id"))


@query("sc10_checksum", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sc10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("sc11_estimated_tokens", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS n_tokens FROM documents")
def sc11(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("n_tokens"))


def parts_between_spaces(texts: list[str]) -> list[int]:
    """A stand-in for a tokenizer."""
    return [t.count(" ") + 1 for t in texts]


@query("sc11_plugged_token_counts", "SELECT doc_id, len(string_split(coalesce(text, ''), ' '))::BIGINT AS n_tokens FROM documents")
def sc11_plugged(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_tokens(F.col("text"), parts_between_spaces).alias("n_tokens"))


def s_vague(e: str) -> str:
    q = s_low(e)
    return f"({s_in(q, X.VAGUE_PHRASES)} OR {s_words(q)} <= 3)"


@query("sc12_vague", sql(f"SELECT qid, {s_vague('question')} AS vague FROM questions", "questions"))
def sc12(spark, d):
    return questions(spark, d).select("qid", X.is_vague(F.col("question")).alias("vague"))


_SAID = f"SELECT session_id, turn, {s_strip("CASE WHEN turn % 4 = 2 THEN 'explain more' WHEN turn % 8 = 4 THEN 'the same' ELSE content END")} AS c FROM messages WHERE role = 'user'"
_BASES = f"""SELECT *, last_value(CASE WHEN c <> '' AND NOT {s_in('lower(c)', X.NON_INFORMATIVE)} AND NOT {s_vague('c')} THEN c END IGNORE NULLS)
  OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS base FROM said"""


def vague_history(spark, d):
    """Messages of which some user turns are vague."""
    vague = F.when(F.col("turn") % 4 == 2, "explain more").when(F.col("turn") % 8 == 4, "the same").otherwise(F.col("content"))
    return messages(spark, d).withColumn("content", X.strip(vague))


@query(
    "sc13_rewrite_question",
    sql(
        f"""SELECT session_id, turn, CASE WHEN NOT {s_vague('c')} OR base IS NULL THEN c WHEN contains(lower(base), lower(c)) THEN base WHEN contains(lower(c), lower(base)) THEN c ELSE c || ' about ' || base END AS rewritten FROM bases""",
        "messages",
        said=_SAID,
        bases=_BASES,
    ),
)
def sc13(spark, d):
    rows = M.rewrite_bases(vague_history(spark, d))
    return rows.select("session_id", "turn", X.rewrite_question(F.col("content"), F.col("base")).alias("rewritten"))


@query(
    "sc14_guard_cleaned",
    sql(
        f"SELECT qid, CASE WHEN c = '' OR length(c) > 2 * length(question) THEN question ELSE c END AS cleaned FROM (SELECT qid, question, {s_strip('repeat(question, (length(question) % 4)::INTEGER)')} AS c FROM questions)",
        "questions",
    ),
)
def sc14(spark, d):
    made = F.repeat(F.col("question"), (F.length("question") % 4).cast("int"))
    return questions(spark, d).select("qid", X.guard_cleaned(F.col("question"), made).alias("cleaned"))


@query(
    "sc15_rule_intent",
    sql(
        f"""SELECT qid, CASE WHEN question = '' THEN 'unknown' WHEN {s_in('t', X.GREETINGS)} THEN 'greeting' WHEN {s_in('t', X.CONFIRMATIONS)} THEN 'confirmation'
        WHEN {s_words('t')} <= 2 THEN CASE WHEN NOT regexp_matches(t, '[0-9]') AND length(t) < 4 THEN 'conversation' END
        WHEN {s_starts('t', [g + ' ' for g in X.GREETINGS])} THEN 'greeting' END AS intent FROM (SELECT qid, question, {s_low('question')} AS t FROM questions)""",
        "questions",
    ),
)
def sc15(spark, d):
    return questions(spark, d).select("qid", X.rule_intent(F.col("question")).alias("intent"))


@query(
    "sc16_fast_intent",
    sql(
        f"""SELECT qid, CASE WHEN t = '' THEN 'fact_lookup' WHEN {s_starts('t', X.FAST_GREETINGS)} THEN 'greeting' WHEN {s_words('t')} <= 5 AND {s_any('t', X.FOLLOW_UPS)} THEN 'follow_up'
        WHEN {s_words('t')} <= 2 THEN 'fact_lookup' END AS intent FROM (SELECT qid, {s_low('question')} AS t FROM questions)""",
        "questions",
    ),
)
def sc16(spark, d):
    return questions(spark, d).select("qid", X.fast_intent(F.col("question")).alias("intent"))


#: The classifier's candidate labels.
LABELS = (
    "greeting or casual conversation like hello hi good morning", "definition question asking for meaning or explanation of a term", "technical fact lookup question asking for a specific value from a document",
    "reasoning or explanation question asking why or how something works", "follow-up question referring to a previous answer or context",
)
_LABEL_SQL = "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(LABELS)) + " END"


@query(
    "sc17_zero_shot_decision",
    f"""WITH s AS (SELECT event_id, {_LABEL_SQL} AS label, (value::DECIMAL(10,2) / 100)::DECIMAL(10,4) AS top, ((event_id % 50)::DECIMAL(10,2) / 100)::DECIMAL(10,4) AS second FROM events)
    SELECT event_id, CASE WHEN contains(label, 'follow-up') THEN 'follow_up' WHEN top < 0.5 OR top - second < 0.08 THEN 'fact_lookup' WHEN contains(label, 'greeting') THEN 'greeting'
      WHEN contains(label, 'definition') THEN 'definition' WHEN contains(label, 'fact lookup') THEN 'fact_lookup' ELSE 'reasoning' END AS intent FROM s""",
)
def sc17(spark, d):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("event_id") % 5 + 1).cast("int"))
    score = lambda c: (c.cast("decimal(10,2)") / F.lit(100)).cast("decimal(10,4)")
    return table(spark, d, "events").select("event_id", X.zero_shot_intent(label, score(F.col("value")), score(F.col("event_id") % 50)).alias("intent"))


def s_policy(q: str, had_q: str, had_a: str) -> str:
    """Columns of the answer policy over columns q, had_q, had_a of the source `p`."""
    return f"""
      talk AS is_conversational, follow AS is_follow_up,
      (NOT talk AND (fact OR context OR reason) AND NOT (definition AND NOT context)) AS use_rag,
      (NOT talk AND NOT vague AND (reason OR (fact AND context))) AS use_deliberation, verbosity, context AS needs_context,
      (NOT talk AND ((vague AND NOT {had_q}) OR (context AND NOT {had_a}))) AS needs_clarification,
      (NOT (fact AND NOT reason AND NOT talk) AND NOT talk AND verbosity IN ('normal', 'detailed')) AS needs_refinement,
      (fact AND NOT reason AND NOT talk) AS strict_factual"""


_POLICY = {
    "f": f"""SELECT *, {s_in('q', X.POLICY_CONVERSATIONAL)} AS talk, had_q AND {s_any('q', X.POLICY_FOLLOW_UPS)} AS follow, {s_starts('q', X.POLICY_DEFINITION)} AS definition, {s_starts('q', X.POLICY_FACT)} AS fact,
      {s_starts('q', X.POLICY_REASONING)} AS reason FROM p""",
    "g": f"SELECT *, {s_words('q')} <= 3 AND NOT talk AS vague, NOT talk AND ({s_any('q', X.POLICY_CONTEXT)} OR follow) AS context FROM f",
    "h": f"""SELECT *, CASE WHEN {s_any('q', X.POLICY_DETAILED)} THEN 'detailed' WHEN {s_any('q', X.POLICY_BRIEF)} OR talk OR vague OR fact THEN 'one_line' WHEN definition THEN 'short'
      WHEN reason OR follow THEN 'normal' ELSE 'short' END AS verbosity FROM g""",
}


def _policy_rows(spark, d):
    rows = questions(spark, d)
    some_q, some_a = F.when(F.col("qid") % 2 == 0, "before"), F.when(F.col("qid") % 3 == 0, "answer")
    return rows.select("qid", X.answer_policy(F.col("question"), some_q, some_a).alias("p"))


_P = f"SELECT qid, {s_low('question')} AS q, qid % 2 = 0 AS had_q, qid % 3 = 0 AS had_a FROM questions"


@query("sc18_answer_policy", sql(f"SELECT * EXCLUDE (is_conversational) FROM (SELECT qid, {s_policy('q', 'had_q', 'had_a')} FROM h)", "questions", p=_P, **_POLICY))
def sc18(spark, d):
    return _policy_rows(spark, d).select("qid", "p.*")


@query(
    "sc19_answer_style",
    sql(f"SELECT qid, verbosity, needs_refinement FROM (SELECT qid, {s_policy('q', 'had_q', 'had_a')} FROM h)", "questions", p=_P.replace("qid % 2 = 0", "false").replace("qid % 3 = 0", "false"), **_POLICY),
)
def sc19(spark, d):
    none = F.lit(None).cast("string")
    return questions(spark, d).select("qid", X.answer_policy(F.col("question"), none, none).alias("p")).select("qid", "p.verbosity", "p.needs_refinement")


def _garbage(e: str) -> str:
    for pattern in X.GARBAGE:
        e = f"regexp_replace({e}, '(?im){pattern}', '', 'g')"
    return e


_LIMITS = lambda of, e: f"CASE {e} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + " END"


@query(
    "sc20_response_policy",
    sql(
        f"""SELECT session_id, turn, verbosity, {s_strip('''CASE WHEN n_emoji = 0 THEN t ELSE coalesce(array_to_string(list_filter(l, lambda c, i: NOT regexp_matches(c, '[\\x{10000}-\\x{10FFFF}]')
          OR len(list_filter(l[1:i], lambda x: regexp_matches(x, '[\\x{10000}-\\x{10FFFF}]'))) <= greatest(1, floor(length(t) * 0.15))), ''), '') END''')} AS answer FROM e""",
        "messages",
        a=f"""SELECT session_id, turn, CASE turn % 4 WHEN 0 THEN 'one_line' WHEN 1 THEN 'short' WHEN 2 THEN 'normal' ELSE 'detailed' END AS verbosity,
          {_garbage("'Assistant: ' || content || ' Ok then. \U0001f600\U0001f600\U0001f600'")} AS t FROM messages""",
        b=f"SELECT * REPLACE ({s_strip('''regexp_replace(regexp_replace(regexp_replace(t, '(?i)''' + X.ECHO + '''', ''), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g')''')} AS t) FROM a",
        c=f"SELECT * REPLACE (array_to_string(list_slice({s_sentences('t')}, 1, {_LIMITS(X.MAX_SENTENCES, 'verbosity')}), ' ') AS t) FROM b",
        dd=f"""SELECT * REPLACE (CASE WHEN length(t) > {_LIMITS(X.MAX_CHARS, 'verbosity')} THEN
          regexp_replace(regexp_replace(substr(t, 1, {_LIMITS(X.MAX_CHARS, 'verbosity')}), '(?s) [^ ]*$', ''), '[{WS}]+$', '') || '…' ELSE t END AS t) FROM c""",
        e="SELECT *, string_split(t, '') AS l, length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS n_emoji FROM dd",
    ),
)
def sc20(spark, d):
    said = F.concat(F.lit("Assistant: "), "content", F.lit(" Ok then. \U0001f600\U0001f600\U0001f600"))
    verbosity = F.when(F.col("turn") % 4 == 0, "one_line").when(F.col("turn") % 4 == 1, "short").when(F.col("turn") % 4 == 2, "normal").otherwise("detailed")
    return messages(spark, d).select("session_id", "turn", verbosity.alias("verbosity"), X.response_policy(said, verbosity).alias("answer"))


@query("sc21_short_answer", f"SELECT doc_id, {s_strip(s_sentences(s_strip('text')) + '[1]')} AS answer FROM documents")
def sc21(spark, d):
    return table(spark, d, "documents").select("doc_id", X.short_answer(F.col("text")).alias("answer"))


def _until(e: str) -> str:
    for m in X.STOP_MARKERS:
        e = f"string_split({e}, {quoted(m)})[1]"
    return e


_MARKED = "CASE turn % 3 WHEN 0 THEN content || '<|end|>junk' WHEN 1 THEN 'a ' || content || ' REFINED ANSWER: b <|user|>' ELSE content END"


@query("sc22_clean_output", sql(f"SELECT session_id, turn, {s_strip(_until(_MARKED))} AS cleaned FROM messages", "messages"))
def sc22(spark, d):
    c = F.col("content")
    marked = F.when(F.col("turn") % 3 == 0, F.concat(c, F.lit("<|end|>junk"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("a "), c, F.lit(" REFINED ANSWER: b <|user|>"))).otherwise(c)
    return messages(spark, d).select("session_id", "turn", X.clean_model_output(marked).alias("cleaned"))


@query(
    "sc23_split_thinking",
    sql(
        f"""SELECT session_id, turn, {s_strip("CASE turn % 3 WHEN 0 THEN content WHEN 1 THEN 'x ' || content ELSE '' END")} AS thought,
        {s_strip("CASE turn % 3 WHEN 0 THEN ' c ' || content WHEN 1 THEN '' ELSE content END")} AS answer FROM messages""",
        "messages",
    ),
)
def sc23(spark, d):
    c = F.col("content")
    made = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<thinking>"), c, F.lit("</thinking> c "), c)).when(F.col("turn") % 3 == 1, F.concat(F.lit("x <thinking>"), c)).otherwise(c)
    return messages(spark, d).select("session_id", "turn", X.split_thinking(made).alias("s")).select("session_id", "turn", "s.thought", "s.answer")


@query("fl10_bad_answer", sql(f"SELECT session_id, turn, {s_any(s_low('content'), X.BAD_ANSWERS)} OR content = '' AS bad FROM (SELECT session_id, turn, CASE WHEN turn % 5 = 0 THEN 'Sorry, I am an AI' WHEN turn % 5 = 1 THEN '' ELSE content END AS content FROM messages)", "messages"))
def fl10(spark, d):
    c = F.when(F.col("turn") % 5 == 0, "Sorry, I am an AI").when(F.col("turn") % 5 == 1, "").otherwise(F.col("content"))
    return messages(spark, d).select("session_id", "turn", X.is_bad_answer(c).alias("bad"))


@query("pj08_humanize", "SELECT p_partkey, array_to_string(list_transform(string_split(trim(replace(p_name || '_' || p_type, '_', ' ')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM part")
def pj08(spark, d):
    return table(spark, d, "part").select("p_partkey", X.humanize(F.concat("p_name", F.lit("_"), "p_type")).alias("label"))


@query("sc31_clean_title", sql(f"""SELECT qid, CASE WHEN t = '' THEN 'New Chat' ELSE t END AS title FROM (SELECT qid, substr(replace(replace({s_strip("'Title:\"' || question || '\"'")}, '"', ''), 'Title:', ''), 1, 50) AS t FROM questions)""", "questions"))
def sc31(spark, d):
    return questions(spark, d).select("qid", X.clean_title(F.concat(F.lit('Title:"'), "question", F.lit('"'))).alias("title"))


@query("sc37_conversational_intent", sql(f"SELECT qid, coalesce({s_in('i', X.CONVERSATIONAL_INTENTS)}, false) AS conversational, CASE WHEN coalesce({s_in('i', X.CONVERSATIONAL_INTENTS)}, false) THEN 128 ELSE 1024 END::INTEGER AS max_tokens FROM (SELECT qid, CASE WHEN question = 'hi' THEN 'greeting' WHEN qid % 7 = 0 THEN 'fast' WHEN qid % 7 = 1 THEN NULL ELSE 'fact_lookup' END AS i FROM questions)", "questions"))
def sc37(spark, d):
    intent = F.when(F.col("question") == "hi", "greeting").when(F.col("qid") % 7 == 0, "fast").when(F.col("qid") % 7 == 1, F.lit(None)).otherwise("fact_lookup")
    talk = F.coalesce(intent.isin(*X.CONVERSATIONAL_INTENTS), F.lit(False))
    return questions(spark, d).select("qid", talk.alias("conversational"), F.when(talk, F.least(F.lit(1024), F.lit(128))).otherwise(1024).alias("max_tokens"))
