"""Text functions on columns: normalising, keywords, intents, policies, output cleaning. All JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, word lists, markers and limits that results depend on.
WS = r" \t\n\r\x0B\f\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP_TOKENS = ("the", "what", "which", "when", "where", "is", "are", "was", "were", "of", "in", "for", "to", "and", "or")
TOPIC_STOPWORDS = (
    "what", "is", "the", "of", "at", "in", "on", "for", "and", "to", "does", "do", "did", "explain", "tell", "me", "more", "about", "give", "details", "this", "that", "how", "why",
    "when", "where", "which", "who", "are", "was", "were", "please", "can", "could", "would", "should",
)
NON_INFORMATIVE = ("hi", "hello", "hey", "ok", "okay", "yes", "no", "thanks", "thank you")
VAGUE_PHRASES = ("explain more", "tell more", "tell me more", "give more details", "more details", "elaborate", "explain in detail", "explain this", "what about this", "what about that", "details")
GREETINGS = ("hi", "hello", "hey", "hai", "hola", "good morning", "good afternoon", "good evening")
CONFIRMATIONS = ("ok", "okay", "yes", "yeah", "yep", "no", "nah", "thanks", "thank you", "cool", "fine")
FAST_GREETINGS = ("hi", "hello", "hey", "hai", "good morning", "good afternoon", "good evening")
FOLLOW_UPS = ("this", "that", "it", "again", "above", "previous", "same", "earlier", "explain more", "tell more", "more detail", "detail about")
POLICY_CONVERSATIONAL = ("hi", "hello", "hey", "thanks", "thank you", "ok", "okay", "cool")
POLICY_FOLLOW_UPS = ("explain again", "why", "how", "clarify", "again", "above", "previous")
POLICY_DEFINITION = ("what is", "define", "meaning of")
POLICY_FACT = ("what is the", "what are the", "state", "list", "give", "how much", "maximum", "minimum", "how many")
POLICY_REASONING = ("why", "how", "explain", "compare", "describe", "detail")
POLICY_CONTEXT = ("this", "that", "it", "same", "above", "previous")
POLICY_BRIEF = ("in short", "brief", "one line")
POLICY_DETAILED = ("explain fully", "detailed", "in detail", "more detail", "more info", "elaborate", "not getting any knowledge", "expand on", "tell me more")
BAD_ANSWERS = ("i am an ai", "i cannot answer", "not provided in the document", "no information available")
STOP_MARKERS = ("<|end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "REFINED ANSWER:", "END OF RESPONSE")
GARBAGE = (
    r"<\|assistant\|>", r"<\|system\|>", r"<\|user\|>", r"^\s*assistant\s*:\s*", r"^\s*user\s*:\s*", r"^\s*final answer\s*:\s*", r"^\s*response\s*:\s*", r"^\s*revised answer\s*:\s*",
    r"^\s*draft answer\s*:\s*", r"you are a .* assistant",
)
ECHO = r"^\s*(what|why|how|when|where|who)\b[^?.!]*\?\s*"
MAX_SENTENCES = {"one_line": 1, "short": 3, "normal": 6, "detailed": 12}
MAX_CHARS = {"one_line": 200, "short": 600, "normal": 1200, "detailed": 3000}
MIN_CONFIDENCE, MIN_GAP = 0.50, 0.08
CONVERSATIONAL_INTENTS = ("greeting", "conversation", "confirmation", "chitchat", "fast")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text contains one of the parts."""
    found = F.lit(False)
    for p in parts:
        found = found | c.contains(p)
    return found


def starts_with_any(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text begins with one of the parts."""
    found = F.lit(False)
    for p in parts:
        found = found | c.startswith(p)
    return found


def normalize_text(c: Column) -> Column:
    """SC01: lower case, runs of three and more of a character to one, punctuation to spaces, single spaces."""
    t = strip(F.lower(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(t, r"([^\n])\1{2,}", "$1")
    t = F.regexp_replace(t, r"([!?])[!?]+", "$1")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}_{WS}?!.]", " ")
    return strip(F.regexp_replace(t, f"[{WS}]{{2,}}", " "))


def token_count(c: Column) -> Column:
    """SC02: words between white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"[{WS}]+"), lambda x: x != ""))


def normalize_numbers(c: Column) -> Column:
    """SC03: letters O and l between digits to digits, then digits across white space joined, one pass."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=\d)[Oo](?=\d)", "0")
    t = F.regexp_replace(t, r"(?<=\d)[lI](?=\d)", "1")
    return F.regexp_replace(t, rf"(\d)[{WS}]+(\d)", "$1$2")


def extract_keywords(c: Column) -> Column:
    """SC05: distinct tokens of three and more characters that are no stop words, in order."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9\-.]+"), 0)
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_TOKENS)))


def keyword_match_score(question: Column, content: Column) -> Column:
    """SC06: share of the question's keywords found in the content."""
    kw, body = extract_keywords(question), F.lower(F.coalesce(content, F.lit("")))
    return F.when(F.size(kw) == 0, F.lit(0.0)).otherwise(F.size(F.filter(kw, lambda k: F.contains(body, k))) / F.size(kw))


def topic_hint(c: Column) -> Column:
    """SC07: the first five telling words, or null."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9\-]+"), 0)
    kept = F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*TOPIC_STOPWORDS))
    return F.nullif(F.array_join(F.slice(kept, 1, 5), " "), F.lit(""))


def chunk_id(document: Column, revision: Column, content: Column) -> Column:
    """SC08: md5 of document:revision:content."""
    return F.md5(F.concat(document, F.lit(":"), revision, F.lit(":"), content))


def document_id(filename: Column) -> Column:
    """SC09: name-based UUID (version 5, DNS namespace) of the file name in lower case."""
    name = F.unhex(F.concat(F.lit("6ba7b8109dad11d180b400c04fd430c8"), F.hex(strip(F.lower(filename)).cast("binary"))))
    h = F.sha1(name)
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def estimate_tokens(c: Column) -> Column:
    """SC11/AG15: four characters a token, rounded up."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("bigint")


def count_tokens(c: Column, tokenizer: Callable[[list[str]], list[int]] | None = None) -> Column:
    """SC11: tokens of a text by a tokenizer plug-in (texts to counts, a batch at a time), or estimated without one; a null text has none."""
    if tokenizer is None:
        return F.coalesce(estimate_tokens(c), F.lit(0))

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(tokenizer(["" if t is None else t for t in batch]), dtype="int64")

    return counted(c)


def is_vague(c: Column) -> Column:
    """SC12: a known vague phrase, or at most three words."""
    q = strip(F.lower(F.coalesce(c, F.lit(""))))
    return q.isin(*VAGUE_PHRASES) | (token_count(q) <= 3)


def rewrite_question(question: Column, base: Column) -> Column:
    """SC13: a vague question is joined with the last telling one."""
    q, b = F.lower(question), F.lower(base)
    return F.when(~is_vague(question) | base.isNull(), question).when(F.contains(b, q), base).when(F.contains(q, b), question).otherwise(F.concat(question, F.lit(" about "), base))


def guard_cleaned(original: Column, cleaned: Column) -> Column:
    """SC14: what a typo-fixing model returns, unless empty or over twice as long."""
    c = strip(cleaned)
    return F.when(c.isNull() | (c == "") | (F.length(c) > 2 * F.length(original)), original).otherwise(c)


def rule_intent(c: Column) -> Column:
    """SC15: intent by fixed rules, or null where a classifier has to decide."""
    t = strip(F.lower(c))
    return (
        F.when(c.isNull() | (c == ""), "unknown")
        .when(t.isin(*GREETINGS), "greeting")
        .when(t.isin(*CONFIRMATIONS), "confirmation")
        .when(token_count(t) <= 2, F.when(~t.rlike("[0-9]") & (F.length(t) < 4), "conversation"))
        .when(starts_with_any(t, tuple(f"{g} " for g in GREETINGS)), "greeting")
    )


def fast_intent(c: Column) -> Column:
    """SC16: cheap intent check; a greeting matches as a prefix, without a word's end."""
    q = strip(F.lower(F.coalesce(c, F.lit(""))))
    n = token_count(q)
    return F.when(q == "", "fact_lookup").when(starts_with_any(q, FAST_GREETINGS), "greeting").when((n <= 5) & any_of(q, FOLLOW_UPS), "follow_up").when(n <= 2, "fact_lookup")


def zero_shot_intent(label: Column, top: Column, second: Column) -> Column:
    """SC17: the decision over a classifier's best label and two best scores."""
    b = F.lower(label)
    return (
        F.when(b.isNull() | top.isNull(), "fact_lookup")
        .when(b.contains("follow-up") | b.contains("previous answer"), "follow_up")
        .when(top < MIN_CONFIDENCE, "fact_lookup")
        .when(top - F.coalesce(second, F.lit(0.0)) < MIN_GAP, "fact_lookup")
        .when(b.contains("greeting") | b.contains("casual conversation"), "greeting")
        .when(b.contains("definition") | b.contains("meaning"), "definition")
        .when(b.contains("fact lookup") | b.contains("specific value"), "fact_lookup")
        .when(b.contains("reasoning") | b.contains("explanation"), "reasoning")
        .otherwise("fact_lookup")
    )


def answer_policy(question: Column, previous_question: Column, previous_answer: Column) -> Column:
    """SC18: a struct of seven flags and the verbosity."""
    q = strip(F.lower(F.coalesce(question, F.lit(""))))
    had_q = F.coalesce(previous_question != "", F.lit(False))
    had_a = F.coalesce(previous_answer != "", F.lit(False))
    talk = q.isin(*POLICY_CONVERSATIONAL)
    follow = had_q & any_of(q, POLICY_FOLLOW_UPS)
    definition, fact, reason = starts_with_any(q, POLICY_DEFINITION), starts_with_any(q, POLICY_FACT), starts_with_any(q, POLICY_REASONING)
    vague = (token_count(q) <= 3) & ~talk
    context = ~talk & (any_of(q, POLICY_CONTEXT) | follow)
    verbosity = F.when(any_of(q, POLICY_DETAILED), "detailed").when(any_of(q, POLICY_BRIEF) | talk | vague | fact, "one_line").when(definition, "short").when(reason | follow, "normal").otherwise("short")
    strict = fact & ~reason & ~talk
    return F.struct(
        (~talk & (fact | context | reason) & ~(definition & ~context)).alias("use_rag"),
        (~talk & ~vague & (reason | (fact & context))).alias("use_deliberation"),
        verbosity.alias("verbosity"),
        follow.alias("is_follow_up"),
        context.alias("needs_context"),
        (~talk & ((vague & ~had_q) | (context & ~had_a))).alias("needs_clarification"),
        (~strict & ~talk & verbosity.isin("normal", "detailed")).alias("needs_refinement"),
        strict.alias("strict_factual"),
    )


def sentences(c: Column) -> Column:
    """Sentences, cut behind . ! ? before a capital letter or digit."""
    return F.split(c, rf"(?<=[.!?])[{WS}]+(?=[A-Z0-9])")


def response_policy(c: Column, verbosity: Column) -> Column:
    """SC20: an answer without prompt leakage, cut to its verbosity's sentences and characters, with few emoji."""
    t = F.coalesce(c, F.lit(""))
    for pattern in GARBAGE:
        t = F.regexp_replace(t, "(?im)" + pattern, "")
    t = F.regexp_replace(t, "(?i)" + ECHO, "")
    t = strip(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))
    limit = lambda of: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), verbosity), F.lit(of["short"]))
    t = F.array_join(F.slice(sentences(t), F.lit(1), limit(MAX_SENTENCES)), " ")
    cut = F.substring(t, F.lit(1), limit(MAX_CHARS))
    t = F.when(F.length(t) > limit(MAX_CHARS), F.concat(F.regexp_replace(F.regexp_replace(cut, r"(?s) [^ ]*$", ""), f"[{WS}]+$", ""), F.lit("…"))).otherwise(t)
    return strip(restrain_emoji(t))


def restrain_emoji(t: Column) -> Column:
    """Characters beyond the basic plane only up to 15 % of the length (at least one)."""
    allowed = F.greatest(F.lit(1), F.floor(F.length(t) * F.lit(0.15)).cast("int"))
    is_emoji = lambda ch: ch.rlike(r"^[\x{10000}-\x{10FFFF}]$")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    step = lambda a, ch: F.struct(F.when(is_emoji(ch) & (a.n >= allowed), a.out).otherwise(F.concat(a.out, ch)).alias("out"), (a.n + is_emoji(ch).cast("int")).alias("n"))
    return F.when(t.rlike(r"[\x{10000}-\x{10FFFF}]"), F.aggregate(F.split(t, ""), start, step).out).otherwise(t)


def short_answer(c: Column) -> Column:
    """SC21: the first sentence."""
    return strip(F.element_at(sentences(strip(F.coalesce(c, F.lit("")))), 1))


def clean_model_output(c: Column) -> Column:
    """SC22: what stands before the first stop marker."""
    t = F.coalesce(c, F.lit(""))
    for m in STOP_MARKERS:
        t = F.substring_index(t, m, 1)
    return strip(t)


def split_thinking(c: Column) -> Column:
    """SC23: a struct of thought and answer; an unclosed thought is all thought."""
    t = F.coalesce(c, F.lit(""))
    closed = r"(?s)<thinking>(.*?)</thinking>"
    is_closed, is_open = t.rlike(closed), t.contains("<thinking>")
    unclosed = strip(F.regexp_replace(t, "(?s)^(.*?)<thinking>(.*)$", "$1$2"))
    thought = F.when(is_closed, strip(F.regexp_extract(t, closed, 1))).when(is_open, F.when(unclosed == "", "Thinking...").otherwise(unclosed)).otherwise("")
    head = F.regexp_extract(t, r"(?s)^(.*?)<thinking>.*?</thinking>(.*)$", 1)
    tail = F.regexp_extract(t, r"(?s)^(.*?)<thinking>.*?</thinking>(.*)$", 2)
    answer = F.when(is_closed, strip(F.concat(head, tail))).when(is_open, "").otherwise(t)
    return F.struct(thought.alias("thought"), answer.alias("answer"))


def is_bad_answer(c: Column) -> Column:
    """FL10: empty, or with a phrase of refusal."""
    return c.isNull() | (c == "") | any_of(strip(F.lower(c)), BAD_ANSWERS)


def humanize(c: Column) -> Column:
    """PJ08: underscores to spaces, each word's first letter in upper case."""
    return F.initcap(F.trim(F.replace(c, F.lit("_"), F.lit(" "))))


def clean_title(c: Column) -> Column:
    """SC31: a generated title without quotes and label, 50 characters at most."""
    t = F.substring(F.replace(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit('"'), F.lit("")), F.lit("Title:"), F.lit("")), 1, 50)
    return F.when(t == "", "New Chat").otherwise(t)
