"""UI events, prompts and client-side projections as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X

# Prefix and types of event lines, style texts of prompts, rates per thousand tokens.
PREFIX = "__UI_EVENT__"
TYPES = ("SYSTEM_MESSAGE", "REQUEST_METADATA", "METADATA_CONFIRMED", "PROGRESS", "MODEL_STAGE", "ERROR", "NET_RATE_LIMITED", "SOURCES", "ANSWER_CONFIDENCE")
RATES = {"groq": "0.0005", "xai": "0.002"}
STYLES = {
    "one_line": "OUTPUT STYLE:\n- Extremely concise.\n- One single sentence.\n- No fluff.\n",
    "short": "OUTPUT STYLE:\n- Professional and direct.\n- Maximum 2-3 sentences.\n",
    "normal": "OUTPUT STYLE:\n- Professional and technical.\n- Provide a complete answer but remain concise.\n- Avoid unnecessary elaboration.\n",
    "detailed": "OUTPUT STYLE:\n- Detailed and comprehensive.\n- Explain the concept fully using the document context.\n- Break down complex points.\n- You may use multiple paragraphs if necessary.\n",
}
NO_CONTEXT = "No document context available."
TITLE_TASK = "You are a helpful assistant.\nSummarize the user's input into a concise title (maximum 5 words).\nDo not answer the question.\nDo not use quotes.\nDo not use \"Title:\" prefix.\nJust the text."
REFINE_TASK = "You are a technical editor.\n\nRULES:\n- Improve grammar and clarity only.\n- Preserve meaning EXACTLY.\n- Do NOT add or remove facts.\n- Do NOT expand explanations."


def event(kind: str, **fields: Column) -> Column:
    """PJ07: an event as JSON, its type first."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def progress_event(value: Column, label: Column) -> Column:
    """Progress between 0 and 100."""
    return event("PROGRESS", value=F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(value.cast("int"), F.lit(0)))), label=label)


def confidence_event(value: Column, level: Column) -> Column:
    """Confidence between 0 and 1 in two places, with a known level."""
    safe = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))
    return event("ANSWER_CONFIDENCE", confidence=F.bround(safe.cast("decimal(10,6)"), 2).cast("double"), level=F.when(level.isin("high", "medium", "low"), level).otherwise("low"))


def rate_limited_event(seconds: Column, provider: Column) -> Column:
    """Seconds to wait, one at least."""
    return event("NET_RATE_LIMITED", retryAfterSec=F.greatest(F.lit(1), F.coalesce(seconds.cast("int"), F.lit(30))), provider=provider)


def event_line(json: Column) -> Column:
    """PJ11: one line of the response stream."""
    return F.concat(F.lit(PREFIX), json, F.lit("\n"))


def parsed_type(line: Column) -> Column:
    """TG10: the type of a well-formed event line, else null."""
    body = F.regexp_replace(F.substring(line, F.lit(len(PREFIX) + 1), F.length(line)), f"^[{X.WS}]+", "")
    kind = F.get_json_object(body, "$.type")
    return F.when(line.startswith(PREFIX) & body.startswith("{") & kind.isin(*TYPES), kind)


def context_block(page: Column, section: Column, content: Column) -> Column:
    """PJ04: one chunk of a prompt's context."""
    return F.concat(F.lit("[Page "), F.coalesce(page, F.lit("?")), F.lit(" | Section: "), F.coalesce(section, F.lit("General")), F.lit("]\n"), F.coalesce(content, F.lit("")))


def context_text(rows: DataFrame, key: str, order: str, block: str, most: int = 8) -> DataFrame:
    """PJ04: the context of each key: the first `most` of its blocks in order, as a prompt takes its results."""
    from paperloom.operators.retrieval import top

    few = top(rows, key, most, F.col(order))
    return few.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, block))), lambda b: b[block]), "\n\n").alias("context"))


def style_text(verbosity: Column) -> Column:
    """The style of a verbosity, `short` by default."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv]), verbosity), F.lit(STYLES["short"]))


def prompt(system: Column, style: Column, context: Column, question: Column) -> Column:
    """SC36: a chat prompt of a system, a context and a question part."""
    head = lambda role: F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n")
    end = F.lit("<|eot_id|>")
    return F.concat(head("system"), system, F.lit("\n\n"), style, F.lit("\n"), end, head("user"), F.lit("CONTEXT:\n"), F.coalesce(context, F.lit(NO_CONTEXT)), F.lit("\n\nQUESTION:\n"), question, end, head("assistant"))


def title_prompt(question: Column) -> Column:
    """SC36: the prompt that asks for a conversation's title."""
    head = lambda role: F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n")
    return F.concat(head("system"), F.lit(TITLE_TASK), F.lit("\n\n<|eot_id|>"), head("user"), question, F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"))


def chat_prompt(system: Column, style: Column, history: Column, context: Column, question: Column) -> Column:
    """SC36: `prompt` with the last four (role, content) messages of a history between its parts.

    The models' prompts are this one: with a persona as system text and a style
    for chat models, with a reasoning persona and the default style for chains
    of thought, and without history (a null array) for small local models.
    """
    turn = lambda m: F.concat(F.lit("<|start_header_id|>"), F.when(m["role"] == "user", "user").otherwise("assistant"), F.lit("<|end_header_id|>\n"), X.clean_model_output(m["content"]), F.lit("<|eot_id|>"))
    last = F.slice(history, F.greatest(F.size(history) - 3, F.lit(1)), F.lit(4))
    said = F.coalesce(F.array_join(F.transform(last, turn), ""), F.lit(""))
    whole = prompt(system, style, context, question)
    cut = F.locate("<|start_header_id|>user<|end_header_id|>\nCONTEXT:", whole)
    return F.concat(F.substring(whole, F.lit(1), cut - 1), said, F.substring(whole, cut, F.length(whole)))


def refine_prompt(question: Column, draft: Column) -> Column:
    """SC36: the prompt that asks for better wording only."""
    return X.strip(F.concat(F.lit(REFINE_TASK + "\n\nQUESTION:\n"), question, F.lit("\n\nDRAFT ANSWER:\n"), draft, F.lit("\n\nREFINED ANSWER:\n")))


def model_id(mode: Column, known: dict[str, str], unknown: str | None = None) -> Column:
    """SC28: the model of a mode; `unknown` for any other, or an error where that is not given."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), mode)
    return F.coalesce(found, F.lit(unknown) if unknown is not None else F.raise_error(F.concat(F.lit("unknown model: "), F.coalesce(mode, F.lit("null")))).cast("string"))


def retry_delay(attempt: Column, base: int = 400) -> Column:
    """SC30: milliseconds to wait before an attempt: doubled each time."""
    return (F.lit(base) * F.pow(F.lit(2), attempt - 1)).cast("bigint")


def key_provider(key: Column) -> Column:
    """SC32: the provider that a key's prefix tells, else null."""
    return F.when(key.startswith("gsk_"), "groq").when(key.startswith("xai-"), "xai")


def upload_progress(percent: Column) -> Column:
    """SC35: an upload's share of the whole progress, 40 at most."""
    return F.least((percent.cast("decimal(10,2)") * F.lit("0.4").cast("decimal(2,1)")).cast("decimal(12,4)"), F.lit(40).cast("decimal(12,4)"))


def net_model(override: Column, kept: Column, name: Column) -> tuple[Column, Column]:
    """SC38: the provider (an override, else the kept one) and its model."""
    provider = F.coalesce(override, kept)
    return provider, F.concat(provider, F.lit("-"), name)


def token_cost(tokens: Column, provider: Column) -> Column:
    """AG15: dollars for a number of tokens, six places."""
    rate = F.coalesce(F.element_at(F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(v).cast("decimal(10,6)"))]), provider), F.lit("0").cast("decimal(10,6)"))
    return F.round((tokens.cast("decimal(18,0)") * rate / F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,9)"), 6).cast("decimal(18,6)")


def error_text(body: Column) -> Column:
    """PJ10: what a failed response says: detail or message of its JSON, else a fixed text for markup, else itself."""
    details = F.from_json(F.get_json_object(body, "$.detail"), "array<struct<msg:string>>")
    joined = F.when(F.get_json_object(body, "$.detail").startswith("["), F.array_join(F.transform(details, lambda d: d.msg), ", "))
    said = F.coalesce(joined, F.get_json_object(body, "$.detail"), F.get_json_object(body, "$.message"))
    return F.coalesce(said, F.when(body.startswith("<"), "Server error occurred").when(body == "", "Request failed").otherwise(body), F.lit("Request failed"))


def strategy(mb: Column, memory: Column, cpu: Column, cores: Column) -> Column:
    """SC29: how to parse a file of some size under some load."""
    out = lambda name, c, b: F.struct(F.lit(name).alias("strategy"), c.cast("int").alias("cores"), F.lit(b).alias("batch"))
    part = lambda share: F.greatest(F.lit(1), F.floor(cores * F.lit(share).cast("decimal(4,2)")))
    return F.when((memory > 85) | (cpu > 90), out("serial_stream", F.lit(1), 1)).when(mb < 5, out("in_memory", cores, 10)).when(mb < 50, out("batched_stream", part("0.75"), 5)).otherwise(out("serial_stream", part("0.50"), 1))


def select_model(text: Column, has_documents: Column, preferred: Column, net_ok: Column) -> Column:
    """SC27: which model answers."""
    return F.when(preferred == "net", F.when(net_ok, "net").otherwise("base")).when(has_documents, "base").when(X.token_count(text) <= 6, "lite").otherwise("base")
