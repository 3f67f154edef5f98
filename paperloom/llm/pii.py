"""Personal data: four base patterns, and a BiLSTM-CRF tagger that adds what they miss.

Base matches always stay. The tagger is trained on generated lines with known
spans, also in spellings that the base patterns do not take (telephone numbers
without a plus sign, other separators in card numbers, two numbers side by side,
addresses with [at] and [dot]), and with look-alikes that are none (ISBNs, order
numbers, dates, versions, amounts). Its emissions in overlapping windows are
averaged and decoded as one sequence over the text; its spans are kept where
they touch no base span, stand alone and pass the kind's own check (layout,
parts up to 255, Luhn). Every span that it may add holds a digit or a sign for
@, so windows without either are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, rewrite_rows
from .tagger import Tagger, fit

KINDS = ("email", "ip", "card", "phone")
#: The base patterns (the local part of an address is found from its @).
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_SIGN = re.compile(r"[0-9@]")
SIGN = re.compile(r"[0-9@]|[\[(]at[\])]")
#: What an added span of each kind looks like as a whole.
ADDED = {
    "email": re.compile(r"[\w.%+-]+(?: ?@ ?|\[at\]|\(at\))[\w-]+(?:(?:\.|\[dot\]|\(dot\))[\w-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(\.|\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}(?:\1[0-9]{1,3}){2}"),
    "card": re.compile(r"[0-9]{14,19}|[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}"),
    "phone": re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}([. -]))[0-9]{3}[. -][0-9]{4}|00[0-9]{2}(?:[ -]?[0-9]{2,5}){2,5}|\+[0-9][ ().0-9-]+[0-9]"),
}
#: Lines of the tagger's training set, a parameter of the operator.
TRAINING_LINES = 2400


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = sum(int(d) if k % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    parts = re.findall("[0-9]+", s)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _card_ok(s: str) -> bool:
    return 14 <= len(d := _digits(s)) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 10 <= len(_digits(s)) <= 15


CHECKS = {"ip": _ip_ok, "card": _card_ok, "phone": _phone_ok}


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: every @ with a local part before and a domain behind it, in time linear in the text."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        end = (DOMAIN.match(text, at + 1) or re.match("", text)).end() if start < at else 0
        if end:
            found.append((start, end))
        floor = max(at + 1, end)
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base matches, in order."""
    if not BASE_SIGN.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    for k, (kind, pattern) in enumerate((("ip", IP), ("card", CARD), ("phone", PHONE)), 1):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if CHECKS[kind](m[0])]
    return sorted(found)


#: Words of the generated lines: before numbers that are telephone numbers, and before numbers that are none.
CALL = ("call", "tel", "tel.", "phone", "phone:", "fax", "mobile", "cell", "dial", "ring", "contact", "Tel:", "Telefon", "hotline", "call us at", "reach me on", "text", "whatsapp", "office", "téléphone")
NUMBERED = ("ISBN", "isbn", "order", "order no.", "no.", "nr.", "ref", "ref.", "invoice", "ticket", "sku", "part", "item", "serial", "tracking", "lot", "case", "doi", "build", "version", "id", "catalog", "article", "model", "page", "account", "batch", "#", "No", "code")


def training_lines(n: int, seed: int = 17) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Generated lines of up to a window with their spans."""
    rnd = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkqjxzéèüöñ"

    def word():
        w = "".join(rnd.choices(letters[:22] if rnd.random() < 0.8 else letters, k=rnd.randint(1, 9)))
        return w.capitalize() if rnd.random() < 0.15 else w

    def digits(k):
        return "".join(rnd.choices("0123456789", k=k))

    def name(k=8):
        return "".join(rnd.choices("abcdefghijklmnoprstuvwy", k=rnd.randint(2, k)))

    def email():
        local = rnd.choice([name(), f"{name()}.{name()}", f"{name()}.{digits(2)}", f"{name()}_{digits(1)}", f"{name()}+{name()}", f"{name(3)}{digits(3)}"])
        at, dot = rnd.choice([("@", ".")] * 3 + [(" @ ", "."), ("[at]", "[dot]"), ("(at)", "(dot)"), ("[at]", "."), ("(at)", ".")])
        domain = f"{name()}{rnd.choice(['', digits(1), '-' + name()])}{dot}{rnd.choice(['com', 'org', 'net', f'example{dot}com', f'co{dot}uk', 'de', 'io'])}"
        return [("", ""), (local + at + domain, "email")]

    def ip():
        sep = rnd.choice([".", ".", "[.]", "[.]", "(.)", "[dot]"])
        return [("", ""), (sep.join(str(rnd.randint(0, 255)) for _ in range(4)), "ip")]

    def a_card(sep):
        d = rnd.choice("3456") + digits(rnd.choice([14, 14, 14, 13, 15]))
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join((d[:4], d[4:8], d[8:12], d[12:]))

    def card():
        sep = rnd.choice(["", "", "", " ", "-", ".", "/", "_"])
        return [(a_card(sep), "card")] if rnd.random() < 0.7 else [(a_card(sep), "card"), (a_card(sep), "card")]

    def parts():
        a, b, c = digits(3), digits(3), digits(4)
        return rnd.choice([f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits(2)} {a} {b} {c}", f"00{digits(2)} {digits(2)} {digits(7)}"])

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        if rnd.random() < 0.4:
            return [(rnd.choice([f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"+{digits(11)}", f"({a}) {b}-{c}", f"({a}) {b} {c}"]), "phone")]
        return [(rnd.choice(CALL), None), (parts(), "phone")]

    def isbn():
        return rnd.choice([f"97{rnd.choice('89')}-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"97{rnd.choice('89')}-{digits(3)}-{digits(5)}", f"97{rnd.choice('89')}{digits(10)}", f"{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"97{rnd.choice('89')} {digits(1)} {digits(4)} {digits(4)} {digits(1)}"])

    def other():
        kind = rnd.random()
        if kind < 0.3:
            return [(rnd.choice(NUMBERED), None), (rnd.choice([parts(), parts(), isbn(), f"{digits(3)}-{digits(4)}-{digits(4)}", digits(rnd.randint(5, 13)), f"{digits(4)}-{digits(6)}", f"{digits(3)}-{digits(7)}"]), None)]
        if kind < 0.4:
            return [(rnd.choice([isbn(), f"{digits(3)}-{digits(4)}-{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)}", f"{digits(5)}-{digits(4)}"]), None)]
        if kind < 0.5:
            return [(rnd.choice([f"{name()} [at] {digits(2)}", f"@{name()}", f"{name()} (at) {word()}", f"{digits(1)}. {digits(1)}. {digits(1)}. {digits(1)}."]), None)]
        return [(rnd.choice([
            digits(rnd.randint(1, 6)), f"{rnd.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)},{digits(3)}.{digits(2)}",
            "AKIA" + digits(3) + name().upper() + digits(4), f"{name(3)}{digits(12)}{name(3)}{digits(9)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(3)} | {digits(2)} | {digits(4)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(1)}%",
            f"{digits(8)}-{digits(4)}-{name(4)}", f"{digits(2)}.{digits(2)}.{rnd.randint(1900, 2030)} {digits(2)}:{digits(2)}", f"${digits(3)},{digits(3)}", f"{digits(3)}-{digits(3)}", f"{digits(4)}-{digits(4)}",
        ]), None)]

    lines, spans = [], []
    for _ in range(n):
        line, own = word() if rnd.random() < 0.5 else "", []
        line += " " if line else ""
        while len(line) < 64:
            r = rnd.random()
            pieces = rnd.choice([email, ip, card, phone, phone])() if r < 0.2 else other() if r < 0.42 else [(word(), None)]
            pieces = [p for p in pieces if p[0]]
            if any(kind for _, kind in pieces) and len(line) + sum(len(p) + 1 for p, _ in pieces) > 64:
                break
            for k, (piece, kind) in enumerate(pieces):
                if kind:
                    own.append((len(line), len(line) + len(piece), kind))
                line += piece + (" " if k + 1 < len(pieces) else rnd.choice([" "] * 7 + [", ", ".\n", ". ", ") ", " | ", ": ", "!! "]))
        lines.append(line[:64])
        spans.append(own)
    return lines, spans


@lru_cache(maxsize=2)
def trained_tagger(lines: int = TRAINING_LINES) -> Tagger:
    """The tagger, trained once per process; the same for every run."""
    return fit(*training_lines(lines), KINDS)


def added_spans(text: str, base: list[tuple[int, int, int]], tags: np.ndarray) -> list[tuple[int, int, int]]:
    """What a text's tags add to its base spans."""
    inside = np.flatnonzero(tags)
    if not len(inside):
        return []
    taken = np.zeros(len(text) + 1, np.int64)
    for a, _, b in base:
        taken[a] += 1
        taken[b] -= 1
    taken = np.cumsum(taken)
    kind = (tags[inside] - 1) // 2
    new = np.concatenate(([True], (inside[1:] != inside[:-1] + 1) | (kind[1:] != kind[:-1]) | (tags[inside[1:]] % 2 == 1)))
    heads = np.flatnonzero(new)
    found, floor = [], 0
    for k, to in zip(heads.tolist(), [*heads[1:].tolist(), len(inside)], strict=True):
        a, b, which = int(inside[k]), int(inside[to - 1]) + 1, int(kind[k])
        while b > a and text[b - 1] in " .,-\n(":
            b -= 1
        while a < b and text[a] in " .,-\n)":
            a += 1
        if which == 0 and b > a:  # an address goes on over its letters, whatever window they fell into
            while a > floor and text[a - 1] in LOCAL:
                a -= 1
            while b < len(text) and (text[b].isalnum() or text[b] in "-_" or text[b] == "." and text[b + 1 : b + 2].isalnum()):
                b += 1
        if b <= a or a < floor or taken[a:b].any() or not _alone(text, a, b):
            continue
        if ADDED[KINDS[which]].fullmatch(text, a, b) and (which == 0 or CHECKS[KINDS[which]](text[a:b])):
            found.append((a, which, b))
            floor = b
    return found


def _alone(text: str, a: int, b: int) -> bool:
    """Whether neither a letter or digit, nor a joined one, goes on at either side."""
    before, after = text[max(0, a - 2) : a], text[b : b + 2]
    return not (before[-1:].isalnum() or after[:1].isalnum() or before[-1:] in "-._/+#" and before[:1].isalnum() and len(before) == 2 or after[:1] in "-_/" and after[1:].isalnum() or before[-1:] in "#$")


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text the base spans, and all spans, in order."""
    base = [base_spans(t) for t in texts]
    wanted = [np.array([m.start() for m in SIGN.finditer(t)], np.int64) for t in texts]
    some = [k for k, w in enumerate(wanted) if len(w)]
    every = list(base)
    for k, tags in zip(some, tagger.tag_all([texts[k] for k in some], [wanted[k] for k in some]), strict=True):
        every[k] = sorted(base[k] + added_spans(texts[k], base[k], tags))
    return list(zip(base, every, strict=True))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = TRAINING_LINES) -> DataFrame:
    """Per document the base matches by kind, their digest, and all spans in code points.

    A null text counts as empty; repeated rows give repeated rows; a null id
    stays null; an empty table gives no rows; texts of any length are read
    whole; spans that begin at one place are ordered by kind; further columns
    are not read. The tagger (some thousand numbers) is trained on the driver
    from `lines` generated lines and broadcast.
    """
    tagger = docs.sparkSession.sparkContext.broadcast(trained_tagger(lines))

    def make():
        def run(texts):
            out = {"n_email": [], "n_ip": [], "n_card": [], "n_phone": [], "base_sha256": [], "spans": []}
            for base, every in all_spans(texts, tagger.value):
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(every))
            return out

        return run

    return map_texts(docs, make, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", id_col, text_col)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind's name."""
    parts, at = [], 0
    for a, k, b in spans:
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", lines: int = TRAINING_LINES) -> DataFrame:
    """`docs` with personal data replaced; all rows and columns stay, `length_col` follows changed texts.

    Null and empty texts, null ids, repeated rows and further columns stay as they are.
    """
    tagger = docs.sparkSession.sparkContext.broadcast(trained_tagger(lines))
    return rewrite_rows(docs, lambda: lambda texts: {"text": [redacted(t, every) for t, (_, every) in zip(texts, all_spans(texts, tagger.value), strict=True)]}, text_col, length_col)
