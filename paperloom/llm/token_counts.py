"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is merged from its bytes by the
tokenizer's own rules; those that come out as one token are the whole tokens.
A pre-token among them counts as one without any merge; only the rest is
merged. Parts of texts between white space are kept in a bounded memo table per
worker, unless they are long.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PairTable, merge_words
from .common import Memo, map_texts

#: White space as the tokenizer's pattern knows it, and that pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevelCounter:
    """Counts of a byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        left, right = [vocab[a] for a, _ in merges], [vocab[b] for _, b in merges]
        self.table = PairTable(left, right, range(len(merges)), [vocab[a + b] for a, b in merges], max(vocab.values()) + 1)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.odd_space = re.compile(f"[{SPACE}]{{2}}|[{SPACE}]$|(?! )[{SPACE}]")
        self.part = re.compile(f"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]?[^{SPACE}]+")
        strings = [bytes(letters[c] for c in s) for s in vocab if all(c in letters for c in s)]
        self.whole = {s for s, n in zip(strings, self.merged(strings), strict=True) if n == 1}
        self.rest = Memo(lambda missing: self.merged([s.encode() for s in missing]))
        self.chunks = Memo(self._chunk_counts)

    def merged(self, words: list[bytes]) -> list[int]:
        """Tokens of each word, by merging."""
        lengths = np.array([len(w) for w in words], np.int64)
        return merge_words(self.first[np.frombuffer(b"".join(words), np.uint8)], lengths, self.table)[1].tolist()

    def _chunk_counts(self, chunks: list[str]) -> list[int]:
        whole, found = self.whole, [self.pattern.findall(c) for c in chunks]
        rest = self.rest.of([w for words in found for w in words if w.encode() not in whole])
        return [sum(1 if w.encode() in whole else rest[w] for w in words) for words in found]

    def pieces(self, text: str) -> list[str]:
        """Parts of a text whose counts add up.

        A pre-token always begins where white space follows something else, and
        before the last of several white-space characters: the pattern takes
        the others as one pre-token, and a space only with what follows it.
        """
        if self.odd_space.search(text):
            return self.part.findall(text)
        head, *tail = text.split(" ")
        return [head, *(" " + t for t in tail)]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special token's string in a text is that token."""
        cut, extra = [], []
        for t in texts:
            parts = self.split_special.split(t) if self.split_special and any(s in t for s in self.special) else [t]
            extra.append(len(parts) - 1)
            cut.append([p for part in parts if part for p in self.pieces(part)])
        table = self.chunks.of(*cut)
        return [sum(map(table.__getitem__, pieces)) + n for pieces, n in zip(cut, extra, strict=True)]


@lru_cache(maxsize=2)
def counter(vocabulary: bytes) -> ByteLevelCounter:
    """One counter per worker and vocabulary, so its memo tables last over tasks."""
    return ByteLevelCounter(vocabulary)


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its UTF-8 bytes, its tokens, and whether they are over `limit`.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated
    rows; a null id stays null; an empty table gives no rows; a text or word of
    any length is counted whole; further columns are not read. The vocabulary
    file (a few MB) is read on the driver and broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        c = counter(vocabulary.value)
        return lambda texts: {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": c.counts(texts)}

    out = map_texts(docs, make, "n_bytes bigint, n_tokens bigint", id_col, text_col)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
