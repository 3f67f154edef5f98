"""Encoding and decoding with a SentencePiece BPE model, by vectorised merge rounds.

The model file is read here (its protocol-buffer fields are few); the library
is not used. A text's spaces become U+2581 after a dummy prefix. No piece has
U+2581 behind another character (checked when the model is loaded), and none has
a line's end beside another, so words that begin with a space and lines are
merged on their own and kept in a bounded memo table, unless they are long.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .bpe import PairTable, merge_words
from .common import Memo, map_texts

#: Fixed values of the model format: piece types, and the sign for a space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "\u2581"


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield number, data[at : at + size]
            at += size


class PieceModel:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        pieces, scores, kinds = [], [], []
        options = {"dummy_prefix": 1, "extra_spaces": 1, "escape": 1, "charsmap": b""}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                spec = dict(fields(value))
                options = {"dummy_prefix": spec.get(3, 1), "extra_spaces": spec.get(4, 1), "escape": spec.get(5, 1), "charsmap": spec.get(2, b"")}
        if options["charsmap"] or options["extra_spaces"] or not options["escape"] or not options["dummy_prefix"]:
            raise ValueError("only models with the identity normaliser, a dummy prefix and kept spaces are supported")
        if {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.unknown = kinds.index(UNKNOWN)
        self.pieces, self.kinds = pieces, kinds
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        #: Symbols: pieces by their id, then characters that only occur within pieces.
        self.inner = inner = sorted({c for p in normal for c in p} - normal.keys())
        self.symbol = normal | {c: len(pieces) + k for k, c in enumerate(inner)}
        self.word_split = not any(MARK in p.lstrip(MARK) for p in normal)
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        left, right, rank, product = [], [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                if (a := self.symbol.get(p[:k])) is not None and (b := self.symbol.get(p[k:])) is not None:
                    left.append(a), right.append(b), rank.append(order[scores[i]]), product.append(i)
        self.table = PairTable(left, right, rank, product, len(pieces) + len(inner))
        codes = np.full(0x110000, -1, np.int64)
        for c, i in self.symbol.items():
            if len(c) == 1:
                codes[ord(c)] = i
        self.codes = codes
        self.bytes_of = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " \u2047 ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.words = Memo(self._work_out)
        #: Control characters that no piece has beside another; no merge crosses them.
        inside = {c for p in normal if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in inside)
        self.odd = re.compile(f" {{2}}|^ |[{alone}]") if alone else re.compile(" {2}|^ ")
        self.word = re.compile(f" +[^ {alone}]*|[^ {alone}]+|[{alone}]+") if alone else re.compile(" +[^ ]*|[^ ]+")

    def words_of(self, text: str) -> list[str]:
        """The words of a text with the spaces before them, its dummy prefix among them; empty for the empty text."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if not self.word_split:
            return [" " + text]
        if not self.odd.search(text):
            return [" " + w for w in text.split(" ")]
        return self.word.findall(" " + text)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        flat = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), np.uint32)
        symbols, lengths = merge_words(self._coded(flat), [len(w) for w in words], self.table)
        flat_ids = symbols.tolist()
        ends = np.cumsum(lengths).tolist()
        out, at = [], 0
        for end in ends:
            out.append(flat_ids[at:end])
            at = end
        limit = len(self.pieces)
        odd = np.flatnonzero((symbols < 0) | (symbols >= limit))
        if len(odd):
            for k in np.unique(np.searchsorted(ends, odd, side="right")).tolist():
                out[k] = [i for s in out[k] for i in self._fallback(s)]
        return out

    def _coded(self, flat: np.ndarray) -> np.ndarray:
        """Symbols of the characters; one that no piece has is -2 - its code point."""
        coded = self.codes[flat]
        return np.where(coded < 0, -2 - flat.astype(np.int64), coded)

    def _fallback(self, symbol: int) -> list[int]:
        if 0 <= symbol < len(self.pieces):
            return [symbol]
        c = chr(-2 - symbol) if symbol < 0 else self.inner[symbol - len(self.pieces)]
        return [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8 with its leading space kept; bytes that are not UTF-8 become U+FFFD each."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def _work_out(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        return [(",".join(map(str, ids)).encode(), self.decode_bytes(ids)) for ids in self.encode_words(words)]

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        return [i for ids in self.encode_words(self.words_of(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space of the dummy prefix goes."""
        return self.decode_bytes(ids).decode().removeprefix(" ")

    def digests(self, texts: list[str]) -> dict[str, list]:
        """Token counts and digests of ids and decoded texts."""
        cut = [self.words_of(t) for t in texts]
        table = self.words.of(*cut)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for words in cut:
            rows = [table[w] for w in words]
            ids = b",".join([r[0] for r in rows])
            back = b"".join([r[1] for r in rows])
            out["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back[1:] if back.startswith(b" ") else back).hexdigest())
        return out


@lru_cache(maxsize=2)
def piece_model(model: bytes) -> PieceModel:
    """One model per worker, so its memo table lasts over tasks."""
    return PieceModel(model)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its token count and digests of its ids and of its decoded text.

    A null text counts as empty (0 tokens, digests of nothing); repeated rows
    give repeated rows; a null id stays null; an empty table gives no rows; a
    text or word of any length is encoded whole; further columns are not read. The
    model file (under a few MB) is read on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    return map_texts(docs, lambda: piece_model(model.value).digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)
