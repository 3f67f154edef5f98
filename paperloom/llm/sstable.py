"""Token ids in sorted-string-table shards.

Documents are range-partitioned by identifier and sorted; each task encodes its
documents in that order and writes shards: compressed blocks of prefix-compressed
entries, a sparse index with the last key of each block, a Bloom filter over the
keys, and a fixed footer. A lookup reads footer, filter and index, finds the
block by binary search and scans that block alone.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, blocks, bound_batches, checkpointed, shared_dir

MAGIC = b"PLSSTAB1"
FOOTER = struct.Struct("<QQQQQQBI8s")  # index at, size; filter at, size; documents; tokens; bytes of an id; crc32 of index and filter; magic
BLOCK, SHARD = 64 << 10, 256 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Distinct words in a worker's memo table (about 200 bytes each).
WORDS = 750_000


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/", uri):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def key_of(identifier) -> bytes:
    """Bytes that sort as the identifiers do; null comes first."""
    if identifier is None:
        return b"\0"
    if isinstance(identifier, str):
        return b"\2" + identifier.encode()
    return b"\1" + (int(identifier) + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes):
    """The identifier of a key."""
    return None if key == b"\0" else key[1:].decode() if key[:1] == b"\2" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _bloom_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class Writer:
    """Writes one shard to an open stream; keys must come in order."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.index: list[list] = []
        self.hashes: list[int] = []
        self.block, self.last, self.held = bytearray(), b"", [0, 0]
        self.documents = self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        """One document's ids."""
        if self.documents and key < self.last:
            raise ValueError("keys are out of order")
        before = self.last if self.block else b""
        shared = next((k for k, (a, b) in enumerate(zip(before, key)) if a != b), min(len(before), len(key)))  # noqa: B905
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.documents += 1
        self.tokens += len(ids)
        self.held = [self.held[0] + 1, self.held[1] + len(ids)]
        if len(self.block) >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            packed = self.pack.compress(bytes(self.block))
            self.index.append([self.last.hex(), self.at, len(packed), *self.held])
            self._put(packed)
            self.block, self.held = bytearray(), [0, 0]

    def close(self) -> None:
        """Index, filter and footer."""
        self._end_block()
        index = zlib.compress(json.dumps(self.index).encode())
        bits = max(64, BLOOM_BITS * len(self.hashes))
        bloom = np.zeros(bits, bool)
        hashes = np.array(self.hashes, np.uint64)
        for k in range(0, len(hashes), 100_000):
            bloom[_bloom_places(hashes[k : k + 100_000], bits).astype(np.int64).ravel()] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        index_at = self.at
        self._put(index)
        self._put(packed)
        self._put(FOOTER.pack(index_at, len(index), index_at + len(index), len(packed), self.documents, self.tokens, self.width, zlib.crc32(index + packed), MAGIC))


class Reader:
    """Reads one shard from a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        (index_at, index_size, bloom_at, bloom_size, self.documents, self.tokens, self.width, crc, magic) = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        index, bloom = source.read_at(index_size, index_at), source.read_at(bloom_size, bloom_at)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError("not a whole shard")
        self.index = json.loads(zlib.decompress(index))
        self.last_keys = [bytes.fromhex(x[0]) for x in self.index]
        self.bits = struct.unpack("<Q", bloom[:8])[0]
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8, offset=8), count=self.bits).astype(bool)

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        """Keys and ids of one block."""
        _, at, size, _, _ = self.index[block]
        data, at, key = zstandard.ZstdDecompressor().decompress(self.source.read_at(size, at)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", length // self.width, at)
            at += length

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        """All entries in order."""
        for k in range(len(self.index)):
            yield from self.entries(k)

    def may_hold(self, key: bytes) -> bool:
        """What the Bloom filter says."""
        places = _bloom_places(np.array([xxhash.xxh64_intdigest(key)], np.uint64), self.bits)
        return bool(self.bloom[places.astype(np.int64)].all())

    def get(self, identifier) -> list[np.ndarray]:
        """Ids of every document with this identifier."""
        key, out = key_of(identifier), []
        if self.may_hold(key):
            for k in range(bisect_left(self.last_keys, key), len(self.index)):
                found = list(self.entries(k))
                out += [ids for name, ids in found if name == key]
                if found[-1][0] > key:
                    break
        return out


class WordEncoder:
    """Ids from the tokenizers library, each distinct word encoded once.

    The vocabulary lower-cases, drops white space and cuts words by a pattern
    that never crosses white space, so a text's ids are those of its parts. A
    text for which that is not certain goes to the library as a whole.
    """

    #: The pattern that cuts words.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: The same for texts of ASCII and Latin-1 letters in lower case, and what no such text has.
    LATIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
    BEYOND_LATIN = re.compile(r"[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
    #: Words that go to the library in one string.
    GROUP = 200
    #: Letters whose lower case depends on their place or is longer, and separators that only Python takes for white space.
    ODD = re.compile("[Σİ\x1c-\x1f]")

    def __init__(self, vocabulary: bytes, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each Spark task has its own core
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and cut == self.PATTERN.pattern
        self.library = Tokenizer.from_str(vocabulary.decode())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.width = 2 if max(self.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind).tobytes()
        self.words = Memo(self._encode_words, WORDS)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of single words: many in one string, apart by the library's own numbers of words."""
        out: list[bytes] = []
        for k in range(0, len(words), self.GROUP):
            part = words[k : k + self.GROUP]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            numbers = found.word_ids
            counts = np.bincount(np.array(numbers, np.int64), minlength=len(part)) if None not in numbers else np.zeros(0)
            if len(counts) != len(part) or not counts.all():
                out += self._encode(part)
                continue
            ids, ends = np.array(found.ids, self.kind).tobytes(), (np.cumsum(counts) * self.width).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def cut(self, text: str) -> list[str] | None:
        """The words of a text, or None if it may not be encoded word by word."""
        if not self.by_word or any(s in text for s in self.special):
            return None
        if not self.BEYOND_LATIN.search(text):
            return self.LATIN.findall(text.lower())
        if self.ODD.search(text) or not unicodedata.is_normalized("NFC", text):
            return None
        return self.PATTERN.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids and the end id, in the shards' width."""
        cut = [self.cut(t) for t in texts]
        table = self.words.of(*filter(None, cut))
        whole = iter(self._encode([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [(next(whole) if c is None else b"".join(map(table.__getitem__, c))) + self.end for c in cut]


@lru_cache(maxsize=2)
def word_encoder(vocabulary: bytes, end_id: int) -> WordEncoder:
    """One encoder per worker, so its memo tables last over tasks."""
    return WordEncoder(vocabulary, end_id)


def write_shards(docs: DataFrame, vocabulary_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode `docs` and write shards in ascending order of identifier; one row per shard.

    A null text counts as empty (the end id alone); a null id sorts first;
    equal ids are ordered by a hash of their text and all kept. A shard is
    renamed into place when whole, so a task that is run again leaves no part.
    """
    bound_batches(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    if source.schema["id"].dataType.typeName() != "string":
        source = source.withColumn("id", F.col("id").cast("bigint"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.length("text"), F.col("text")]
    ordered = source.repartitionByRange(*order[:3]).sortWithinPartitions(*order)

    def run(batches):
        encoder = word_encoder(vocabulary.value, end_id)
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        shards, writer, sink, place = [], None, None, ""

        def end():
            writer.close()
            sink.close()
            fs.move(f"{place}.{attempt}.part", place)
            shards.append((part, len(shards), place, writer.documents, writer.tokens))

        for block in blocks(batches):
            texts = [t or "" for t in block.column(1).to_pylist()]
            for identifier, ids in zip(block.column(0).to_pylist(), encoder.encode(texts), strict=True):
                if writer is None:
                    place = f"{base}/shard-{part:06d}-{len(shards):04d}.sst"
                    sink = fs.open_output_stream(f"{place}.{attempt}.part")
                    writer = Writer(sink, encoder.width)
                writer.add(key_of(identifier), np.frombuffer(ids, encoder.kind))
                if writer.at >= SHARD:
                    end()
                    writer = None
        if writer is not None:
            end()
        if shards:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*shards, strict=True)], names=["part", "number", "path", "documents", "tokens"])

    return checkpointed(ordered.mapInArrow(run, "part bigint, number bigint, path string, documents bigint, tokens bigint"))


def read_shards(shards: DataFrame, folder: str, id_type: str = "bigint", id_as: str = "doc_id") -> DataFrame:
    """Each document of the shards: its place in the whole sequence of ids, its token count and the crc32 of its ids.

    The rows of `shards` (one for each file of up to 256 MB) are few; the places
    where they begin are summed on the driver.
    """
    spark, starts, at = shards.sparkSession, [], 0
    for s in shards.orderBy("part", "number").toLocalIterator():
        starts.append((s.path, at))
        at += s.tokens
    schema = f"`{id_as}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not starts:
        return spark.createDataFrame([], schema)

    def run(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as source:
                    reader, rows = Reader(source), []
                    for key, ids in reader.scan():
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 5000:
                            yield _rows(rows, id_type, id_as)
                            rows = []
                    if rows:
                        yield _rows(rows, id_type, id_as)

    table = spark.createDataFrame(starts, "path string, start bigint").repartition(min(len(starts), 2000))
    return table.mapInArrow(run, schema)


def _rows(rows: list[tuple], id_type: str, id_as: str) -> pa.RecordBatch:
    kinds = [pa.string() if id_type == "string" else pa.int64(), *[pa.int64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_as, "start", "n_tokens", "ids_crc32"])


def token_shards(docs: DataFrame, vocabulary_path: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write `docs` as shards into `folder` (by default a new one in the shared folder) and read them back.

    An empty table writes no shard and gives no rows.
    """
    folder = folder or shared_dir(docs.sparkSession)
    kind = "string" if docs.schema[id_col].dataType.typeName() == "string" else "bigint"
    return read_shards(write_shards(docs, vocabulary_path, folder, end_id, id_col, text_col), folder, kind, id_col)
