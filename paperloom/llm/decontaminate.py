"""Benchmark decontamination with suffix arrays over the training documents.

Each shard of documents (a block of the scan) becomes one array of word codes;
words that the benchmark lacks end a suffix. Its suffix array, made by prefix
doubling, orders the suffixes of all other words. Every test suffix is looked up
in it by binary search, after a table of first words that leaves out those the
shard cannot hold; the interval it finds holds all verbatim occurrences of its
window with their places, and intervals are marked, never multiplied with the
items that share a window. For the longest verbatim match each place is looked
up among the sorted test suffixes of its window by longest common prefixes. No
document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, map_texts, rewrite_rows

WINDOW, HEAD = 13, 4
#: Bytes of one broadcast index as it is sent, at most (or those of one item): WORD_BYTES a word, and the words themselves.
#: A larger benchmark is taken in several parts.
INDEX_BYTES, WORD_BYTES = 64 << 20, 16
#: Texts whose words the index hashes at once, in bytes.
BLOCK_BYTES = 1 << 20

#: Bytes of words (digits, letters and all of UTF-8 beyond ASCII), and A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True
SPACED = bytes(int(b) if IS_WORD[b] else 32 for b in LOWER)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.full(n, _BASE if which == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[which] = np.cumprod(step, dtype=np.uint64)
    return _powers[which][:n]


class Words:
    """The words of several texts: hashes, documents, and byte places."""

    def __init__(self, texts: list[bytes]):
        joined = b"\0".join(texts) + b"\0"
        self.data = LOWER[np.frombuffer(joined, np.uint8)]
        inside = IS_WORD[self.data].view(np.int8)
        edge = np.diff(inside, prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.doc = np.searchsorted(begins, self.start, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.n_words) - self.n_words
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[self.data] * _power("up", len(self.data)), dtype=np.uint64)))
        h = (sums[self.end] - sums[self.start]) * _power("down", len(self.data) + 1)[self.start]
        h ^= h >> np.uint64(29)
        self.hash = h * np.uint64(0xBF58476D1CE4E5B9)

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings that sort as the rows do."""
    rows = np.ascontiguousarray(rows.astype(">u4"))
    return rows.view(f"S{rows.shape[1] * 4}").ravel()


def _head(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """32 bits of hash of the first words of windows; equal windows have equal ones."""
    key = np.zeros(len(at), np.uint64)
    for k in range(size):
        key = (key + codes[at + k].astype(np.uint64)) * np.uint64(_BASE)
    return (key >> np.uint64(32)).astype(np.uint32)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0], ..., high[0] - 1, low[1], ... in one array."""
    sizes = high - low
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def suffix_array(codes: np.ndarray, run: np.ndarray, depth: int) -> np.ndarray:
    """Places of known words in the order of their suffixes, by prefix doubling.

    A suffix ends after its `run` of known words. Suffixes that agree in `depth`
    words, more than any search compares, stay in the order of their places.
    """
    order = np.flatnonzero(run)
    if not len(order):
        return order
    span = min(16, 62 // int(codes.max()).bit_length())
    key = np.zeros(len(order), np.int64)
    for k in range(span):
        key = key << int(codes.max()).bit_length() | np.where(run[order] > k, codes[np.minimum(order + k, len(codes) - 1)], 0)
    by = np.argsort(key, kind="stable")
    order, key = order[by], key[by]
    start = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(order)), 0))
    rank = np.zeros(len(codes), np.int64)
    rank[order] = start + 1
    while span < depth:
        same = start[1:] == start[:-1]
        k = np.flatnonzero((np.append(same, False) | np.append(False, same)) & (run[order] >= span))
        if not (run[order[k]] > span).any():
            break
        p = order[k]
        follow = np.where(run[p] > span, rank[np.minimum(p + span, len(codes) - 1)], 0)
        key = start[k] * (len(codes) + 1) + follow
        by = np.argsort(key, kind="stable")
        order[k], key = p[by], key[by]
        start[k] = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), k, 0))
        rank[order[k]] = start[k] + 1
        span *= 2
    return order


class Suffixes:
    """Codes with the lengths of their runs, and prefix sums by which common prefixes are measured."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray):
        self.codes, n = codes, len(codes)
        last = np.concatenate((doc[1:] != doc[:-1], [True])) if n else np.zeros(0, bool)
        stop = np.flatnonzero(last | (codes == 0))
        end = stop[np.searchsorted(stop, np.arange(n))]
        self.run = (end + (codes[end] > 0) - np.arange(n)).astype(np.int32)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((mixed ^ mixed >> np.uint64(29)) * _power("up", n), dtype=np.uint64)))

    def digest(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * _power("down", len(self.sums))[at]


def common_prefix(a: Suffixes, i: np.ndarray, b: Suffixes, j: np.ndarray, known: int) -> np.ndarray:
    """Words that suffixes i of a and j of b have in common, at least `known`."""
    low, high = np.full(len(i), known), np.minimum(a.run[i], b.run[j])
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = a.digest(i, mid) == b.digest(j, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


@dataclass
class Windows:
    """The distinct windows of one length in order, their test suffixes, and the sets of items that have them."""

    tests: np.ndarray
    bounds: np.ndarray  # of each window's suffixes in `tests`
    which: np.ndarray  # the set of items of each window
    sets: list[np.ndarray]
    heads: np.ndarray | None = None
    known: np.ndarray | None = None


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
    """Of all texts the hashes of their words in order, the number of words of each, and the words by their hashes; a block of texts at a time."""
    hashes, counts, words, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], {}, 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_BYTES):
            size += len(texts[to])
            to += 1
        block = Words(texts[at:to])
        own, first = np.unique(block.hash, return_index=True)
        for h, k in zip(own.tolist(), first.tolist(), strict=True):
            if h not in words:
                words[h] = block.word(k)
        hashes.append(block.hash)
        counts.append(block.n_words)
        at = to
    return np.concatenate(hashes), np.concatenate(counts), words


class TestIndex:
    """Sorted test suffixes of one part of the benchmark; items are numbered in the order of their ids.

    It is sent with what cannot be worked out from the rest: codes of words,
    suffixes, windows. Workers add prefix sums and heads.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, str]]):
        by_text: dict[str, set[str]] = {}
        for item, text in items:
            by_text.setdefault(text, set()).add(item)
        entries = sorted((sorted(ids), text) for text, ids in by_text.items())
        self.items = [ids for ids, _ in entries]
        hashes, self.n_words, words = _hashed([text.encode("utf-8", "replace") for _, text in entries])
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        del hashes
        known = [words[h] for h in self.vocabulary.tolist()]
        self.size = np.array([len(w) for w in known], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(known), np.uint8)
        self.codes = (codes + 1).astype(np.int32)
        self._rebuilt()
        order = suffix_array(self.suffixes.codes, self.suffixes.run, self.depth)
        lengths = np.minimum(self.n_words, WINDOW)
        rng = np.random.default_rng(7)
        marks = rng.integers(1, 1 << 63, (2, len(entries)), dtype=np.uint64)
        self.windows = {}
        for size in np.unique(lengths[lengths > 0]).tolist():
            tests = order[(lengths[self.item[order]] == size) & (self.suffixes.run[order] >= size)].astype(np.int32)
            new = np.zeros(len(tests), bool)
            new[0] = True
            for k in range(size):
                new[1:] |= self.codes[tests[1:] + k] != self.codes[tests[:-1] + k]
            fresh = np.flatnonzero(new)
            pairs = np.unique((np.cumsum(new) - 1) * len(entries) + self.item[tests])
            window, item = pairs // len(entries), pairs % len(entries)
            begins = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
            ends = np.append(begins[1:], len(item))
            # most windows belong to one item; of the others equal sets are told by sums of two marks
            one, several = np.flatnonzero(ends - begins == 1), np.flatnonzero(ends - begins > 1)
            which = np.zeros(len(begins), np.int32)
            single, which[one] = np.unique(item[begins[one]], return_inverse=True)
            sums = np.stack([np.add.reduceat(m[item], begins)[several] for m in marks], 1)
            _, first, numbers = np.unique(sums, axis=0, return_index=True, return_inverse=True)
            which[several] = len(single) + numbers.ravel()
            sets = [np.array([k]) for k in single.tolist()] + [item[begins[k] : ends[k]] for k in several[first].tolist()]
            self.windows[size] = Windows(tests, np.append(fresh, len(tests)).astype(np.int32), which, sets)
        self._headed()

    def _rebuilt(self) -> None:
        self.item = np.repeat(np.arange(len(self.n_words), dtype=np.int32), self.n_words)
        self.suffixes = Suffixes(self.codes, self.item)
        self.depth = int(self.n_words.max(initial=0))

    def _headed(self) -> None:
        for size, w in self.windows.items():
            w.heads = _head(self.codes, w.tests[w.bounds[:-1]], min(size, HEAD))
            w.known = np.unique(w.heads)

    def __getstate__(self) -> dict:
        sent = {k: v for k, v in self.__dict__.items() if k not in ("item", "suffixes", "depth")}
        return sent | {"windows": {size: replace(w, heads=None, known=None) for size, w in self.windows.items()}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._rebuilt()
        self._headed()

    def coded(self, words: Words) -> np.ndarray:
        """Codes of the words, compared byte by byte; 0 for a word that the benchmark lacks."""
        codes = np.zeros(len(words.hash), np.int64)
        if not len(self.vocabulary) or not len(codes):
            return codes
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        k = np.flatnonzero((self.vocabulary[at] == words.hash) & (self.size[at] == words.end - words.start))
        sizes = self.size[at[k]]
        other = words.data[_ranges(words.start[k], words.end[k])] != self.data[_ranges(self.at[at[k]], self.at[at[k]] + sizes)]
        codes[k] = at[k] + 1
        codes[k[np.searchsorted(np.cumsum(sizes), np.flatnonzero(other), "right")]] = 0
        return codes

    def search(self, shard: Suffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, places, windows there) of all verbatim occurrences in a shard."""
        order = suffix_array(shard.codes, shard.run, self.depth)
        for size, w in self.windows.items():
            at = order[shard.run[order] >= size]
            own = _head(shard.codes, at, min(size, HEAD))
            able = np.isin(own, w.known)
            at, own = at[able], own[able]
            asked = np.flatnonzero(np.isin(w.heads, own))
            if not len(asked):
                continue
            keys = _keys(shard.codes[at[:, None] + np.arange(size)])
            wanted = _keys(self.codes[w.tests[w.bounds[asked]][:, None] + np.arange(size)])
            low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            if (high > low).any():
                yield size, at[_ranges(low, high)], np.repeat(asked, high - low)

    def longest(self, shard: Suffixes, doc: np.ndarray, size: int, at: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, words, place, item) of each document's longest match that begins with a window; of equal ones the first place, then the least item."""
        w, tests = self.windows[size], self.suffixes
        low, high = w.bounds[window], w.bounds[window + 1]
        best = np.full(len(at), size)
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) // 2
            i, j = at[todo], w.tests[mid]
            same = common_prefix(shard, i, tests, j, size)
            best[todo] = np.maximum(best[todo], same)
            ended, over = same == tests.run[j], same == shard.run[i]
            before = ended | ~over & (tests.codes[np.where(ended, j, j + same)] < shard.codes[np.where(over, i, i + same)])
            low[todo], high[todo] = np.where(before, mid + 1, low[todo]), np.where(before, high[todo], mid)
        order = np.lexsort((at, -best, doc[at]))
        d = doc[at[order]]
        win = order[np.concatenate(([True], d[1:] != d[:-1]))]
        # the test suffixes that share the whole match lie around the place that the search ended at
        i, need, middle = at[win], best[win], low[win]
        ends = []
        for outer, step in ((w.bounds[window[win]], -1), (w.bounds[window[win] + 1], 1)):
            inner, outer = middle.copy(), outer.copy()
            while (todo := np.flatnonzero(inner != outer)).size:
                mid = (inner[todo] + outer[todo] + (step > 0)) // 2
                j = w.tests[mid if step < 0 else mid - 1]
                shares = common_prefix(shard, i[todo], tests, j, size) >= need[todo]
                inner[todo] = np.where(shares, mid, inner[todo])
                outer[todo] = np.where(shares, outer[todo], mid + 1 if step < 0 else mid - 1)
            ends.append(inner)
        for k, a, b in zip(win.tolist(), *map(np.ndarray.tolist, ends), strict=True):
            yield int(doc[at[k]]), int(best[k]), int(at[k]), int(self.item[w.tests[a:b]].min())


def matches(index: TestIndex, texts: list[str]) -> dict[str, list]:
    """Of each text: words, hit spans (begin, end, begin, ... in words), items, and the longest verbatim match."""
    words = Words([t.encode("utf-8", "replace") for t in texts])
    shard = Suffixes(index.coded(words), words.doc)
    n = len(texts)
    out = {"n_words": words.n_words.tolist(), "spans": [[] for _ in range(n)], "items": [[] for _ in range(n)], "longest_words": [0] * n, "longest_at": [None] * n, "longest_item": [None] * n}
    cover = np.zeros(len(words.hash) + 1, np.int64)
    best: dict[int, tuple] = {}
    found: dict[int, list[np.ndarray]] = {}
    for size, at, window in index.search(shard):
        cover[at] += 1
        cover -= np.bincount(at + size, minlength=len(cover))
        sets = index.windows[size].sets
        pairs = np.unique(words.doc[at] * len(sets) + index.windows[size].which[window])
        for d, k in zip((pairs // len(sets)).tolist(), (pairs % len(sets)).tolist(), strict=True):
            found.setdefault(d, []).append(sets[k])
        for d, length, place, item in index.longest(shard, words.doc, size, at, window):
            best[d] = min(best.get(d, (0, 0, 0)), (-length, place, item))
    names: dict[bytes, list[str]] = {}
    for d, parts in found.items():
        has = np.zeros(len(index.items), bool)
        for part in parts:
            has[part] = True
        key = np.packbits(has).tobytes()
        if key not in names:
            names[key] = sorted({i for k in np.flatnonzero(has).tolist() for i in index.items[k]})
        out["items"][d] = names[key]
    for d, (length, place, item) in best.items():
        out["longest_words"][d], out["longest_at"][d], out["longest_item"][d] = -length, int(place - words.first[d]), index.items[item][0]
    hit = np.cumsum(cover[:-1]) > 0
    if hit.any():
        joined = np.concatenate(([True], words.doc[1:] != words.doc[:-1]))
        begin = np.flatnonzero(hit & (joined | ~np.concatenate(([False], hit[:-1]))))
        end = np.flatnonzero(hit & (np.append(joined[1:], True) | ~np.append(hit[1:], False))) + 1
        for b, e, d in zip(begin.tolist(), end.tolist(), words.doc[begin].tolist(), strict=True):
            out["spans"][d] += [b - int(words.first[d]), e - int(words.first[d])]
    return out


def n_hit_of(spans: list[int]) -> int:
    """Words within the spans, which may overlap."""
    total = last = 0
    for b, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, e - max(b, last))
        last = max(last, e)
    return total


def parts_of(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Parts of the benchmark, (item, text) each, whose index has up to `limit` bytes as it is sent, or one item; rows come to the driver one part at a time, and one row more."""
    part, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        raw = text.encode("utf-8", "replace")
        own = len(raw) + WORD_BYTES * len(raw.translate(SPACED).split())
        if part and size + own > limit:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += own
    if part:
        yield part


MATCHES = "n_words bigint, spans array<bigint>, items array<string>, longest_words bigint, longest_at bigint, longest_item string"


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """Per document its words, hit words, items with occurring windows, verdict, and longest verbatim match with its place.

    Null texts have no words; an item without id or text is passed over; items
    of one text share their windows, texts of one item id count as one item;
    repeated rows give repeated rows; an empty benchmark hits nothing; an empty
    table gives no rows. Of equally long matches the first in the text counts,
    and there the least item id as a string. A very long text is a shard of its
    own; further columns are not read, so their names cannot clash. A benchmark
    whose index is beyond `index_bytes` is taken in parts, one scan and one broadcast at a
    time; each part's hits are written before the next begins, and come
    together by document with the same results.
    """
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h")).alias("key"), docs[text_col].alias("text"))
    parts = parts_of(benchmark, item_col, item_text_col, index_bytes)
    held, following = sc.broadcast(TestIndex(next(parts, []))), next(parts, None)
    found = map_texts(source, lambda: lambda texts: matches(held.value, texts), MATCHES, "key", "text")
    if following is not None:
        found, hits = checkpointed(found.withColumn("copies", F.lit(1))), None
        while following is not None:
            held.unpersist()
            held = sc.broadcast(TestIndex(following))
            more = map_texts(source, lambda held=held: lambda texts: matches(held.value, texts), MATCHES, "key", "text")
            more = checkpointed(more.filter(F.size("spans") > 0).withColumn("copies", F.lit(0)))
            hits, following = more if hits is None else hits.unionByName(more), next(parts, None)
        held.unpersist()
        best = F.min_by(F.struct("longest_words", "longest_at", "longest_item"), F.struct(-F.col("longest_words"), "longest_at", "longest_item")).alias("best")
        found = found.unionByName(hits).groupBy("key").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"), best, F.sum("copies").cast("int").alias("rows")
        )
        found = found.select("key", "n_words", "spans", "items", "best.*", F.explode(F.sequence(F.lit(1), "rows")).alias("copy"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda k: F.struct(F.get("spans", 2 * k).alias("b"), F.get("spans", 2 * k + 1).alias("e")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("last"))
    added = F.aggregate(
        F.array_sort(pairs), start, lambda a, s: F.struct((a.n + F.greatest(F.lit(0).cast("bigint"), s.e - F.greatest(s.b, a.last))).alias("n"), F.greatest(a.last, s.e).alias("last"))
    ).n
    found = found.withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("n_hit", F.when(F.size("spans") == 0, F.lit(0).cast("bigint")).otherwise(added))
    return found.select(
        F.col("key.id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest_words", "longest_at", "longest_item",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """`docs` without contaminated rows (hit words are at least a twentieth of the words).

    Rows with null or empty texts stay, repeated rows fare alike, all columns
    stay under whatever names; an empty benchmark or table changes nothing. With a benchmark of one part the rows are judged where they are; with more
    parts the verdicts meet the rows by id and text hash.
    """
    parts = parts_of(benchmark, item_col, item_text_col, index_bytes)
    part, more = next(parts, None), next(parts, None)
    if part is None:
        return docs
    if more is None:
        held = docs.sparkSession.sparkContext.broadcast(TestIndex(part))

        def make():
            def keep(texts):
                m = matches(held.value, texts)
                hits = map(n_hit_of, m["spans"])
                return {"keep": [not (h and 20 * h >= n) for h, n in zip(hits, m["n_words"], strict=True)]}

            return keep

        return rewrite_rows(docs, make, text_col)
    k = fresh(docs, "__key")
    keyed = docs.withColumn(k, F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h")))
    bad = contamination(keyed.select(k, text_col), benchmark, k, text_col, item_col, item_text_col, index_bytes).filter("contaminated").select(F.col(k).alias("bad")).distinct()
    return keyed.join(bad, keyed[k].eqNullSafe(bad["bad"]), "left_anti").select(docs.columns)
