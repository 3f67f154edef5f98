"""Phrase collocations by Apriori level-wise passes.

Each level is one pass over the texts: level 1 counts the words of every
language; level k counts the phrases of k words of which both overlapping
phrases of k - 1 words are frequent, which a broadcast tells. That broadcast is
the sorted keys of the frequent phrases up to KEYS_SENT of them, and beyond it
a bit table of a fixed size, whose false positives only cost phrases that are
counted and then found infrequent. Blocks of texts are counted in numpy before
their counts go through Spark's own partial and final sums. Cuts are scored by
joins of the level tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bound_batches, checkpointed, join_values

LONGEST, LEAST, TOP, SCALE = 4, 30, 2000, 2_000_000
#: A phrase goes if a longer one has at least this many hundredths of its count.
COVERED = 80
#: Keys that are broadcast as they are (8 bytes each), and the bits of the table that is broadcast otherwise (16 MB).
KEYS_SENT, TABLE_BITS = 1 << 21, 27
#: Distinct words and phrases that a task gathers before it sends their counts, words that are taken at a time, and the bits of a word's number.
WORDS_HELD, PHRASES_HELD, SLICE, WORD_BITS = 300_000, 1_000_000, 500_000, 21
#: Classes of scores and counts for each factor of e; a language has at most some thousand.
CLASSES = 64

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, every separator as a full stop, a tab as a space.
_PLAIN = bytes(ord(".") if b in _SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text with a full stop as a token of its own for each separator; no word holds one."""
    return text.translate(_PLAIN).replace(b".", b" . ").split()


def word_key(lang: str, word: bytes) -> int:
    """A signed 64-bit key of a word of a language, never 0."""
    key = xxhash.xxh64_intdigest(lang.encode() + b"\0" + word)
    return (key - (1 << 64) if key >> 63 else key) or 1


def phrase_keys(columns: list[np.ndarray]) -> np.ndarray:
    """One signed 64-bit key for each row of word keys, only used to ask whether a phrase may be frequent."""
    out = columns[0].astype(np.int64).view(np.uint64)
    for c in columns[1:]:
        out = (out ^ out >> np.uint64(29)) * _MULTIPLIER + c.astype(np.int64).view(np.uint64)
    return out.view(np.int64)


class Frequent:
    """Which keys may be frequent: exactly, from sorted keys, or by a bit table."""

    def __init__(self, keys: np.ndarray | None, table: np.ndarray | None = None):
        self.keys, self.table = keys, table

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.table is not None:
            place = keys.view(np.uint64) * _MULTIPLIER >> np.uint64(64 - TABLE_BITS)
            return (self.table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys


def broadcast_keys(level: DataFrame, size: int, sent: int = KEYS_SENT):
    """A broadcast of the level's keys: sorted if at most `sent` of them, else folded by the executors into the bits of one table."""
    columns = [f"w{k}" for k in range(size)]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(phrase_keys([batch.column(k).to_numpy() for k in range(size)]))], names=["key"])

    keys = level.select(columns).mapInArrow(run, "key bigint")
    sc = level.sparkSession.sparkContext
    if level.count() <= sent:
        return sc.broadcast(Frequent(np.array(sorted(r.key for r in keys.collect()), np.int64)))

    def places(batches):
        for batch in batches:
            place = batch.column(0).to_numpy().view(np.uint64) * _MULTIPLIER >> np.uint64(64 - TABLE_BITS)
            bit = np.left_shift(np.uint64(1), place & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["at", "bit"])

    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for r in keys.mapInArrow(places, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        table[r.at] = r.bit
    return sc.broadcast(Frequent(None, table.view(np.uint64)))


def by_language(block: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The UTF-8 texts of each language of a block of (lang, text)."""
    langs = block.column(0).to_pylist()
    texts = block.column(1).cast(pa.binary()).to_pylist()
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts, strict=True):
        groups.setdefault(lang, []).append(text or b"")
    yield from groups.items()


def word_counts(source: DataFrame) -> DataFrame:
    """(lang, word, key, f) of every word; a task sends each word once for every WORDS_HELD distinct ones."""

    def run(batches):
        held: dict[str, Counter] = {}

        def rows():
            for lang, counts in held.items():
                counts.pop(b".", None)
                words = list(counts)
                keys = np.fromiter((word_key(lang, w) for w in words), np.int64, len(words))
                text = pa.array(words, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), text, pa.array(keys), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "key", "f"])
            held.clear()

        for block in blocks(batches):
            for lang, texts in by_language(block):
                held.setdefault(lang, Counter()).update(tokens(b".".join(texts)))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from rows()
        yield from rows()

    found = source.mapInArrow(run, "lang string, word string, key bigint, f bigint")
    return found.groupBy("lang", "word", "key").agg(F.sum("f").alias("f"))


class Numbers(dict):
    """Small numbers for the words of a language as they come up, 0 for the full stop, and their keys."""

    def __init__(self, lang: str):
        super().__init__({b".": 0})
        self.lang, self.keys = lang, [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.keys)
        self.keys.append(word_key(self.lang, word))
        return n


def summed_up(codes: np.ndarray, last: np.ndarray | None, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct pairs of a code and a last word, if there is one, with the sums of their counts (1 each where there are none)."""
    if last is None and counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes) if last is None else np.lexsort((codes, last))
        codes = codes[order]
        last, counts = (v if v is None else v[order] for v in (last, counts))
    new = codes[1:] != codes[:-1]
    starts = np.flatnonzero(np.concatenate(([True], new if last is None else new | (last[1:] != last[:-1])))) if len(codes) else np.zeros(0, np.int64)
    sums = np.diff(np.append(starts, len(codes))) if counts is None else np.add.reduceat(counts, starts) if len(codes) else counts
    return codes[starts], None if last is None else last[starts], sums


class Gathered:
    """A task's phrases of a language with their counts, as numbers of its words."""

    def __init__(self, lang: str, size: int):
        self.table, self.size, self.parts, self.held = Numbers(lang), size, [], 0

    def add(self, number: np.ndarray, at: np.ndarray) -> None:
        codes = number[at]
        for k in range(1, min(self.size, 3)):
            codes = codes << WORD_BITS | number[at + k]
        self.parts.append(summed_up(codes, number[at + 3] if self.size > 3 else None, None))
        self.held += len(self.parts[-1][0])

    def full(self, most: int) -> bool:
        """Whether over `most` distinct phrases are held; they are merged whenever there are twice as many parts of them."""
        if self.held > 2 * most:
            self.merge()
            return self.held > most
        return False

    def merge(self) -> None:
        codes, last, counts = (None if p[0] is None else np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts = [summed_up(codes, last, counts)]
        self.held = len(self.parts[0][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            (codes, last, counts), keys = self.parts[0], np.array(self.table.keys, np.int64)
            words = [keys[codes >> WORD_BITS * k & (1 << WORD_BITS) - 1] for k in reversed(range(min(self.size, 3)))] + ([keys[last]] if self.size > 3 else [])
            yield pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(counts)], names=[*(f"w{k}" for k in range(self.size)), "f"])
            self.parts, self.held = [], 0


def phrase_counts(source: DataFrame, size: int, frequent) -> DataFrame:
    """(w0, .., f) of the phrases of `size` words of which both parts of `size` - 1 words may be frequent.

    A task numbers words as they come up, so phrases of up to three words are
    exact codes of 63 bits and a fourth word goes beside them; it sends each
    phrase once for about every PHRASES_HELD distinct ones.
    """

    def run(batches):
        ask = frequent.value
        known: dict[str, Gathered] = {}
        for block in blocks(batches):
            for lang, texts in by_language(block):
                words = tokens(b".".join(texts))
                for first in range(0, len(words), SLICE):
                    own = known.setdefault(lang, Gathered(lang, size))
                    part = words[first : first + SLICE + size - 1]
                    number = np.fromiter(map(own.table.__getitem__, part), np.int64, len(part))
                    if len(number) >= size:
                        at = np.flatnonzero(np.logical_and.reduce([number[k : len(number) - size + 1 + k] != 0 for k in range(size)]))
                        keys = np.array(own.table.keys, np.int64)
                        if size == 2:
                            may = ask.has(keys)
                            at = at[may[number[at]] & may[number[at + 1]]]
                        else:
                            for shift in (0, 1):
                                at = at[ask.has(phrase_keys([keys[number[at + k + shift]] for k in range(size - 1)]))]
                        if len(at):
                            own.add(number, at)
                    if own.full(PHRASES_HELD) or len(own.table) > WORDS_HELD:
                        yield from own.rows()
                    if len(own.table) > WORDS_HELD:
                        del known[lang]
        for own in known.values():
            yield from own.rows()

    names = [f"w{k}" for k in range(size)]
    schema = ", ".join(f"{c} bigint" for c in names) + ", f bigint"
    return source.mapInArrow(run, schema).groupBy(*names).agg(F.sum("f").alias("f"))


def level_tables(source: DataFrame, least: int = LEAST, longest: int = LONGEST, sent: int = KEYS_SENT) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and the tables of frequent phrases (w0, .., f) of 1 to `longest` words; the first also has lang and word."""
    words = checkpointed(word_counts(source))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level = words.filter(F.col("f") >= least).select(F.col("key").alias("w0"), "f", "lang", "word")
    if not level.groupBy("w0").count().filter("count > 1").isEmpty():
        raise ValueError("two frequent words have one 64-bit key")
    tables = [level]
    for size in range(2, longest + 1):
        asked = broadcast_keys(tables[-1], size - 1, sent)
        tables.append(checkpointed(phrase_counts(source, size, asked).filter(F.col("f") >= least)))
        asked.unpersist()
    return totals, tables


def phrases_of(tables: list[DataFrame]) -> DataFrame:
    """(words, f) of the frequent phrases of all levels, words as an array of keys."""
    out = None
    for size, table in enumerate(tables, 1):
        part = table.select(F.array(*(f"w{k}" for k in range(size))).alias("words"), "f")
        out = part if out is None else out.unionByName(part)
    return out


def by_key(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` with the one row of `table` for their key; no task meets all rows of a key that very many have."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return join_values(rows, checkpointed(counted.join(table, key)), key).drop("n")


def scored(tables: list[DataFrame]) -> DataFrame:
    """(words, a, l, r, score): each candidate that no longer phrase covers, by its lowest-scoring cut.

    A longer phrase that covers a candidate holds one a word longer that covers
    it as well, as counts only fall with length.
    """
    every = phrases_of(tables)
    longer = every.filter(F.size("words") > 2).select("f", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"))
    most = longer.groupBy("words").agg(F.max("f").alias("longer"))
    whole = every.filter(F.size("words") > 1).withColumnRenamed("f", "a").join(most, "words", "left")
    covered = F.coalesce(F.col("longer").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * COVERED, F.lit(False))
    left = checkpointed(whole.filter(~covered).select("words", "a").withColumn("id", F.monotonically_increasing_id()))
    cut = "transform(sequence(1, size(words) - 1), k -> named_struct('k', k, 'head', true, 'part', slice(words, 1, k)))"
    rest = "transform(sequence(1, size(words) - 1), k -> named_struct('k', k, 'head', false, 'part', slice(words, k + 1, size(words) - k)))"
    parts = checkpointed(left.select("id", "a", F.explode(F.expr(f"concat({cut}, {rest})")).alias("p")).select("id", "a", "p.k", "p.head", "p.part"))
    found = by_key(parts, every.withColumnRenamed("words", "part"), "part")
    cuts = found.groupBy("id", "a", "k").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    score = F.expr(f"cast(cast({SCALE} as decimal(20,0)) * a div (cast(l as decimal(20,0)) + r) as bigint)")
    least = cuts.withColumn("score", score).groupBy("id").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return left.join(least, "id").select("words", "a", "cut.l", "cut.r", "cut.score")


def leading(rows: DataFrame, top: int) -> DataFrame:
    """The rows (lang, score, a, ..) that may be among their language's first `top` by score and count, without sorting a language in one task.

    Each row has a class that rises with its score, and among rows of the
    highest possible score with its count; a language goes down to the class
    with which it has `top` rows.
    """
    fine = lambda c: F.floor(F.log(c.cast("double")) * CLASSES)
    classed = rows.withColumn("class", F.when(F.col("score") >= SCALE // 2, 100 * CLASSES + fine(F.col("a"))).otherwise(fine(F.col("score") + 1)))
    sizes = classed.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("lang").orderBy(F.desc("class")))
    lowest = sizes.withColumn("so_far", so_far).filter(F.col("so_far") >= top).groupBy("lang").agg(F.max("class").alias("lowest"))
    # a language without `top` rows has no lowest class
    return classed.join(F.broadcast(lowest), "lang", "left").filter(F.col("class") >= F.coalesce("lowest", "class")).drop("class", "lowest")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", sent: int = KEYS_SENT
) -> DataFrame:
    """Each language's best phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    A null language is `und`, together with rows that say so; a null or empty
    text has no words; repeated rows count as often as they stand; texts of any
    length are read whole; equal scores and counts go by the phrase's bytes; an
    empty table, or one without a frequent pair, gives no rows; further columns
    are not read.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    totals, tables = level_tables(source, least, longest, sent)
    found = checkpointed(scored(tables).withColumn("first", F.element_at("words", 1)))
    named = checkpointed(by_key(found, tables[0].select(F.col("w0").alias("first"), "lang"), "first").drop("first"))
    # only what may still be among the first by score and count gets its words' strings
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = checkpointed(leading(named, top).withColumn("place", F.rank().over(order)).filter(F.col("place") <= top).drop("place").withColumn("id", F.monotonically_increasing_id()))
    parts = checkpointed(best.select("id", F.posexplode("words").alias("k", "w0")))
    spelt = by_key(parts, tables[0].select("w0", "word"), "w0")
    phrases = spelt.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(phrases, "id").withColumn("rank", F.row_number().over(last).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
