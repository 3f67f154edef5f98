"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is a bag of itself and its character n-grams, hashed into buckets; the
buckets' embeddings are averaged and go through a linear softmax of two classes,
so misspelled and inflected words share the vectors of their n-grams. A document
is toxic if one of its words is: training takes the noisy-or over its words, so
only documents need labels, and a document's score is that of its most toxic
word, calibrated for the number of its distinct words, so that clean text
neither hides a toxic word nor adds up to one. Training hides words' own
buckets, misspells words and adds invented ones, so that the n-grams learn;
a word outside the sample only resembles a toxic one, so its odds are bounded.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bound_batches, crc_mod, map_texts, rewrite_rows

BUCKET_BITS, SIZE, NGRAMS = 18, 4, (3, 4, 5, 6)
#: Bounds of the training sample: labelled documents of each class, and characters in all.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 16_000_000
EPOCHS, BATCHES, RATE, DECAY, PRIOR = 6, 24, 0.05, 1e-3, -5.0
#: Shares of a word's occurrences as it is and without its own bucket (the rest is misspelt, in so many ways); invented words; unexplained toxic labels; distinct words that cost nothing.
PLAIN, HIDDEN, MISSPELT, INVENTED, LEAK, FREE = 0.15, 0.15, 8, 20_000, 0.3, 30
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: The highest logit of a word that the training sample lacks: it may be a clean word that looks like a misspelt toxic one (lose, path).
UNSEEN = 2.0

#: Letters and digits with at least one letter.
WORD = re.compile(r"\d*[^\W\d_][^\W_]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str], own: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(places of words, buckets) of all words' bags; a word stands between < and >, and is in its own bag only with `own`."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(codes))  # characters from here to the word's end
    owners, buckets = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            owners.append(owner[at])
            buckets.append((h[at] + np.uint64(n)) * _MIX >> np.uint64(64 - BUCKET_BITS))
    # the word itself, by a sum of its characters with weights of their places
    if len(words) and own:
        place = np.arange(len(codes)) - (ends - sizes)[owner]
        whole = np.add.reduceat(codes * (place.astype(np.uint64) * _MIX | np.uint64(1)), ends - sizes)
        owners.append(np.arange(len(words)))
        buckets.append((whole ^ whole >> np.uint64(31)) * _MIX >> np.uint64(64 - BUCKET_BITS))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


class Bags:
    """The bags of many words, one behind the other."""

    def __init__(self, words: list[str], own: bool):
        counts, buckets = [], []
        for k in range(0, len(words), 20_000):
            owner, bucket = subwords(words[k : k + 20_000], own)
            counts.append(np.bincount(owner, minlength=len(words[k : k + 20_000])))
            buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        self.counts, self.buckets = np.concatenate(counts), np.concatenate(buckets)
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and buckets of the words' bags."""
        n = self.counts[words]
        return n, self.buckets[np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def misspelt(word: str, rng: random.Random) -> str:
    """The word with a letter left out, doubled or swapped with the next; a word of one or two letters stays."""
    if len(word) < 3:
        return word
    k, how = rng.randrange(len(word)), rng.randrange(3)
    if how == 0:
        return word[:k] + word[k + 1 :]
    if how == 1:
        return word[:k] + word[k] + word[k:]
    k = min(k, len(word) - 2)
    return word[:k] + word[k + 1] + word[k] + word[k + 2 :]


def invented(words: list[str], n: int, rng: random.Random) -> list[str]:
    """`n` words that stand for all that the sample lacks: half of letters at random, half of letters as they follow one another in the words."""
    letters = sorted({c for w in words[:50_000] for c in w})
    follow: dict[str, str] = {}
    for w in words[:50_000]:
        for a, b in zip("<" + w, w + ">", strict=True):
            follow[a] = follow.get(a, "") + b if len(follow.get(a, "")) < 2000 else follow[a]
    out = []
    while len(out) < n:
        if len(out) % 2:
            out.append("".join(rng.choice(letters if rng.random() < 0.1 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 12))))
            continue
        w, c = "", rng.choice(follow["<"])
        while c != ">" and len(w) < 14:
            w, c = w + c, rng.choice(follow[c])
        out.append(w or "a")
    return out


@dataclass
class Model:
    """A trained model; since averaging and softmax's logit are linear, each bucket's share of the logit is one number.

    `known` are the words of the sample with a logit over UNSEEN.
    """

    share: np.ndarray
    bias: float
    known: frozenset[str] = frozenset()

    def logits(self, words: list[str]) -> np.ndarray:
        """The toxic class's logit of each word."""
        if not words:
            return np.zeros(0)
        owner, bucket = subwords(words)
        z = np.bincount(owner, self.share[bucket], len(words)) / np.bincount(owner, minlength=len(words)) + self.bias
        for k in np.flatnonzero(z > UNSEEN).tolist():
            if words[k] not in self.known:
                z[k] = UNSEEN
        return z


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Fit embeddings and softmax jointly, by Adam on minibatches of documents; every word of the sample takes part.

    So that n-grams carry the weight and not words by heart, a word's own bucket
    is hidden in half of its occurrences and a misspelling stands for it in a
    third; each minibatch also holds invented words, all clean. A share LEAK of
    the toxic label is left unexplained, as some documents are labelled wrongly.
    """
    y = np.array(labels, float)
    number: dict[str, int] = {}
    bags = [np.array(sorted({number.setdefault(w, len(number)) for w in WORD.findall(t.lower())}), np.int32) for t in texts]
    if not number or len(set(labels)) < 2:
        return Model(np.zeros(1 << BUCKET_BITS), PRIOR)
    words = list(number)
    own_rng = random.Random(seed)
    forms = [Bags(words, True), Bags(words, False), *(Bags([misspelt(w, own_rng) for w in words], False) for _ in range(MISSPELT))]
    shares = [PLAIN, HIDDEN, *[(1 - PLAIN - HIDDEN) / MISSPELT] * MISSPELT]
    made = Bags(invented(words, INVENTED, own_rng), True)
    del number
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (1 << BUCKET_BITS, SIZE)).astype(np.float32), rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32), np.array([0.0, PRIOR], np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for docs in np.array_split(rng.permutation(len(bags)), min(BATCHES, len(bags))):
            step += 1
            table, out, bias = params
            word, inverse = np.unique(np.concatenate([bags[k] for k in docs.tolist()]), return_inverse=True)
            if not len(word):
                continue
            doc = np.repeat(np.arange(len(docs)), [len(bags[k]) for k in docs.tolist()])
            form = rng.choice(len(forms), len(word), p=shares)
            order = np.argsort(form, kind="stable")
            parts = [bags_of.of(word[form == f]) for f, bags_of in enumerate(forms)]
            parts.append(made.of(rng.integers(0, INVENTED, len(word) // 4 + 1)))
            n, entry = (np.concatenate(p) for p in zip(*parts, strict=True))
            heads = np.cumsum(n) - n
            mean = np.add.reduceat(table[entry], heads) / n[:, None].astype(np.float32)
            z = mean @ out + bias
            p_all = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))
            p = np.empty(len(word))
            p[order] = p_all[: len(word)]
            clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-6))[inverse], len(docs)) + np.log1p(-LEAK)  # log of the chance that no word is toxic
            some = -np.expm1(clean)
            pull = weight[docs] * np.where(y[docs] == 1, -np.exp(clean) / some, 1.0)
            g = np.empty(len(n))
            g[: len(word)] = (np.bincount(inverse, pull[doc], len(word)) * p)[order]
            g[len(word) :] = p_all[len(word) :]  # every invented word is a clean document of its own
            dz = (np.stack((-g, g), 1) / len(docs)).astype(np.float32)
            each = np.repeat(dz @ out.T / n[:, None], n, 0)
            grad = np.stack([np.bincount(entry, each[:, k], 1 << BUCKET_BITS) for k in range(SIZE)], 1).astype(np.float32)
            for k, d in enumerate((grad + DECAY * table / len(y), mean.T @ dz + DECAY * out / len(y), dz.sum(0))):
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                params[k] = params[k] - np.float32(RATE / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    table, out, bias = params
    share, bias = (table @ (out[:, 1] - out[:, 0])).astype(float), float(bias[1] - bias[0])
    z = np.add.reduceat(share[forms[0].buckets], forms[0].starts) / forms[0].counts + bias
    return Model(share, bias, frozenset(words[k] for k in np.flatnonzero(z > UNSEEN).tolist()))


class Scorer:
    """Scores of texts, with a memo table over words as they stand between white space."""

    def __init__(self, model: Model):
        self.model = model
        self.memo = Memo(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[float]:
        found = [WORD.findall(c) for c in chunks]
        words = sorted({w for ws in found for w in ws})
        z = dict(zip(words, self.model.logits(words).tolist(), strict=True))
        return [max((z[w] for w in ws), default=-745.0) for ws in found]

    def scores(self, texts: list[str]) -> list[float]:
        """0 to 1: the most toxic word's odds, divided by the number of distinct words over FREE, as the greatest of many clean words' odds grows with their number; a text without words has 0."""
        cut = [set(t.lower().split()) for t in texts]
        table = self.memo.of(*cut)
        logits = [max(map(table.__getitem__, chunks), default=-745.0) - math.log(max(len(chunks) / FREE, 1.0)) for chunks in cut]
        return [float(1 / (1 + math.exp(min(-z, 700)))) if chunks else 0.0 for z, chunks in zip(logits, cut, strict=True)]


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = SAMPLE_DOCS) -> DataFrame:
    """(text, y) of at most `limit` held-in documents of each class, one partition in the order of a hash of their ids.

    Of an id's several texts the one of the least hash is taken. Only ids and
    labels are read to choose; their count bounds what is broadcast.
    """
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_mod(F.col(id_col), FOLDS) != HELD_OUT))
    known = own.groupBy(id_col).agg(F.max(label_col).alias("y")).join(docs.select(id_col).distinct(), id_col, "left_semi")
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(order, id_col).limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    own_text = F.min(F.struct(F.xxhash64(text_col), F.col(text_col).alias("text"))).alias("one")
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(own_text, F.first("y").cast("int").alias("y"))
    return found.repartition(1).sortWithinPartitions(order, id_col).select(F.col("one.text").cast("string").alias("text"), "y")


def first_chars(rows: Iterable[tuple[str | None, int]], chars: int) -> tuple[list[str], list[int]]:
    """Texts and labels of the first rows, about `chars` characters of them."""
    texts, ys, size = [], [], 0
    for text, y in rows:
        texts.append(text or "")
        ys.append(y)
        size += len(texts[-1])
        if size >= chars:
            break
    return texts, ys


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `limit` held-in documents of each class and about `chars` characters, as the model is trained on."""
    return first_chars(map(tuple, sample_rows(docs, labels, id_col, text_col, label_col, limit).toLocalIterator()), chars)


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """The model of the bounded sample, trained by one task, so that the driver gets neither texts nor what training takes, but one number for each bucket and the toxic words."""
    bound_batches(docs.sparkSession)

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = train(*first_chars(rows, SAMPLE_CHARS))
        known = pa.array([sorted(model.known)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([model.share.tobytes()], pa.binary()), pa.array([model.bias]), known], names=["share", "bias", "known"])

    made = sample_rows(docs, labels, id_col, text_col, label_col).mapInArrow(run, "share binary, bias double, known array<string>").collect()
    return Model(np.frombuffer(made[0].share), made[0].bias, frozenset(made[0].known)) if made else train([], [])


def _scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, id_col, text_col, label_col))
    return lambda: Scorer(model.value).scores


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """Per document `held_out`, `score` and `predicted`; the text alone decides the score.

    Trained on labelled rows whose crc32(id as text) mod 4 is not 2. Labels
    other than 0 and 1 and labels of unknown ids are passed over; an id labelled
    twice counts as toxic if once so; without labels of both classes every score
    is low. Null and empty texts have score 0; a null id is not held out;
    repeated rows give repeated rows; an empty table gives no rows; a text of
    any length is read whole, and of many distinct words the most toxic one must
    stand out further, so a misspelling is found among up to about 500 distinct words; of equally toxic words it does not matter which counts; further columns are not read.
    """
    make = _scorer(docs, labels, id_col, text_col, label_col)

    def scores():
        score = make()
        return lambda texts: {"score": score(texts)}

    out = map_texts(docs, scores, "score double", id_col, text_col)
    held = F.coalesce(crc_mod(F.col(id_col), FOLDS) == HELD_OUT, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows whose score reaches the threshold; no shuffle of texts.

    Rows with null or empty texts stay; repeated rows fare alike; further columns stay, whatever their names.
    """
    make = _scorer(docs, labels, id_col, text_col, label_col)

    def keep():
        score = make()
        return lambda texts: {"keep": [s < threshold for s in score(texts)]}

    return rewrite_rows(docs, keep, text_col)
