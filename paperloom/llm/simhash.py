"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits that differ in at most three agree on three of six
blocks, so each distinct fingerprint is filed under its 20 choices of three
blocks (31 to 33 bits a key); pairs under one key are verified by their Hamming
distance. A key with many fingerprints is not paired: its fingerprints are filed
again under the 220 choices of nine of twelve blocks, whose groups have at most
2^18 members, and there neighbours are found by flipping up to three free bits.
Each group gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, join_values, map_texts
from .components import components

BITS, NEAR, SEED, SHINGLE = 64, 3, 42, 3
#: Fingerprints under one key that are compared with each other; larger groups take the finer keys.
PAIRED = 256


def shingles(text: str, size: int = SHINGLE) -> list[bytes]:
    """Space-joined runs of `size` words, A-Z lower-cased; fewer words make one run, none make none."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    if size == 3:
        return [b"%b %b %b" % w for w in zip(words, words[1:], words[2:])]  # noqa: B905
    return [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]


def fingerprints_of(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints: a bit is set where it is in over half of the shingles' hashes."""
    digest, counts, hashes = xxhash.xxh64_intdigest, [], []
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []

    def close():
        if held:
            ends = np.cumsum([counts[k] for k in held])
            bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, np.concatenate(([0], ends[:-1])), axis=0, dtype=np.int32)
            set_bits = sums * 2 > np.array([counts[k] for k in held])[:, None]
            out[held] = np.packbits(set_bits, axis=1).view(">u8").ravel()
            held.clear(), hashes.clear()

    for k, t in enumerate(texts):
        found = shingles(t, size)
        counts.append(len(found))
        if found:
            held.append(k)
            hashes.extend([digest(s, SEED) for s in found])
        if len(hashes) > 200_000:
            close()
    close()
    return out


def simhash(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): each row's fingerprint as a signed 64-bit integer; a text without words has 0."""
    return map_texts(docs, lambda: lambda texts: {"fp": fingerprints_of(texts, size).view(np.int64)}, "fp bigint", id_col, text_col, "id")


def masks(blocks: int, kept: int) -> list[int]:
    """Signed bit masks of all choices of `kept` of `blocks` blocks of the 64 bits."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    part = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
    whole = [sum(part[k] for k in c) for c in combinations(range(blocks), kept)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def filed(fingerprints: DataFrame, choice: list[int]) -> DataFrame:
    """(fp, c, k, n): each fingerprint under each key that n > 1 fingerprints share."""
    keys = F.array(*(F.struct(F.lit(c).cast("smallint").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, m in enumerate(choice)))
    rows = fingerprints.select("fp", F.explode(keys).alias("key")).select("fp", "key.c", "key.k")
    shared = rows.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(shared, ["c", "k"])


def local_roots(fps: np.ndarray) -> np.ndarray:
    """For sorted distinct fingerprints of one group the place of each one's root under links of at most three bits."""
    n = len(fps)
    label = np.arange(n)
    if n <= 2 * PAIRED:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= NEAR
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            new = new[new]
            if (new == label).all():
                return label
            label = new
    free = [b for b in range(BITS) if np.bitwise_or.reduce(fps ^ fps[0]) >> np.uint64(b) & np.uint64(1)]
    code = np.zeros(n, np.int64)
    for k, b in enumerate(free):
        code |= (fps >> np.uint64(b) & np.uint64(1)).astype(np.int64) << k
    flips = [sum(1 << b for b in c) for r in range(1, NEAR + 1) for c in combinations(range(len(free)), r)]
    if len(free) > 18:
        raise ValueError("the group's key leaves more than 18 bits free")
    place = np.full(1 << len(free), n, np.int64)
    place[code] = np.arange(n)
    while True:
        new = label.copy()
        for f in flips:
            other = place[code ^ f]
            new = np.minimum(new, np.append(new, n)[other])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(groups: DataFrame) -> DataFrame:
    """(u, v): from each group's list of fingerprints the links of its members to their roots."""

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for row in batch.column(0):
                fps = np.unique(np.asarray(row.values, np.int64).view(np.uint64))
                roots = local_roots(fps)
                moved = np.flatnonzero(roots != np.arange(len(fps)))
                us.append(fps[moved].view(np.int64))
                vs.append(fps[roots[moved]].view(np.int64))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return groups.select("fps").mapInArrow(run, "u bigint, v bigint")


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """(u, v) links that join the distinct fingerprints `fp` as all pairs within three bits do."""
    coarse = checkpointed(filed(fingerprints, masks(6, 3)))
    normal = coarse.filter(F.col("n") <= PAIRED).groupBy("c", "k").agg(F.collect_list("fp").alias("fps"))
    hot = checkpointed(coarse.filter(F.col("n") > PAIRED).select("fp").distinct())
    links = linked(normal)
    if not hot.isEmpty():
        fine = filed(hot, masks(12, 9)).groupBy("c", "k").agg(F.collect_list("fp").alias("fps"))
        links = links.unionByName(linked(fine))
    return links


def near_duplicates(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, `fingerprint` (16 hex digits), and `component_id`: the smallest id reachable over links.

    A null or wordless text has fingerprint zero, linked like any other;
    repeated rows are rows of one component; a null id is passed over as a
    smallest id unless all ids of a component are null; an empty table gives no
    rows; texts of any length are read whole; further columns are not read, and
    an id named like a column of the result is an error. Only distinct
    fingerprints are paired, so exact copies cost nothing.
    """
    if id_col in ("fingerprint", "component_id"):
        raise ValueError(f"the id column needs another name than {id_col}")
    marked = checkpointed(simhash(docs, size, id_col, text_col))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = checkpointed(components(fingerprint_links(distinct.select("fp"))))
    members = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    named = members.join(least, "root").select("fp", "least")
    of = checkpointed(distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_values(marked, of, "fp").select(F.col("id").alias(id_col), digits, "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: that of its smallest id (of equal ids, of the smallest text hash).

    Rows without an id are kept. A row that is repeated with id and text stays
    once. Null and wordless texts are one component. The columns are those of
    `docs`, whatever their names; an empty table stays empty.
    """
    names, k, rows = docs.columns, fresh(docs, "__key"), fresh(docs, "__rows")
    key = F.struct(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("h"))
    keyed = docs.filter(docs[id_col].isNotNull()).withColumn(k, key)
    labelled = near_duplicates(keyed.select(k, text_col), size, k, text_col)
    kept = labelled.filter(F.col(k) == F.col("component_id")).groupBy(k).agg(F.count(F.lit(1)).alias(rows))
    found = keyed.join(kept, k)
    once = found.filter(F.col(rows) == 1).select(names)
    repeated = found.filter(F.col(rows) > 1).dropDuplicates([k]).select(names)
    return once.unionByName(repeated).unionByName(docs.filter(docs[id_col].isNull()))
