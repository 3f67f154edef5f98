"""N-gram Jaccard join by adaptive multi-match prefixes.

A document's set are the hashes of its distinct word shingles, in one order of
all shingles: rare ones first, by counts that a fixed-size table of buckets
keeps of the whole corpus. Documents that link share at least t shingles, and
if both take the first n - t + m of their own, they share m of these. Every
document chooses its own m: a longer prefix costs more rows but leaves fewer
candidates, as each must be met m times; of a pair the smaller m holds. Pairs
that pass sizes, places, matches and bit signatures are verified on their whole
sets.

Very common shingles would bring about all pairs of a large group of near
copies. So the members of a large group are first compared with one of them, a
few times; documents found linked are one component, and the join then looks
only at pairs of different components, which loses no link between components.

Members that resemble the one but do not link with it would still bring about
all pairs with the rest. The one becomes the home of all that resemble it, and
of these only the differences from the home's most central member are joined:
two sets differ in what one of their differences has and the other lacks, so a
pair that links, of which at most one links with the centre, shares many
shingles of its differences, most of them rare. Pairs of one home are met by
differences alone, all others by prefixes.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import KEPT_CHARS, MEMO_ENTRIES, blocks, bound_batches, checkpointed, join_values
from .components import components

SIZE, SIMILAR = 5, 80
#: The counting table: 2^22 buckets in 64 parts of 256 KB.
BUCKET_BITS, PARTS = 22, 64
#: The most matches that a document asks for, and the cost of a prefix row, a met row and a verified shingle.
MATCHES, ROW_COST, MET_COST, VERIFY_COST = 4, 8.0, 1.0, 0.02
#: Documents under one shingle that are paired at once; larger groups are first thinned, this many times.
PAIRED, THINNED = 64, 2
#: Hundredths of similarity from which on a document may be at home with another.
HOME = 50
#: Rows of one shingle that may meet in one task, or twice the mean of a bucket.
COMMON = 4096
#: Bits of a place in a prefix; sets may have 2^31 shingles.
PLACE_BITS = 29
#: Documents whose ids are broadcast to fetch their texts (40 bytes each); more of them are joined by a shuffle.
FETCHED = 200_000
_P, _Q = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _Q
    h = (h ^ h >> np.uint64(29)) * _P
    return h ^ h >> np.uint64(32)


class WordHashes(dict):
    """Hashes of words as they come up; very long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= KEPT_CHARS:
            self[word] = h
        return h


class Shingler:
    """Sets of shingle hashes of texts, with a table of word hashes that begins anew when it is full."""

    def __init__(self, size: int = SIZE):
        self.size, self.hashes = size, WordHashes()

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its sorted distinct hashes: of all runs of `size` words, or of fewer words as one run."""
        words = [t.encode("utf-8", "replace").lower().split() for t in texts]
        if len(self.hashes) > MEMO_ENTRIES:
            self.hashes.clear()
        counts = [len(w) for w in words]
        flat = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(words)), np.uint64, sum(counts))
        runs = np.zeros(max(len(flat) - self.size + 1, 0), np.uint64)
        for k in range(self.size):
            runs = runs * _P + flat[k : k + len(runs)] + np.uint64(1)
        runs = _mixed(runs)
        out, at = [], 0
        for n in counts:
            if n >= self.size:
                out.append(np.unique(runs[at : at + n - self.size + 1]))
            elif n:
                h = np.zeros(1, np.uint64)
                for w in flat[at : at + n]:
                    h = h * _P + w + np.uint64(1)
                out.append(_mixed(h + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


def signature(found: np.ndarray) -> list[int]:
    """Parities of the hashes in 512 buckets, as eight numbers: two sets differ in at least as many shingles as their signatures in bits."""
    odd = np.bincount((found & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def digest(found: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else b""


def _texts(block: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in block.column(column).to_pylist()]


def marks_and_counts(source: DataFrame, size: int) -> DataFrame:
    """Rows (id, n, d, bits) of documents, and rows (part, counts) of the bucket counts of a task, in one pass over the texts."""

    def run(batches):
        shingler, table = Shingler(size), np.zeros(1 << BUCKET_BITS, np.int32)
        kind = None
        for block in blocks(batches):
            kind = block.column(0).type
            sets = shingler.sets(_texts(block, 1))
            if sets:
                np.add.at(table, (np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            m = len(sets)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([signature(s) for s in sets], pa.list_(pa.int64())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=["id", "n", "d", "bits", "part", "counts"],
            )
        if kind is not None:
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(table, PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(PARTS, kind), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.nulls(PARTS, pa.list_(pa.int64())), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())],
                names=["id", "n", "d", "bits", "part", "counts"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n bigint, d binary, bits array<bigint>, part int, counts binary")


def bucket_counts(parts: DataFrame) -> np.ndarray:
    """The counts of all tasks added up; executors add in a stream, the driver gets one table of a fixed size."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(counts), np.int32)
                sums[part] = sums[part] + own if part in sums else own.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()])], names=["part", "counts"])

    table = np.zeros((PARTS, (1 << BUCKET_BITS) // PARTS), np.int64)
    for r in parts.repartition("part").mapInArrow(add, "part int, counts binary").collect():
        table[r.part] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return table.ravel()


def prefix(found: np.ndarray, counts: np.ndarray, noise: float, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray, int]:
    """A set's prefix in the order of all shingles, its counts, and the matches m that it asks for.

    m is what costs least by estimate: rows of the prefix, rows met under its
    shingles (counts above a bucket's mean), and candidates, of which there are
    at most as many as met rows by m, each to be verified on n shingles.
    """
    n = len(found)
    seen = counts[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.argsort(seen, kind="stable")  # equal counts in the order of the hashes
    spare = n * (100 - similar) // 100  # what a set may lack of any partner's
    most = min(MATCHES, n - spare)
    met = np.cumsum(np.maximum(seen[order[: spare + most]] - noise - 1, 0))
    m = np.arange(1, most + 1)
    cost = (spare + m) * ROW_COST + met[spare + m - 1] * (MET_COST + VERIFY_COST * n / m)
    best = int(np.argmin(cost)) + 1
    order = order[: spare + best]
    return found[order], seen[order], best


def prefixes(source: DataFrame, size: int, counts, noise: float, similar: int, common: int) -> DataFrame:
    """(d, m, prefix, rare) of each document with words: the first `rare` shingles of the prefix were seen at most `common` times."""

    def run(batches):
        shingler, table = Shingler(size), counts.value
        for block in blocks(batches, 0):
            sets = [s for s in shingler.sets(_texts(block, 0)) if len(s)]
            chosen = [prefix(s, table, noise, similar) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([digest(s) for s in sets], pa.binary()),
                    pa.array([m for _, _, m in chosen], pa.int32()),
                    pa.array([p.view(np.int64) for p, _, _ in chosen], pa.list_(pa.int64())),
                    pa.array([int(np.searchsorted(c, common, side="right")) for _, c, _ in chosen], pa.int32()),
                ],
                names=["d", "m", "prefix", "rare"],
            )

    return source.select("text").mapInArrow(run, "d binary, m int, prefix array<bigint>, rare int")


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose token another row has; a task streams through its sorted rows."""

    def run(batches):
        held = None  # the last row so far, and whether it has been passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            before = np.concatenate(([held is not None and held[0].column(0)[0].as_py() == token[0]], token[1:] == token[:-1]))
            keep = before | np.append(before[1:], False)
            if before[0] and not held[1]:
                yield held[0]
            held = batch.slice(batch.num_rows - 1, 1), bool(keep[-1])
            yield batch.filter(pa.array(keep))

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, rows.schema)


def shared_rows(chosen: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """(token, node, size, m, place, layer): prefix rows whose shingle several sets may have in their prefixes.

    `layer` is the least m whose prefix holds the row. A bucket's count is never
    below that of any shingle in it, so rare shingles have no more rows than
    that, and those alone are dropped where they meet; rows of fuller buckets all
    stay, so no shingle's rows need to meet in one task.
    """
    once = chosen.groupBy("d").agg(*(F.first(c).alias(c) for c in ("m", "prefix", "rare")))
    rows = once.join(classes.select("d", "node", "size"), "d").select("node", "size", "m", "rare", F.posexplode("prefix").alias("place", "token"))
    # size, place and m in one number, as every row is exchanged
    thin = rows.filter("place < rare").select("token", "node", F.expr(f"size << {PLACE_BITS + 3} | cast(place as bigint) << 3 | m").alias("packed"))
    back = {"size": f"packed >> {PLACE_BITS + 3}", "m": "cast(packed & 7 as int)", "place": f"cast(packed >> 3 & {(1 << PLACE_BITS) - 1} as int)"}
    few = repeated(thin).select("token", "node", *(F.expr(e).alias(c) for c, e in back.items()))
    every = few.unionByName(rows.filter("place >= rare").select("token", "node", "size", "m", "place"))
    return every.withColumn("layer", F.greatest(F.lit(1), F.expr(f"place + 1 - size * {100 - similar} div 100")).cast("int"))


def attached(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """`rows` with the one row of `values` for their key: by broadcast if `values` has at most FETCHED rows, else so that no key's rows meet in one task."""
    if values.count() <= FETCHED:
        return rows.join(F.broadcast(values), key)
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return join_values(rows, checkpointed(many.join(values, key)), key).drop("n")


def may_be_near(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """The pairs (u, v) whose sizes and signatures leave room for a link."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    own = checkpointed(classes.join(nodes, "node").select("node", F.struct("size", "bits").alias("own")))
    for end in ("u", "v"):
        pairs = attached(pairs, own.select(F.col("node").alias(end), F.col("own").alias(f"_{end}")), end)
    differ = F.aggregate(F.zip_with("_u.bits", "_v.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # sets of a and b shingles that share c differ in a + b - 2 c, and 100 c >= similar * (a + b - c)
    total = F.col("_u.size") + F.col("_v.size")
    return pairs.filter(differ * (100 + similar) <= total * (100 - similar)).select("u", "v")


def may_link(similar: int) -> str:
    """SQL: sizes and the places of a shared shingle of a and b leave room for a link."""
    room = "least(a.place, b.place) + least(a.size - a.place, b.size - b.place)"
    return f"least(a.size, b.size) * 100 >= greatest(a.size, b.size) * {similar} and ({room}) * {100 + similar} >= (a.size + b.size) * {similar}"


def whole_sets(source: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, found): the whole set, as bytes, of each of `nodes` (node, first, d), once from each task that meets it (a repeated row may be met by several)."""

    def run(batches):
        shingler, given = Shingler(size), set()
        for block in blocks(batches, 0):
            sets = [(digest(s), s.tobytes()) for s in shingler.sets(_texts(block, 0))]
            new = dict(item for item in sets if item[0] not in given)
            given.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], names=["d", "found"])

    nodes = checkpointed(nodes)
    few = nodes.count() <= FETCHED
    near = F.broadcast if few else (lambda df: df)
    ids = near(nodes.select(F.col("first").alias("id")).distinct())
    texts = source.alias("s").join(ids.alias("i"), F.expr("s.id <=> i.id"), "left_semi").select("text")
    return texts.mapInArrow(run, "d binary, found binary").join(near(nodes.select("node", "d")), "d").select("node", "found")


def oriented(pairs: DataFrame) -> DataFrame:
    """The pairs with the member of more pairs as u, so that its set is sent to its partners and not theirs to it."""
    pairs = checkpointed(pairs.select("u", "v"))
    ends = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("times")))
    for end in ("u", "v"):
        pairs = attached(pairs, ends.select(F.col("end").alias(end), F.col("times").alias(f"{end}s")), end)
    turned = F.col("vs") > F.col("us")
    return pairs.select(F.when(turned, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("v"))


def compared(pairs: DataFrame, classes: DataFrame, source: DataFrame, size: int, similar: int, look, schema: str) -> DataFrame:
    """What `look` gives for a set and a list of partners (own, [(u, v, other)]), of the distinct pairs (u, v) that may be as similar.

    A set travels once for each pair in which it is v; u's set goes once to each
    of up to 64 salted parts of its partners, where rows are compared in a
    stream.
    """
    pairs = checkpointed(may_be_near(pairs, classes, similar).select("u", "v", F.pmod(F.xxhash64("v"), F.lit(64)).alias("salt")))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = checkpointed(whole_sets(source, classes.select("node", "first", "d").join(nodes, "node"), size))
    second = pairs.select("u", "salt", F.lit(1).alias("side"), F.col("v").alias("node"))
    first = pairs.select("u", "salt").distinct().select("u", "salt", F.lit(0).alias("side"), F.col("u").alias("node"))
    dealt = first.unionByName(second).join(sets, "node").select("u", "salt", "side", "node", "found").repartition("u", "salt").sortWithinPartitions("u", "salt", "side")
    names = T.StructType.fromDDL(schema)

    def run(batches):
        held, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for u, salt, side, node, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = np.frombuffer(found, np.uint64)
                if not side:
                    held, own = (u, salt), other
                    continue
                if held != (u, salt):
                    raise ValueError("a pair came without its first set")
                made = look(own, other)
                if made is not None:
                    rows.append((u, node, *made))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, names, strict=True)], names=names.names)

    return dealt.mapInArrow(run, schema)


def linked(own: np.ndarray, other: np.ndarray, similar: int) -> bool:
    """Whether two sets are similar enough."""
    both = len(np.intersect1d(own, other, assume_unique=True))
    return 100 * both >= similar * (len(own) + len(other) - both)


def verified(pairs: DataFrame, classes: DataFrame, source: DataFrame, size: int, similar: int) -> DataFrame:
    """(u, v) of the distinct pairs (u, v) whose sets are similar enough."""
    return compared(pairs, classes, source, size, similar, lambda own, other: () if linked(own, other, similar) else None, "u bigint, v bigint")


def shown(own: np.ndarray, gone: np.ndarray, n: int, h: int, counts: np.ndarray, most: int, similar: int) -> tuple[bool, int, int, int, np.ndarray]:
    """Of a set of n shingles that has `own` and lacks `gone` of a home of h: whether they link, the size of the difference, how many of it to show to sets that don't and that do link with the home, and those, rare ones first.

    Let a and b be the sizes of two sets with differences of d and e shingles, c
    of them in both, and r = (100 - similar) / (100 + similar). The two link if
    d + e - 2 c <= (a + b) r. With a partner that does not link with the home,
    e > (b + h) r, so c > (d + (h - a) r) / 2. With one that does and as c <= e,
    c >= d - (a + b) r, where b is at most 100 a / similar. All but c - 1
    shingles of each difference, in one order, then share one.
    """
    apart = np.concatenate((own, gone))
    d = len(apart)
    links = d * (100 + similar) <= (n + h) * (100 - similar)
    to_far = (d * (100 + similar) + (h - n) * (100 - similar)) // (2 * (100 + similar)) + 1
    to_near = d - n * (100 - similar) // similar
    far, near = (max(0, min(d, d + 1 - c)) for c in (to_far, to_near))
    near = 0 if links else near
    # about as many lack a shingle of the home as `most` is above its count
    seen = counts[(apart >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.int64)
    seen[len(own) :] = most - seen[len(own) :]
    return links, d, far, near, apart[np.lexsort((apart, seen))[: max(far, near)]]


def differences(pairs: DataFrame, classes: DataFrame, source: DataFrame, size: int, similar: int, counts) -> DataFrame:
    """(u, v, h, most, n, own, gone) of the distinct pairs (u, v) that are similar enough for v to be at home with u: u's size and its highest count, v's size, what v has and what it lacks of u."""

    def look(own, other):
        if not linked(own, other, similar):
            return None
        most = int(counts.value[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].max())
        return len(own), most, len(other), *(np.setdiff1d(*x, assume_unique=True).view(np.int64).tolist() for x in ((other, own), (own, other)))

    return compared(pairs, classes, source, size, similar, look, "u bigint, v bigint, h bigint, most bigint, n bigint, own array<bigint>, gone array<bigint>")


def with_homes(found: DataFrame) -> DataFrame:
    """(home, most, node, n, own, gone): each node with the home that it differs least from; a home is its own."""
    none = F.array().cast("array<bigint>")
    selves = found.groupBy("u").agg(F.first("most").alias("most"), F.first("h").alias("n")).select("u", "most", F.col("u").alias("v"), "n", none.alias("own"), none.alias("gone"))
    every = found.drop("h").unionByName(selves)
    best = F.min_by(F.struct(F.col("u").alias("home"), "most", "n", "own", "gone"), F.struct(F.size("own") + F.size("gone"), "u"))
    return every.groupBy(F.col("v").alias("node")).agg(best.alias("o")).select("o.home", "o.most", "node", "o.n", "o.own", "o.gone")


def centred(homes: DataFrame, counts, similar: int) -> DataFrame:
    """(home, centre, node, links, n, d, far, near, apart): the difference of each node from the centre of its home.

    That is the node that differs least from the shingles that most nodes of the
    home have; the closer it is, the fewer shingles do all differences share.
    """
    apart = F.concat("own", "gone")
    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("nodes"))
    often = homes.select("home", F.explode(apart).alias("token")).groupBy("home", "token").agg(F.count(F.lit(1)).alias("times"))
    usual = checkpointed(often.join(F.broadcast(sizes), "home").filter("2 * times > nodes").groupBy("home").agg(F.collect_list("token").alias("usual")))
    off = F.when(F.col("usual").isNull(), F.size(apart)).otherwise(F.size(apart) + F.size("usual") - 2 * F.size(F.array_intersect(apart, "usual")))
    best = F.min_by(F.struct(F.col("node").alias("centre"), F.col("n").alias("h"), F.col("own").alias("c_own"), F.col("gone").alias("c_gone")), F.struct(off, "node"))
    centres = checkpointed(homes.join(F.broadcast(usual), "home", "left").groupBy("home").agg(best.alias("c"), F.count(F.lit(1)).alias("nodes")))
    rows = attached(homes, centres.select("home", "c.*"), "home")
    has = F.concat(F.array_except("own", "c_own"), F.array_except("c_gone", "gone"))
    lacks = F.concat(F.array_except("c_own", "own"), F.array_except("gone", "c_gone"))
    rows = rows.select("home", "centre", "node", "n", "h", "most", has.alias("has"), lacks.alias("lacks"))

    def run(batches):
        for batch in batches:
            made = [[] for _ in range(5)]
            for n, h, most, own, gone in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                own, gone = (np.array(x, np.int64).view(np.uint64) for x in (own, gone))
                for to, value in zip(made, shown(own, gone, n, h, counts.value, most, similar), strict=True):
                    to.append(value)
            links, d, far, near, apart = made
            columns = [pa.array(links, pa.bool_()), pa.array(d, pa.int64()), pa.array(far, pa.int32()), pa.array(near, pa.int32()), pa.array([x.view(np.int64) for x in apart], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["home", "centre", "node", "n", "links", "d", "far", "near", "apart"])

    return rows.mapInArrow(run, "home bigint, centre bigint, node bigint, n bigint, links boolean, d bigint, far int, near int, apart array<bigint>")


def near_in_homes(homes: DataFrame, roots: DataFrame, similar: int) -> DataFrame:
    """(u, v) of different components and one home that may link, by what their differences from its centre share."""
    rows = with_roots(homes, roots).filter("far > 0 or near > 0").select("home", "node", "root", "links", "n", "d", "far", "near", F.posexplode("apart").alias("place", "token"))
    mixed = rows.groupBy("home", "token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("links").alias("all_link")).filter("low <> high and not all_link").select("home", "token")
    rows = checkpointed(rows.join(mixed, ["home", "token"]))
    room = "least(a.place, b.place) + least(a.d - a.place, b.d - b.place)"
    shares = f"(a.d + b.d - 2 * ({room})) * {100 + similar} <= (a.n + b.n) * {100 - similar}"
    allowed = "a.place < if(b.links, a.near, a.far) and b.place < if(a.links, b.near, b.far)"
    met = rows.filter("not links").alias("a").join(rows.alias("b"), F.expr(f"a.home = b.home and a.token = b.token and a.root <> b.root and (b.links or a.node < b.node) and {allowed} and {shares}"))
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """`rows` with the component of their node so far."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def mixed_groups(rows: DataFrame) -> DataFrame:
    """Of rows (token, root, ..) those whose token's rows are of several components, with their number n."""
    groups = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("token", "n")
    return join_values(rows, checkpointed(groups), "token")


def mixed_homes(rows: DataFrame) -> DataFrame:
    """Of rows (token, root, home, ..) those whose token's rows are of several components and homes, with the home `top` of most of them."""
    by_home = rows.groupBy("token", "home").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    groups = by_home.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("homes"), F.sum("n").alias("n"), F.max_by("home", F.struct("n", "home")).alias("top"))
    return join_values(rows, checkpointed(groups.filter("low <> high and homes > 1").select("token", "n", "top")), "token").drop("n")


def set_links(shared: DataFrame, classes: DataFrame, source: DataFrame, size: int, similar: int, counts, paired: int = PAIRED, thinned: int = THINNED) -> DataFrame:
    """(u, v) links between different sets that join them as all links do."""
    links, roots, homes = None, None, None
    for turn in range(thinned):
        rest = shared if homes is None else shared.join(homes.select("node"), "node", "left_anti")
        large = checkpointed(mixed_groups(with_roots(rest, roots)).filter(F.col("n") > paired).drop("n"))
        if large.isEmpty():
            break
        # a document whose prefix has the most shingles of large groups differs least from the others; later turns take any
        best = F.struct(F.lit(0) if turn else -F.col("common"), F.xxhash64("node", F.lit(turn)))
        large = large.withColumn("common", F.lit(0)) if turn else checkpointed(attached(large, large.groupBy("node").agg(F.count(F.lit(1)).alias("common")), "node"))
        hubs = checkpointed(large.groupBy("token").agg(F.min_by("node", best).alias("u"), F.count(F.lit(1)).alias("n")))
        pairs = join_values(large.select("token", "node"), hubs, "token").filter("u <> node").select("u", F.col("node").alias("v")).distinct()
        found = with_homes(checkpointed(differences(pairs, classes, source, size, min(HOME, similar), counts)))
        found = checkpointed(centred(checkpointed(found), counts, similar))
        new = found.filter("links and node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v"))
        links = new if links is None else links.unionByName(new)
        roots = checkpointed(components(links))
        homes = found if homes is None else homes.unionByName(found)
    rows = with_roots(shared, roots)
    rows = rows.withColumn("home", F.col("node")) if homes is None else rows.join(homes.select("node", "home"), "node", "left").withColumn("home", F.coalesce("home", "node"))
    rows = checkpointed(mixed_homes(checkpointed(rows)))
    # of a pair of different homes at most one is of the home that most rows of the shingle have
    once = "(b.home = b.top or a.node < b.node)"
    met = rows.filter("home <> top").alias("a").join(rows.alias("b"), F.expr(f"a.token = b.token and {once} and a.root <> b.root and a.home <> b.home and a.layer <= b.m and b.layer <= a.m and {may_link(similar)}"))
    ends = F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")
    last = met.select(*ends, F.least("a.m", "b.m").alias("m")).groupBy("u", "v", "m").agg(F.count(F.lit(1)).alias("matches")).filter("matches >= m").select("u", "v")
    if homes is not None:
        last = last.unionByName(near_in_homes(homes, roots, similar)).distinct()
    last = verified(oriented(last), classes, source, size, similar)
    return last if links is None else links.unionByName(last)


def jaccard_components(docs: DataFrame, size: int = SIZE, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED, thinned: int = THINNED) -> DataFrame:
    """Per row its id, `n_shingles` and `component_id`, the smallest id reachable over links of at least `similar` hundredths.

    A text of fewer than `size` words is one shingle; a null text or one without
    words has none and links with nothing, so its component is its own id.
    Equal sets are one set with several documents, whose copies cost nothing.
    Repeated rows are rows of one component; a null id is passed over as a
    smallest id unless all ids of a component are null; an empty table gives no
    rows; texts of any length are read whole; further columns are not read, and
    an id named like a column of the result is an error. Shingles count as equal
    by 64 bits of hash, sets by 128.
    """
    if id_col in ("n_shingles", "component_id"):
        raise ValueError(f"the id column needs another name than {id_col}")
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    first_pass = checkpointed(marks_and_counts(source, size))
    counts = bucket_counts(first_pass.filter("part is not null").select("part", "counts"))
    marks = first_pass.filter("part is null").select("id", "n", "d", "bits")
    sets = marks.filter("n > 0").groupBy("d").agg(F.first("n").alias("size"), F.first("bits").alias("bits"), F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(sets.withColumn("node", F.monotonically_increasing_id()))
    noise = float(counts.mean())
    sent = spark.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    shared = checkpointed(shared_rows(prefixes(source, size, sent, noise, similar, max(COMMON, int(2 * noise))), classes, similar))
    links = set_links(shared, classes, source, size, similar, sent, paired, thinned)
    roots = checkpointed(components(links))
    members = classes.select("node", "d", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    of = checkpointed(members.join(least, "root").select("d", F.col("copies").alias("n"), "component_id"))
    linked = join_values(marks.filter("n > 0").select("id", "d", F.col("n").alias("n_shingles")), of, "d").select("id", "n_shingles", "component_id")
    alone = marks.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)
