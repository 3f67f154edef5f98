"""Secret scans with corpus-wide ownership frequency.

Candidates come from three patterns. Each candidate value is hashed, and the
hashes are counted over the whole corpus by distinct repositories and distinct
owners: a value that many owners or repositories hold is a copied example, one
that a single owner holds in few repositories looks live. Counting goes through
distinct (hash, owner) rows that are combined before each shuffle, so one value
that a third of all rows holds costs no more than its distinct owners.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_values, map_texts

KINDS = ("assign", "access", "hex")
#: The base patterns and least lengths of their values.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: What every assignment word has, for a scan that skips texts without any of them.
ASSIGN_WORD = re.compile(r"(?ai:passw|secret|token|api_?key)")


def find_secrets(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind's place, kind:start:end, value) of each base match, in order.

    Per kind the leftmost non-overlapping matches, of which the short ones are
    dropped afterwards. Runs of hexadecimal digits are maximal, so their least
    length can stand in the pattern.
    """
    found = []
    if ASSIGN_WORD.search(text):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}", m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def scan(texts: list[str]) -> dict[str, list]:
    """Counts, digest, spans and hashes of candidate values of each text."""
    out = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "hashes": []}
    for t in texts:
        found = find_secrets(t)
        for k, kind in enumerate(KINDS):
            out[f"n_{kind}"].append(sum(f[1] == k for f in found))
        spans = ",".join(f[2] for f in found)
        out["base_sha256"].append(hashlib.sha256(spans.encode()).hexdigest())
        out["spans"].append(spans)
        out["hashes"].append([hashlib.sha256(f[3].encode()).hexdigest()[:32] for f in found])
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its candidates: counts by kind, digest, spans, and hashes of the values in the spans' order."""
    return map_texts(docs, lambda: scan, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, hashes array<string>", id_col, text_col)


#: Owners and repositories up to which a value looks live: one owner's credential may stand in a few of its repositories.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 5


def ownership(candidates: DataFrame, live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """How many rows, repositories and owners hold each hash, over rows (hash, repository, owner), and the verdict.

    `verdict` is "live" where at most `live_owners` owners and at most
    `live_repositories` repositories hold the value, else "copied". A null
    repository or owner counts as one of its own. Each count is over distinct
    pairs, pre-aggregated before its shuffle.
    """

    def per(name: str) -> DataFrame:
        return candidates.select("hash", F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")).alias("v")).groupBy("hash", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum("n").alias(f"rows_{name}"))

    both = per("repository").join(per("owner"), "hash")
    live = (F.col("n_owner") <= live_owners) & (F.col("n_repository") <= live_repositories)
    return both.select("hash", F.col("rows_owner").alias("n"), F.col("n_repository").alias("repositories"), F.col("n_owner").alias("owners"), F.when(live, "live").otherwise("copied").alias("verdict"))


def scan_secrets(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its candidates, and of each span how many repositories and owners hold its value, and the verdict.

    `findings` lists the spans in their order as (span, repositories, owners,
    verdict); `n_live` and `n_copied` count the distinct values by verdict.
    `repository` and `owner` are columns of `docs` (by default the document is
    its own repository and `source` the owner). A null text counts as empty;
    repeated rows give repeated rows and count once as a repository; an empty
    table gives no rows; texts of any length are scanned whole; spans that begin
    at one place are ordered by kind; further columns are not read.
    """
    repository = docs[id_col] if repository is None else repository
    owner = docs["source"] if owner is None else owner
    key = F.struct(docs[id_col].alias("id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    found = checkpointed(secret_spans(docs.select(key.alias("key"), docs[text_col].alias("text")), "key", "text"))
    some = found.filter(F.size("hashes") > 0)
    held = checkpointed(ownership(some.select(F.explode("hashes").alias("hash"), "key.repository", "key.owner"), live_owners, live_repositories))
    # a document's few hashes meet the counts, then come together by document; all other documents take no part
    uid = F.struct("key.id", "hashes")
    asked = some.select(uid.alias("uid"), F.explode(F.array_distinct("hashes")).alias("hash")).distinct()
    verdicts = join_values(asked, held, "hash").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("hash", F.struct("repositories", "owners", "verdict")))).alias("by"))
    joined = some.withColumn("uid", uid).alias("r").join(verdicts.alias("v"), F.col("r.uid").eqNullSafe(F.col("v.uid")))
    base = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    listed = F.zip_with(F.split("r.spans", ","), F.col("r.hashes"), lambda span, h: F.struct(span.alias("span"), F.col("v.by")[h]["repositories"].alias("repositories"), F.col("v.by")[h]["owners"].alias("owners"), F.col("v.by")[h]["verdict"].alias("verdict")))
    count = lambda verdict: F.size(F.filter(F.map_values("v.by"), lambda x: x["verdict"] == verdict)).cast("bigint")
    with_any = joined.select(F.col("r.key.id").alias(id_col), *(F.col(f"r.{c}") for c in base), count("live").alias("n_live"), count("copied").alias("n_copied"), listed.alias("findings"))
    empty = F.array().cast(with_any.schema["findings"].dataType)
    none = found.filter(F.size("hashes") == 0).select(F.col("key.id").alias(id_col), *base, F.lit(0).cast("bigint").alias("n_live"), F.lit(0).cast("bigint").alias("n_copied"), empty.alias("findings"))
    return none.unionByName(with_any)
