"""The queries of this package over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .decontaminate import contamination
from .jaccard_join import jaccard_components
from .mpegts import media_features
from .pii import pii
from .secret_scan import scan_secrets
from .sentencepiece_bpe import piece_digests
from .simhash import near_duplicates
from .sstable import token_shards
from .token_counts import token_counts
from .tool_calls import REPLY_SCHEMAS, calls_of_turns, link_tool_calls
from .toxicity import toxicity
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in documents, by suffix arrays."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores by subword bags."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts kept as MPEG transport streams."""
    return media_features(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and their components."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level vocabulary, with the whole-token shortcut."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as calls, linked with the replies."""
    calls, results = calls_of_turns(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, REPLY_SCHEMAS)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids and their decoding, by vectorised merge rounds."""
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as sorted-string-table shards and read back."""
    return token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by base patterns and a BiLSTM-CRF tagger."""
    return pii(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets with corpus-wide ownership frequency: a document is a repository, its source the owner."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates on the first 32 principal components, by block Lanczos."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best collocations of two to four words, by level-wise passes."""
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    """Name to function."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP6_SQL = """
WITH m AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id FROM m WHERE role = 'user'),
results AS (SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id FROM m WHERE role = 'assistant'),
turns AS (SELECT conv_id, turn, max(coalesce(length(text), 0)) AS n FROM m WHERE role = 'user' GROUP BY conv_id, turn),
waiting AS (SELECT a.conv_id, a.turn, coalesce(a.n < b.n, false) AS waits FROM turns a LEFT JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2),
ends AS (
  SELECT conv_id, turn, min(CASE WHEN NOT waits THEN turn END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_turn FROM waiting
),
firsts AS (SELECT conv_id, call_id, turn, text FROM results QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text NULLS FIRST) = 1),
every AS (
  SELECT c.conv_id, c.call_id, CASE WHEN f.call_id IS NULL THEN 'pending' ELSE 'linked' END AS status, e.after_turn, (e.after_turn - c.turn) // 2 AS hop,
         coalesce(length(c.text) > 0, false) AND c.turn >= 0 AS valid,
         CASE WHEN c.text IS NULL THEN '$.text: not string' WHEN length(c.text) = 0 THEN '$.text: too short' ELSE '' END AS problems,
         '{"text":' || coalesce(to_json(c.text)::VARCHAR, 'null') || ',"turn":' || c.turn || '}' AS arguments, '"reply"' AS name, f.text AS content
  FROM calls c JOIN ends e ON e.conv_id = c.conv_id AND e.turn = c.turn LEFT JOIN firsts f ON f.conv_id = c.conv_id AND f.call_id = c.call_id
  UNION ALL
  SELECT f.conv_id, f.call_id, 'orphan', f.turn, 0, false, 'no call', 'null', 'null', f.text
  FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = f.conv_id AND c.call_id = f.call_id)
)
SELECT conv_id, call_id, status, after_turn, 0::BIGINT AS after_k, hop::BIGINT AS hop, false AS cyclic, valid, problems,
       '{"arguments":' || arguments || ',"conversation":' || conv_id || ',"id":"' || call_id || '","name":' || name || ',"result":' ||
       coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '","valid":' || valid::VARCHAR || '}' AS line
FROM every
"""

OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
),
found AS (
  SELECT p.doc_id, p.k, p.size, x.item_id
  FROM (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)) p
  JOIN windows x ON x.size = p.size AND x.win = p.win
),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN items n USING (doc_id)
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + size - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, least(5, len(w)) AS size, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY u, v),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach AS (SELECT u AS doc_id, u AS other FROM links UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, c.low), d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) c USING (doc_id)
"""

OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k) GROUP BY lang, k, phrase
),
totals AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 30),
longer AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c CROSS JOIN (VALUES (2), (3)) AS v(m) WHERE k > m) GROUP BY ALL
),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, 2000000::HUGEINT * c.a // (x.f + y.f) AS score
  FROM (SELECT lang, phrase, a, w, unnest(range(1, k)) AS j FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')
),
least_cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT b.* FROM least_cut b LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op1_decontamination": OP1_SQL, "op6_tool_calls": OP6_SQL, "op11_jaccard_join": OP11_SQL, "op13_collocations": OP13_SQL}
