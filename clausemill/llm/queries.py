"""The queries of this subpackage, by name, with DuckDB SQL where SQL can express them.

Every query is a thin digest of its operator over whole tables; columns follow the published contracts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, lm, packing, quality, secrets, sharding, simhash
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups: 3-word shingles, 64 bits, links at 2 or fewer differing bits."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"), radius=2, shingle_words=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark's windows of 10 words."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = decontaminate.hit_words(F.col("spans")).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLES["op4_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
s AS (SELECT r, size, p, array_to_string(w[p : p + size - 1], ' ') AS gram
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)),
h AS (SELECT r, s.size, p, item_id FROM s JOIN g ON s.gram = g.gram AND s.size = g.size),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the linked weaker parts."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "placement")


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    samples = langid.learn(docs.where(langid.remainder(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, samples)
    held_out = F.coalesce(langid.remainder(F.col("id"), 4) == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in global random order, in eight shards whose row counts are at most one apart."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        F.col("id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the divergence verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    found = quality.judge(docs, quality.references(docs))
    return found.select(F.col("id").alias("doc_id"), *quality.NAMES)


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *licenses.NAMES)


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message, call and result of all conversations as canonical JSON, with links and order."""
    found = chat.messages(table(spark, sf_dir, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), "turn", "part", "kind", "call_id", "linked", "level", "place", F.array_join("problems", ",").alias("problems"), "json")


#: Of the tables here no turn holds tool calls or results; the SQL gives the rows of plain messages, and fails where there are others.
ORACLES["op7_chat_format"] = r"""
SELECT conv_id, turn, CAST(0 AS INTEGER) AS part,
    CASE WHEN role IN ('assistant', 'tool') AND ltrim(text) LIKE '{%' AND text LIKE '%"tool_call%' THEN error('tool turns') ELSE 'message' END AS kind,
    CAST(NULL AS VARCHAR) AS call_id, FALSE AS linked, CAST(0 AS INTEGER) AS level, turn AS place, '' AS problems,
    CAST(to_json({'content': coalesce(text, ''), 'role': coalesce(role, '')}) AS VARCHAR) AS json
FROM conversations
"""


#: Conversations with tool calls, which the tables lack: (conv_id, turn, role, text).
TOOL_TURNS = [
    (1, 0, "user", "What is 2 + the limit?"),
    (1, 1, "assistant", '{"tool_calls": [{"id": "b", "name": "calculator", "arguments": {"expression": "$a + 2"}}, {"id": "a", "name": "search", "arguments": {"query": "limit", "limit": 3}}]}'),
    (1, 2, "tool", '{"tool_call_id": "b", "content": {"z": 1, "a": [1.5, null]}}'),
    (1, 3, "tool", '\n {"tool_call_id": "a", "content": "three"}'),
    (2, 0, "assistant", '{"tool_calls": [{"id": "x", "name": "weather", "arguments": {"city": "P", "unit": "rankine", "at": {"lat": 91, "lon": 0}}}, {"id": "y", "name": "nope", "arguments": {}}]}'),
    (2, 1, "tool", '{"tool_call_id": "q", "content": true}'),
    (2, 2, "assistant", '{"tool_calls": "none"}'),
    (3, 0, "assistant", '{"tool_calls": [{"id": "p", "name": "search", "arguments": {"query": "$r"}}, {"id": "r", "name": "search", "arguments": {"query": "$p"}}]}'),
    (3, 1, "tool", '{"tool_call_id": "p", "content": 1}'),
    (3, 2, "tool", '{"tool_call_id": "r", "content": 2}'),
]


@query
def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the conversations of TOOL_TURNS."""
    found = chat.messages(spark.createDataFrame(TOOL_TURNS, "conv_id long, turn long, role string, text string"))
    return found.select(F.col("conv").alias("conv_id"), "turn", "part", "kind", "call_id", "linked", "level", "place", F.array_join("problems", ",").alias("problems"), "json")


#: Worked out by hand from the rules in chat.py.
ORACLES["chat_tool_calls"] = r"""
SELECT * FROM (VALUES
    (1::BIGINT, 0::BIGINT, 0::INTEGER, 'message', NULL, FALSE, 0::INTEGER, 0::BIGINT, '', '{"content":"What is 2 + the limit?","role":"user"}'),
    (1, 1, 0, 'call', 'b', TRUE, 2, 3, '', '{"arguments":{"expression":"$a + 2"},"id":"b","name":"calculator","role":"assistant"}'),
    (1, 1, 1, 'call', 'a', TRUE, 0, 1, '', '{"arguments":{"limit":3,"query":"limit"},"id":"a","name":"search","role":"assistant"}'),
    (1, 2, 0, 'result', 'b', TRUE, 3, 3, '', '{"content":{"a":[1.5,null],"z":1},"role":"tool","tool_call_id":"b"}'),
    (1, 3, 0, 'result', 'a', TRUE, 1, 3, '', '{"content":"three","role":"tool","tool_call_id":"a"}'),
    (2, 0, 0, 'call', 'x', FALSE, 0, 0, 'enum:unit,no_result,range:at.lat', '{"arguments":{"at":{"lat":91,"lon":0},"city":"P","unit":"rankine"},"id":"x","name":"weather","role":"assistant"}'),
    (2, 0, 1, 'call', 'y', FALSE, 0, 0, 'no_result,unknown_tool', '{"arguments":{},"id":"y","name":"nope","role":"assistant"}'),
    (2, 1, 0, 'result', 'q', FALSE, 0, 1, 'no_call', '{"content":true,"role":"tool","tool_call_id":"q"}'),
    (2, 2, 0, 'message', NULL, FALSE, 0, 2, '', '{"content":"{\"tool_calls\": \"none\"}","role":"assistant"}'),
    (3, 0, 0, 'call', 'p', TRUE, NULL, 0, 'circular', '{"arguments":{"query":"$r"},"id":"p","name":"search","role":"assistant"}'),
    (3, 0, 1, 'call', 'r', TRUE, NULL, 0, 'circular', '{"arguments":{"query":"$p"},"id":"r","name":"search","role":"assistant"}'),
    (3, 1, 0, 'result', 'p', TRUE, NULL, 1, 'circular', '{"content":1,"role":"tool","tool_call_id":"p"}'),
    (3, 2, 0, 'result', 'r', TRUE, NULL, 2, 'circular', '{"content":2,"role":"tool","tool_call_id":"r"}')
) AS t(conv_id, turn, part, kind, call_id, linked, level, place, problems, json)
"""


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and attention-model scores of all documents, learned from six sevenths of them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = lm.score(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, modulus=7, held=2)
    return found.withColumnRenamed("id", "doc_id")
