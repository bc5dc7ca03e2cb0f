"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldcast.llm.chat_format import conversation_digests
from fieldcast.llm.common import table
from fieldcast.llm.html_text import main_text
from fieldcast.llm.lexicon import encode_digests
from fieldcast.llm.license_scan import scan
from fieldcast.llm.ngram_join import ngram_join
from fieldcast.llm.packing import pack
from fieldcast.llm.periodic_runs import run_digests
from fieldcast.llm.quality import COLUMNS, quality
from fieldcast.llm.sharding import balanced_shards
from fieldcast.llm.source_audit import source_audit
from fieldcast.llm.token_counts import token_counts
from fieldcast.llm.toxicity import toxicity
from fieldcast.llm.vantage import nearest

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"), shards=8)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COLUMNS, "base_failed", "kept", "quality")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), tokens=2048)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings."""
    own = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(rows.unionByName(spark.createDataFrame(own, rows.schema)))


CHAT_FORMATTING = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
written AS (
  SELECT *, length(replace(replace(replace(replace(replace(role || chr(10) || text, '\', '\\'),
    '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS n
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n - 1 + length('<s>[INST] ') + length(' [/INST] ') + length(' </s>') + 1) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


SOURCE_AUDIT = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 30),
grp AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
dense AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(n, 0) AS n
  FROM grp JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
         sum(n) OVER (PARTITION BY lang, term) AS total
  FROM dense WINDOW g AS (PARTITION BY lang, source)),
whole AS (
  SELECT lang, term, 1 + (1000000000 * (total + 5)) // (sum(total) OVER g + 5 * count(*) OVER g) AS q
  FROM (SELECT DISTINCT lang, term, total FROM shares) WINDOW g AS (PARTITION BY lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, abs(x.p - y.p) AS f
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term),
parts AS (
  SELECT lang, source, part, item, coalesce(sum(f), 0) AS value FROM pairs GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_balanced_shards": op4_balanced_shards,
    "op5_html_main_text": op5_html_main_text,
    "op6_license_scan": op6_license_scan,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_audit": op13_source_audit,
}
SQL: dict[str, str] = {"op11_chat_formatting": CHAT_FORMATTING, "op13_source_audit": SOURCE_AUDIT}
