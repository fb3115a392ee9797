"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldframe.llm.common import table
from foldframe.llm.decontaminate import op4_benchmark_decontamination
from foldframe.llm.edits import op1_edit_fingerprints
from foldframe.llm.licenses import op5_license_scan
from foldframe.llm.licenses import oracle as license_oracle
from foldframe.llm.pseudolikelihood import op2_lm_scoring
from foldframe.llm.quality import op6_quality_classifier
from foldframe.llm.sentencepieces import op8_sentencepiece
from foldframe.llm.sharding import op10_sharding
from foldframe.llm.simhash import op3_simhash_near_dedup
from foldframe.llm.toxicity import op7_toxicity
from foldframe.llm.warc import op9_warc

SENTENCEPIECE_MODEL = "piece_bpe_32k.model"


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_edit_fingerprints(table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_lm_scoring(table(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_simhash_near_dedup(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_benchmark_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_license_scan(table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_classifier(table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_sentencepiece(table(spark, sf_dir, "documents"), public_tokenizers.path(SENTENCEPIECE_MODEL))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_warc(table(spark, sf_dir, "pages"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_sharding(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_edit_fingerprints": _op1,
    "op2_lm_scoring": _op2,
    "op3_simhash_near_dedup": _op3,
    "op4_benchmark_decontamination": _op4,
    "op5_license_scan": _op5,
    "op6_quality_classifier": _op6,
    "op7_toxicity": _op7,
    "op8_sentencepiece": _op8,
    "op9_warc": _op9,
    "op10_sharding": _op10,
}

#: Words of a text: ASCII letters, folded, digits, and whatever is beyond ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rn, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT rn, id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT rn, count(DISTINCT k) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rn),
items AS (SELECT rn, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rn, id FROM hits) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rn) LEFT JOIN items USING (rn)
"""

#: A hex digest in base 32: five hex digits are four letters.
_FIVE = " + ".join(f"(instr('0123456789abcdef', h[k + {i}]) - 1) * {16 ** (4 - i)}" for i in range(5))
_FOUR = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v // {32 ** (3 - i)} % 32 + 1]" for i in range(4))

_OP9_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS rn, page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
fives AS (SELECT rn, k, {_FIVE} AS v FROM (SELECT rn, h, unnest([1, 6, 11, 16, 21, 26, 31, 36]) AS k FROM p)),
digests AS (SELECT rn, string_agg({_FOUR}, '' ORDER BY k) AS payload_digest FROM fives GROUP BY rn),
firsts AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first OR page_id IS NULL THEN first END AS refers_to
FROM p JOIN digests USING (rn) JOIN firsts USING (html)
"""

ORACLE_SQL: dict[str, str] = {"op4_benchmark_decontamination": _OP4_SQL, "op5_license_scan": license_oracle(), "op9_warc": _OP9_SQL}
