"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from intentlane.llm.decontaminate import op10_decontaminate
from intentlane.llm.embedding_dedup import op9_embedding_dedup
from intentlane.llm.html_wrapper import op3_html_text
from intentlane.llm.langid_crf import op1_language_id
from intentlane.llm.lm_bloom import op6_lm_scores
from intentlane.llm.merkle import op12_merkle_manifest
from intentlane.llm.mixing import op5_mix_sources
from intentlane.llm.oracles import OP11_SQL, OP13_SQL, merkle_sql
from intentlane.llm.quality_gbt import op4_quality
from intentlane.llm.simhash import op2_simhash_dedup
from intentlane.llm.spelling import op13_spelling_variants
from intentlane.llm.token_counts import op7_token_counts
from intentlane.llm.toxicity import op8_toxicity
from intentlane.llm.warc import op11_warc_index
from intentlane.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

#: Sources in code point order weigh 3, 1, 2, repeating; 150 % of all words are dealt by weight and a
#: target stops at twice its source. Documents are taken in order of their hash until the target is met.
OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
  FROM documents),
src AS (
  SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
              WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM src),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER w, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level_k,
         coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS capped_weight
  FROM ranked
  WINDOW w AS (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(level_k, capped_weight) AS level FROM levels WHERE cap > level_k * weight),
targets AS (
  SELECT skey, source_size, coalesce(least(cap, level * weight), cap) AS target FROM levels, level),
bounds AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-12), 2) ELSE 0 END AS whole FROM targets),
missing AS (
  SELECT *, greatest(round(target - whole * source_size, 6), 0.0::DOUBLE) AS missing FROM bounds),
same AS (  -- documents of one hash share what is left
  SELECT skey, h, sum(size) AS words FROM sized GROUP BY skey, h),
upto AS (
  SELECT *, sum(words) OVER (PARTITION BY skey ORDER BY h) AS upto FROM same)
SELECT d.doc_id, d.size, m.source_size, m.target,
       CAST(m.whole * d.size + CASE
         WHEN u.upto <= m.missing THEN d.size
         WHEN u.upto - u.words < m.missing THEN floor(d.size * (m.missing - CAST(u.upto - u.words AS DOUBLE)) / CAST(u.words AS DOUBLE))
         ELSE 0 END AS BIGINT) AS taken,
       d.source
FROM sized d JOIN missing m USING (skey) JOIN upto u ON u.skey = d.skey AND u.h = d.h
"""

_QUERIES: dict[str, QueryFn] = {
    "op1_language_id": op1_language_id,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_html_text": op3_html_text,
    "op4_quality": op4_quality,
    "op5_mix_sources": op5_mix_sources,
    "op6_lm_scores": op6_lm_scores,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_warc_index": op11_warc_index,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}

_ORACLES: dict[str, str] = {
    "op5_mix_sources": OP5_SQL,
    "op11_warc_index": OP11_SQL,
    "op12_merkle_manifest": merkle_sql(),
    "op13_spelling_variants": OP13_SQL,
}


def _shipped(fn: QueryFn) -> QueryFn:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def llm_queries() -> dict[str, QueryFn]:
    return {name: _shipped(fn) for name, fn in _QUERIES.items()}


def llm_oracles() -> dict[str, str]:
    return dict(_ORACLES)
