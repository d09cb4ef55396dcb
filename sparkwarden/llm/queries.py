"""The queries of this subpackage, one an operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, html_extract, langid, sharding, simhash, substring, token_files, toxicity, winnow

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
END_ID = 2


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, with_ids=False)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_ID)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(common.table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.table(spark, sf_dir, "pages"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_next(common.table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_token_files, op3_sharding, op4_html, op5_langid, op6_toxicity, op7_decontaminate, op8_simhash, op9_winnow, op10_substring)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, unnest(CASE WHEN len(w) >= {decontaminate.WINDOW} THEN list_transform(range(1, len(w) - {decontaminate.WINDOW} + 2), lambda i: w[i:i + {decontaminate.WINDOW} - 1]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS p FROM b),
sizes AS (SELECT DISTINCT len(p) AS n FROM win),
spots AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (SELECT s.r, s.i, s.n, win.item FROM spots s JOIN d USING (r) JOIN win ON d.w[s.i:s.i + s.n - 1] = win.p),
hits AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL has no XXH64, crc32, byte-pair merges or learnt models; those queries are held against brute force in the tests."""
    return {"op7_decontaminate": _OP7}
