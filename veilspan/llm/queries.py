"""The registered queries of this subpackage: thin contracts over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import decontaminate, html, langid, licenses, packing, quality, simhash, toxicity, urls, wordpiece
from veilspan.llm.textexpr import crc_mod
from veilspan.session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.learn(documents, where="crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    found = langid.identify(documents, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.learn(spark))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality.learn(documents, table(spark, sf_dir, "labels"))
    return quality.judge(documents, rules)


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), _tokenizer())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"), "crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2")
    found = toxicity.score(documents, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_url_filters": op2_url_filters,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_extraction": op4_html_extraction,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
}

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_SHINGLES = """list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {least} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)"""

ORACLE_SQL: dict[str, str] = {
    # Every benchmark item has five words or more, so documents need no shorter shingles.
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES.format(least=5)}) AS s FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE len(w) > 0),
b AS (SELECT item_id, unnest(q) AS s, len(q) AS n FROM (SELECT item_id, {_SHINGLES.format(least=5)} AS q FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0))
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, count(*) AS n_found, count(*) / CAST(n AS DOUBLE) AS containment
FROM d JOIN b USING (s) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
""",
}
