"""A training corpus from raw documents: five stages, each one of the library's operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet
to shared storage and reads it back as the next stage's `docs`. All stages but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import decontaminate, langid, neardup, packing, quality
from veilspan.session import materialize, release, table

#: A document stays if its language is known at least this surely.
MIN_LANGUAGE_SCORE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list.

    A null, empty or blank text fails the base rule. Rows are judged one by one; without labels
    of both kinds the base rule alone decides.
    """
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    # The row travels as one struct, so its column names cannot clash with the statistics'.
    stats = quality.statistics(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), "_text", ("_row",))
    return stats.where(~quality.base_failed() & rules.verdict()).select("_row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; texts without letters, and the least sure ones, go.

    Null texts go too. Rows are judged one by one; with no labelled row nothing is told, and all go.
    """
    model = langid.learn(docs)
    found = langid.identify_rows(docs, model)
    return found.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest id.

    Texts decide: documents that share an id but not a text both stay, of repeated rows one
    stays, rows without an id give way to those with one. Texts without words are one group.
    """
    return neardup.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none, ids play no part."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens; every row is packed, repeated ones too."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Learned models, near-duplicate groups and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        read, docs = docs, materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if number:
            release(read)  # what the stage before wrote
    return docs
