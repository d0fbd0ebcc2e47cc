"""Lexicon scores on a stream of texts: stateless, so any trigger and output mode works.

Checkpoints of a running query replace the append-only progress files of a batch job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.lexicon import BASE_SCORE, CLASSIFIER_CUES, CUE_SCORE


def lexicon_score(text: Column, cues: list[str] = CLASSIFIER_CUES) -> Column:
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(c)).cast("int") for c in cues])
    return F.least(F.lit(1.0), F.lit(BASE_SCORE) + hits * F.lit(CUE_SCORE))


def score_stream(rows: DataFrame, text: str = "text") -> DataFrame:
    """Works on batch and streaming rows alike."""
    return rows.withColumn("score", lexicon_score(F.col(text)))
