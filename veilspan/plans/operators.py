"""Queries over operators that SQL does not express: checked by tests, not by an oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.lexicon import CLASSIFIER_CUES
from veilspan.operators import classifiers, identify, learned, release
from veilspan.plans import core, dialect
from veilspan.registry import query
from veilspan.streaming.scoring import lexicon_score


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run(spark, sf_dir, lambda q: "SELECT * FROM rows", ("rows",))


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A document's id is its place in the source; seeds follow it.
    return identify.inject_rows(rows(spark, sf_dir).withColumn("row_index", F.col("row_id")))


@query("d2_phrase_spans")
def _(spark, sf_dir):
    texts = dialect.run(spark, sf_dir, lambda q: "SELECT row_id, text FROM injected", ("injected",))
    return identify.phrase_rows(texts).select("row_id", F.explode("found").alias("x")).select("row_id", "x.label", "x.phrase", "x.s")


@query("d4_inject_seeded")
def _(spark, sf_dir):
    return injected(spark, sf_dir).select("row_id", "template", "text", F.size("gold").alias("n_gold"))


@query("j9_detector_residuals")
def _(spark, sf_dir):
    """Identifiers that the detectors still find in the released texts, by variant and class."""
    return dialect.run(spark, sf_dir, lambda q: "SELECT variant, label, sum(n) AS n FROM detected GROUP BY variant, label", ("detected",))


@query("f4_tfidf_classifier")
def _(spark, sf_dir):
    data = rows(spark, sf_dir)
    return learned.predict(learned.tfidf_classifier(data), data)


@query("j15_second_evaluator")
def _(spark, sf_dir):
    released = dialect.run(spark, sf_dir, lambda q: "SELECT row_id, variant, binary_label, released_text FROM releases", ("releases",))
    model = learned.tfidf_classifier(rows(spark, sf_dir))
    scored = model.transform(released.withColumnRenamed("released_text", "text")).withColumn("pred", F.col("prediction").cast("int"))
    return scored.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("binary_label")).alias("correct"), F.count("binary_label").alias("labelled"))


#: Numbers of anchors and window radii of the sweep.
SWEEP = ((3, 2), (5, 1), (5, 2))


def swept(q, top_k: int, radius: int) -> str:
    return f"""SELECT 'k={top_k}, r={radius}' AS setting, {top_k} AS top_k, {radius} AS radius, count(*) AS n, {core.CONFUSION}, count_if(pred <> raw_pred) AS flips,
CAST(sum(kept_tokens) AS BIGINT) AS kept_tokens, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, count_if(placeholder) AS placeholder_only FROM facts WHERE variant = 'context'"""


def swept_oracle() -> str:
    """The oracle's relations once for each setting."""
    parts, usual = [], (core.TOP_K, core.RADIUS)
    try:
        for k, r in SWEEP:
            core.TOP_K, core.RADIUS = k, r
            parts.append(f"SELECT * FROM ({dialect.render(lambda q, k=k, r=r: swept(q, k, r), ('facts',), dialect.DUCKDB)}) AS s{len(parts)}")
    finally:
        core.TOP_K, core.RADIUS = usual
    text = "\nUNION ALL ".join(parts)
    for t in dialect.TABLES:
        text = text.replace(f"@{t}@", t)
    return text


@query("n1_sweep", swept_oracle)
def _(spark, sf_dir):
    """The context releases of several settings, each made anew, and what they keep and flip."""
    runs = [dialect.run(spark, sf_dir, lambda q, k=k, r=r: swept(q, k, r), ("facts",), release.Settings(top_k=k, radius=r)) for k, r in SWEEP]
    return reduce(DataFrame.unionByName, runs)


@query("l4_bootstrap")
def _(spark, sf_dir):
    counts = dialect.run(spark, sf_dir, lambda q: "SELECT variant, count(*) AS n, count_if(hate = raw_hate) AS same FROM paired WHERE raw_hate IN ('YES', 'NO') GROUP BY variant", ("paired",))
    return learned.bootstrap_interval(counts, ["variant"], "same", "n")


def _lexicon_sql(text: str) -> str:
    hits = " + ".join(f"CASE WHEN contains(lower({text}), '{c}') THEN 1 ELSE 0 END" for c in CLASSIFIER_CUES)
    return f"least(CAST(1.0 AS DOUBLE), CAST(0.05 AS DOUBLE) + ({hits}) * CAST(0.28 AS DOUBLE))"


@query("f1_pluggable_scorer", f"SELECT doc_id AS row_id, {_lexicon_sql('text')} AS score FROM documents")
def _(spark, sf_dir):
    return classifiers.score_with(rows(spark, sf_dir), classifiers.choose("lexicon").make).select("row_id", "score")


@query("s1_lexicon_score_frame", f"SELECT conv_id, turn, {_lexicon_sql('text')} AS score FROM conversations")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", lexicon_score(F.col("text")).alias("score"))
