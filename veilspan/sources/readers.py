"""Sources: each one is normalised to rows (row_id, dataset, split, text, label, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCORES = "toxicity severe_toxicity obscene threat insult identity_attack sexual_explicit".split()


def read_csv(spark: SparkSession, path: str, text_col: str, label_col: str | None = None, id_col: str | None = None, multi_line: bool = True) -> DataFrame:
    """Any CSV with a header; columns are checked, a missing id becomes a number of the row.

    Numbers rise with the rows; in one file they are its ordinals. multi_line: fields may hold line
    feeds, which makes each file one task; without it large files are split.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    missing = [c for c in (text_col, label_col, id_col) if c and c not in raw.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    # Ordinals come from the scan's own order, without moving all rows to one task.
    numbered = raw.withColumn("_n", F.monotonically_increasing_id())
    stem = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
    own = F.nullif(F.col(id_col), F.lit("")) if id_col else F.lit(None).cast("string")
    return numbered.select(F.coalesce(own, F.col("_n").cast("string")).alias("row_id"), F.lit(stem).alias("dataset"), F.lit("unknown").alias("split"), F.col(text_col).alias("text"), (F.col(label_col) if label_col else F.lit(None).cast("string")).alias("label"))


def read_rationale_corpus(spark: SparkSession, records: str, splits: str, split: str = "train") -> DataFrame:
    """JSON lines of (id, annotators[label, target[]], rationales[[int]], post_tokens[]) joined with split ids."""
    schema = "id string, annotators array<struct<label:string,target:array<string>>>, rationales array<array<int>>, post_tokens array<string>"
    ids = spark.read.schema(f"`{split}` array<string>").option("multiLine", True).json(splits).select(F.explode(split).alias("id"))
    rows = spark.read.schema(schema).json(records).join(ids, "id", "left_semi")
    votes = rows.select("id", F.posexplode("annotators.label").alias("p", "label")).where(~F.lower("label").isin("", "none", "nan"))
    ranked = votes.groupBy("id", "label").agg(F.count("*").alias("n"), F.min("p").alias("first"))
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first"))).where("r = 1").select("id", "label")
    targets = F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten("annotators.target"), lambda t: F.lower(t)), lambda t: ~t.isin("", "none", "nan", "other"))))
    mask = F.expr("transform(CASE WHEN size(post_tokens) > 0 THEN sequence(0, size(post_tokens) - 1) ELSE array() END, i -> CAST(coalesce(aggregate(filter(rationales, m -> size(m) > i), 0, (a, m) -> a + m[i]) * 2 >= size(filter(rationales, m -> size(m) > i)) AND size(filter(rationales, m -> size(m) > i)) > 0, false) AS INT))")
    return rows.join(best, "id", "left").select(F.col("id").alias("row_id"), F.lit("rationales").alias("dataset"), F.lit(split).alias("split"), F.array_join("post_tokens", " ").alias("text"), "label", targets.alias("target_groups"), F.when(F.size("rationales") > 0, mask).alias("rationale_token_mask"))


def read_functional_suite(spark: SparkSession, path: str) -> DataFrame:
    """CSV of test_case, label_gold, target_ident, functionality and an id."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    name = lambda *options: F.coalesce(*[F.col(c) for c in options if c in raw.columns], F.lit(None).cast("string"))
    return raw.select(name("case_id", "id").alias("row_id"), F.lit("functional").alias("dataset"), F.lit("test").alias("split"), name("test_case", "text").alias("text"), name("label_gold", "label").alias("label"), name("target_ident").alias("target"), name("functionality").alias("functionality"))


def read_toxicity_scores(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds binary_label; scores that are no numbers count as 0."""
    out = rows
    for c in SCORES:
        if c in rows.columns:
            out = out.withColumn(c, F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)))
    return out.withColumn("binary_label", (F.col("toxicity") >= threshold).cast("int"))


def read_char_offsets(rows: DataFrame, position: str = "position", text: str = "text") -> DataFrame:
    """Rows with a text, their stringified offset lists parsed to `offsets`."""
    return rows.where(F.trim(F.col(text)) != "").withColumn("offsets", F.transform(F.regexp_extract_all(F.col(position).cast("string"), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a JSON lines file that are no JSON objects, which `read_releases` leaves out."""
    return spark.read.text(path).where((F.trim("value") != "") & F.try_parse_json("value").isNull()).select("value")


def read_releases(spark: SparkSession, path: str, schema: str, needed: list[str] | None = None) -> DataFrame:
    """Nested JSON lines of releases; bad lines are left out (`bad_lines` gives them), `needed` variants must all be there."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.size(F.array_intersect(F.map_keys("variants"), F.array(*map(F.lit, needed)))) == len(needed)) if needed else rows


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, config, metrics) of every run folder that has both files."""
    def one(name):
        files = spark.read.option("wholetext", True).text(f"{folder}/*/{name}")
        return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run"), F.col("value").alias(name.split(".")[0]))

    return one("config.json").join(one("variant_metrics.json"), "run")


def unfinished(rows: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that a checkpoint does not have yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
