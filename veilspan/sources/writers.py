"""Sinks: release lines, metric tables, checkpoints and small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested rows as JSON lines, as many files as there are partitions."""
    df.write.mode(mode).json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    write_json_lines(df, path, "append")


def write_metrics_csv(df: DataFrame, path: str, values: str | None = None) -> None:
    """A small aggregate as one CSV file with a header.

    values: a map column that is spread out, one column for each key that any row has.
    """
    if values:
        keys = sorted(r[0] for r in df.select(F.explode(F.map_keys(values))).distinct().collect())
        df = df.select(*[c for c in df.columns if c != values], *[F.col(values)[k].alias(k) for k in keys])
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """What a run was made with and of, as one JSON document, keys in order."""
    text = json.dumps(content, indent=2, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def formatted(value, percent: bool = False) -> str:
    if value is None:
        return "NA"
    if isinstance(value, float):
        return f"{100 * value:.1f}" if percent and 0 <= value <= 1 else f"{value:.3f}"
    return str(value)


def markdown_table(df: DataFrame, percent: tuple[str, ...] = (), limit: int = 200) -> str:
    """A small aggregate as a Markdown table; one of more than `limit` rows is an error, not cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a table of more than {limit} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return head + "".join("\n| " + " | ".join(formatted(r[c], c in percent) for c in df.columns) + " |" for r in rows)


def leaks(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that name a user's folder or a private network address."""
    return lines.where(F.col(column).rlike(r"/(?:Users|home)/[A-Za-z0-9_.-]+|\b(?:10|192\.168|172\.(?:1[6-9]|2\d|3[01]))(?:\.\d{1,3}){2,3}\b"))
