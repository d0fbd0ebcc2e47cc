"""Session, table and scratch-storage helpers shared by the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "veilspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


#: Splits up to which a table of texts is dealt out: what is moved is bounded by as many splits.
FEW_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """Texts that come in very few splits are dealt out over all cores, their order kept.

    A small table is often one row group, which one task would read and process alone. Its rows
    are cut into ranges of their places in the files, so neighbours stay neighbours. Tables of
    more than FEW_SPLITS splits, or of half as many as there are cores, are left as they are.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits > FEW_SPLITS or 2 * splits > cores:
        return df
    place = ["_file", "_row"]
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.repartitionByRange(cores, *place).sortWithinPartitions(*place).drop(*place)


#: Rows of a Parquet file that a task decodes at a time where whole texts are read.
TEXT_ROWS = 256
BATCH_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def short_batches(df: DataFrame) -> DataFrame:
    """`df`, its session set to decode no more than TEXT_ROWS rows of a Parquet file at a time.

    Spark's own 4,096 rows of text are one array of tens of MB that grows by copies, anew in
    each task; it outlives young collections, so the heap grows far beyond what is in use.
    A session with a lower bound keeps it. No result depends on it.
    """
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_ROWS)) > TEXT_ROWS:
        conf.set(BATCH_ROWS, str(TEXT_ROWS))
    return df


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, else one under the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Write `df` once to shared storage and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    several consumers share one evaluation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/veilspan-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete what `materialize` wrote for `df` (only once nothing reads it any more).

    Only folders of its own directly in the scratch folder are ever deleted.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    scratch = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark)).toUri().getPath()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("veilspan-") and folder.getParent().toUri().getPath() == scratch:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
