"""Arrow helpers for the operators that work on whole texts in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a Python worker holds at a time; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """`df`, its session set to hand Python no more than BLOCK_BYTES (or one row) at a time.

    Spark's own bound is 64 MB a batch, held by the JVM and by the worker. A session with a
    lower bound keeps it.
    """
    conf = df.sparkSession.conf
    now = conf.get(BATCH_BYTES).lower().removesuffix("b")
    if int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1], 0) > BLOCK_BYTES:
        conf.set(BATCH_BYTES, str(BLOCK_BYTES))
    return df


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most `block_bytes` of text (or one row) each; null becomes ''."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if size + n > block_bytes and i > start:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in column.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start), [t or "" for t in column.slice(start).to_pylist()]


def map_texts(df: DataFrame, columns: list[str], text: str, schema: str, work: Callable[[], Callable[[list, list[str]], dict]]) -> DataFrame:
    """Run `work()` once a task; the function it returns maps a block of texts to columns.

    columns: what the function gets beside the texts, as one Arrow array each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = [n for n in columns if n != text]
    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for part, texts in blocks(batches, text):
            out = step([part.column(part.schema.get_field_index(n)) for n in names], texts)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return bounded(df).select(*names, text).mapInArrow(run, parsed)
