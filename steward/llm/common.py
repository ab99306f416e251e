"""What the operators of this subpackage share: session set-up, text batches, registration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from steward.session import apply_settings, ship_package

#: Separators of words: blank and the control characters tab to carriage return.
BLANK = "[\\x09-\\x0D\\x20]+"
#: Bytes of an Arrow batch sent to Python, and of text worked on at once there.
BATCH_BYTES = 8 << 20

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register `(spark, sf_dir) -> DataFrame` under the function's name, with its SQL twin."""

    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = oracle.strip()
        return build

    return register


def prepare(spark: SparkSession) -> SparkSession:
    """Settings and code that tasks need."""
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, bytes_per_task: int = 32 << 20, least: int = 1) -> int:
    """Tasks for a shuffle of `df`, from the optimizer's size estimate (file sizes for a scan)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size >= 1 << 60:  # nothing is known of rows that don't come from files
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(100_000, -(-size // bytes_per_task)))


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls; null is the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def pieces(batch: pa.RecordBatch, name: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most `limit` bytes together; a longer text stands alone."""
    column = batch.column(batch.schema.get_field_index(name))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def blocks(batches: Iterator[pa.RecordBatch], name: str, piece: int, block: int) -> Iterator[list[pa.RecordBatch]]:
    """Pieces of at most `piece` bytes of text, in lists of at most `block` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in pieces(batch, name, piece):
            n = pc.sum(pc.binary_length(part.column(part.schema.get_field_index(name)))).as_py() or 0
            if held and size + n > block:
                yield held
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield held


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the n + 1 offsets of its values."""
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)
    ends = ends[column.offset: column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0]: ends[-1]], ends - ends[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over the whole range (the finalizer of a public 64-bit generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
