"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = "8m"
#: Runtime settings. AQE coalesces small shuffles, splits hot join partitions and replans small
#: sides to broadcast from their *measured* size, so no operator hard-codes a partition count or
#: a broadcast hint for data that grows.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # File scanners receive whole files as binary columns: bound a batch by bytes, not by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, which the file scanners run in; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="run-")) / "steward_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at a time by its bytes, also in a session that a cluster brought:
    whole files come as values, and ten thousand of them are too much for one worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` hashed by its keys over as many partitions as the session shuffles into. Adaptive execution leaves them
    apart, and whatever is joined on the keys follows: for rows that take far more memory than shuffled bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the settings above on a session that a cluster brought; the operators' claims rest on them."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "steward", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STEWARD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
