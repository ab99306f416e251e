"""Stage boundaries: results written to shared storage and read back.

A pipeline stage that several later steps need (the profile, the cleared sheets) is written once as
a table in the folder the cluster names in `spark.checkpoint.dir`. Later stages then start from
files with known sizes instead of repeating the work, and a lost executor costs its own tasks only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_directory(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. Without one only a local session may go on: its driver
    and executors are one process, so a temporary folder is shared storage."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        shared = _local.setdefault(application, "") or tempfile.mkdtemp(prefix="run-")
        _local[application] = shared
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Remove what this application staged, once no DataFrame that reads it is needed any more."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
    return len(paths)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table."""
    spark = df.sparkSession
    path = shared_directory(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
