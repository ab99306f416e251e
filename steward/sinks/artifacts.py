"""The four normalization outputs as one set."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from steward.functions.jsontext import canonical_json
from steward.schemas import ARTIFACTS


class OutputError(RuntimeError):
    """`code` is `OUTPUT_ALREADY_EXISTS` or `OUTPUT_WRITE_FAILED`."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _path(spark: SparkSession, *parts: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


#: The file that names the version in force.
POINTER = "artifact-set.current"


def _write_version(artifacts: dict[str, DataFrame], version: str, order: dict[str, list[str]]) -> None:
    for name, df in artifacts.items():
        keys = order[name]
        lines = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(canonical_json(df).alias("value"))
        lines.write.mode("errorifexists").text(f"{version}/{ARTIFACTS[name]}")


def _write_pointer(fs, path, version: str) -> None:
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()


def _publish(fs, staged, pointer) -> None:
    if fs.exists(pointer) or not fs.rename(staged, pointer):
        raise OutputError("OUTPUT_WRITE_FAILED")


def write_artifact_set(
    artifacts: dict[str, DataFrame], output_dir: str, order: dict[str, list[str]]
) -> None:
    """Write all artifacts under `output_dir` as canonical JSON lines, or none of them.

    The set is a folder of its own, `version-*`, and comes into force when one small file that names it,
    POINTER, is renamed into place as the last step. Readers follow that file, so there is no moment at
    which they see part of a set: a driver lost before the rename leaves a folder that nothing names and
    that does not hinder the next run, a driver lost after it leaves the whole set. Refused when a set is
    in force or a target by an artifact's own name exists. A failure removes what this run wrote.

    Rows are range-partitioned and sorted by `order[name]`, unique keys, so the concatenation of
    the part files is the same text on every run and nothing passes through one task.
    """
    spark = next(iter(artifacts.values())).sparkSession
    fs = _path(spark, output_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    pointer = _path(spark, output_dir, POINTER)
    if fs.exists(pointer) or any(fs.exists(_path(spark, output_dir, ARTIFACTS[name])) for name in artifacts):
        raise OutputError("OUTPUT_ALREADY_EXISTS")
    version = f"version-{uuid.uuid4().hex}"
    folder, staged = _path(spark, output_dir, version), _path(spark, output_dir, f"{version}.pointer")
    try:
        _write_version(artifacts, folder.toString(), order)
        _write_pointer(fs, staged, version)
        _publish(fs, staged, pointer)
    except Exception as error:
        for path in (folder, staged):
            fs.delete(path, True)
        raise OutputError("OUTPUT_WRITE_FAILED") from error


def read_artifact(spark: SparkSession, output_dir: str, name: str) -> DataFrame:
    """Lines of an artifact of the set in force, with `line`, their JSON text."""
    version = spark.read.text("/".join([output_dir.rstrip("/"), POINTER])).first()[0]
    text = spark.read.text("/".join([output_dir.rstrip("/"), version, ARTIFACTS[name]]))
    return text.select(F.col("value").alias("line"))
