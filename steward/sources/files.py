"""Raw files: bytes, sizes and digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from steward.schemas import HASH_CHUNK
from steward.session import ship_package

#: Files above this size are hashed in chunks instead of being held in one value. Values end at 2 GiB.
WHOLE_FILE_LIMIT = 1 << 30


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under `path` as `path, length, content`; bytes stay bytes, nothing is decoded."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content")


def relative_to(df: DataFrame, base: str) -> DataFrame:
    """`path` relative to the base directory, as manifests write it."""
    root = base.rstrip("/") + "/"
    start = F.expr(f"locate({root!r}, path)")
    return df.withColumn(
        "path", F.when(start > 0, F.expr(f"substring(path, locate({root!r}, path) + {len(root)})"))
        .otherwise(F.col("path"))
    )


def file_digests(files: DataFrame) -> DataFrame:
    """`path, length, sha256` of rows that carry their content."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _hash_in_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        digests = []
        for uri in batch["path"]:
            # The connector names of the session's file system, under the names this library knows.
            filesystem, inner = fs.FileSystem.from_uri(re.sub(r"^(?:s3a|s3n)://", "s3://", uri))
            digest = hashlib.sha256()
            with filesystem.open_input_stream(inner) as stream:
                while chunk := stream.read(HASH_CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pd.DataFrame(
            {"path": batch["path"], "length": batch["length"], "sha256": digests}
        )


def scan_file_digests(
    spark: SparkSession, base: str, glob: str | None = None,
    whole_file_limit: int = WHOLE_FILE_LIMIT,
) -> DataFrame:
    """Digest of every file under `base`.

    The size filter reaches the file listing, so big files are never loaded as one value: they
    are opened on the executors and hashed chunk by chunk.
    """
    files = read_files(spark, base, glob)
    small = file_digests(files.filter(F.col("length") <= whole_file_limit))
    big = files.select("path", "length").filter(F.col("length") > whole_file_limit)
    ship_package(spark)
    chunked = big.mapInPandas(_hash_in_chunks, "path string, length bigint, sha256 string")
    return relative_to(small.unionByName(chunked), base)
