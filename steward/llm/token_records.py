"""Token ids as length-delimited binary records, with a separate offset index.

A file is a run of frames, little-endian throughout:

    length   uint64   bytes of the payload
    check    uint32   masked CRC-32 of the 8 length bytes
    payload           doc_id int64, flags uint8 (1: no doc_id, 2: ids of 4 bytes), ids uint16 or uint32
    check    uint32   masked CRC-32 of the payload
    end      uint8    newline

Checksums are masked (rotated by 15 bits plus a constant), so that checksums of data that holds
checksums stay sound. The closing newline is the row end of Spark's text sink, which writes the files:
its commit protocol makes lost and repeated tasks harmless, on every file system Spark can write.

Files are in ascending doc_id order, file after file. The index has a row per record: file,
file_order, offset, length, doc_id, n_tokens, first_token (ids of the same file before it) and
ids_crc32; a shuffled reader seeks by it without touching other records.

Defined cases: a null text is the empty text and still gets its end id; null ids come first; rows
with one doc_id follow each other in text order; an empty table writes no record; other columns
aren't read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steward.llm.chunks import ChunkTable
from steward.llm.common import pieces, tasks_for, texts_of
from steward.staging import shared_directory, staged

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Size of a file's share of the input, and bytes of text that are encoded together.
FILE_BYTES, PIECE_BYTES = 12 << 20, 4 << 20
_HEAD, _CHECK, _ITEM = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB")
NO_ID, WIDE = 1, 2
INDEX = ("file string, offset long, length long, doc_id long, n_tokens long, first_token long, ids_crc32 long")
_encoders: dict[str, ChunkTable] = {}


def masked_check(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without its closing newline."""
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CHECK.pack(masked_check(head)), payload, _CHECK.pack(masked_check(payload))))


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Offset and payload of every frame; a damaged frame is an error."""
    at = 0
    while at < len(data):
        (length,) = _HEAD.unpack_from(data, at)
        if _CHECK.unpack_from(data, at + 8)[0] != masked_check(data[at: at + 8]):
            raise ValueError(f"damaged length at {at}")
        payload = data[at + 12: at + 12 + length]
        if _CHECK.unpack_from(data, at + 12 + length)[0] != masked_check(payload):
            raise ValueError(f"damaged record at {at}")
        yield at, payload
        at += length + 17


def tokenizer_encoder(path: str) -> ChunkTable:
    """Chunks through the tokenizers library; one encoder per worker process and file."""
    if path in _encoders:
        return _encoders[path]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    size = library.get_vocab_size(with_added_tokens=True)
    dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    opens = np.zeros(size, bool)  # ids whose bytes begin with a blank
    for token, i in library.get_vocab(with_added_tokens=False).items():
        opens[i] = token.startswith("Ġ")

    def encode(chunks: list[str]) -> list[np.ndarray]:
        found = library.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(x.ids, dtype) for x in found]

    _encoders[path] = ChunkTable(encode, opens, dtype.str)
    return _encoders[path]


def encoded_frames(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = tokenizer_encoder(tokenizer)
    width = WIDE if encoder.dtype.itemsize == 4 else 0
    end = np.array([end_id], encoder.dtype).tobytes()
    for batch in batches:
        for piece in pieces(batch, "text", PIECE_BYTES):
            ids, sizes = encoder.texts(texts_of(piece, "text"))
            body, step = ids.tobytes(), encoder.dtype.itemsize
            ends = np.cumsum(sizes) * step
            out = []
            for doc_id, a, b in zip(piece.column(0).to_pylist(), (ends - sizes * step).tolist(), ends.tolist(), strict=True):
                head = _ITEM.pack(doc_id or 0, width | (NO_ID if doc_id is None else 0))
                out.append(frame(b"".join((head, body[a:b], end))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode and write all texts in ascending doc_id order."""
    n = tasks_for(docs, FILE_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = ("doc_id", F.xxhash64("text"))  # the sample that finds the ranges holds keys only
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")
    made = ordered.mapInArrow(lambda batches: encoded_frames(batches, tokenizer, end_id), "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def scanned_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), *[pa.int64()] * 6]
    names = [x.split()[0] for x in INDEX.split(", ")]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, first = [], 0
            for at, payload in frames(memoryview(content.as_buffer())):
                doc_id, flags = _ITEM.unpack_from(payload)
                ids = np.frombuffer(payload[_ITEM.size:], "<u4" if flags & WIDE else "<u2")
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((file, at, len(payload), None if flags & NO_ID else doc_id, len(ids), first, crc))
                first += len(ids)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index, from the files: every checksum is verified on the way."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    order = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    return files.mapInArrow(scanned_files, INDEX).withColumn("file_order", order)


def token_starts(index: DataFrame) -> DataFrame:
    """The index with `start`, the ids of all records before each one."""
    files = index.groupBy("file_order").agg(F.sum("n_tokens").alias("in_file"))
    before = Window.orderBy("file_order").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file_order", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "file_order").withColumn("start", F.col("base") + F.col("first_token"))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the records and their index to shared storage, and read both."""
    spark = docs.sparkSession
    path = shared_directory(spark, "records")
    write_records(docs, path, tokenizer, end_id)
    return token_starts(staged(read_index(spark, path), "records-index"))
