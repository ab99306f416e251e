"""WARC archives in Zstandard with a dictionary of their own records.

Each file starts with a skippable frame that holds a Zstandard dictionary, trained on the first
records of that file (at most SAMPLE_BYTES of them); every record is then a frame of its own,
compressed with that dictionary, so any record can be read alone. Between frames stands an empty
skippable frame: it is the row end of Spark's text sink, which writes the files, so that the commit
protocol makes lost and repeated tasks harmless on every file system Spark can write.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest page_id is the
response, the others are revisits that refer to it. Groups are found by digest and length alone: the
payloads themselves are shuffled once at most, by page.

Defined cases: a null html is an empty payload; a null page_id is smaller than any other; rows that
tie for the largest page_id are all responses; a null url is written as `urn:page:<id>`; a file with
too little to train on has no dictionary frame; an empty table writes no record; other columns
aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steward.llm.common import tasks_for, texts_of
from steward.staging import shared_directory

MIN_REVISIT = 1000
NO_ID = -(1 << 63)
#: Of each file: bytes of records its dictionary is trained on, and the dictionary's largest size.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 48 << 10
FILE_BYTES, LEVEL = 8 << 20, 3
DATE = "1970-01-01T00:00:00Z"
DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame (magic number 0x184D2A50, length 0); all its bytes are ASCII.
BETWEEN = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "url string, file string, offset long, payload binary")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16])}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    address = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples, or None where they are too few."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if size < 1024 or len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, f=18, accel=5)
    except zstandard.ZstdError:
        return None


def compressed(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one file: the dictionary's, then one per record."""
    first, held = [], 0
    for record in records:
        first.append(record)
        held += len(record)
        if held >= SAMPLE_BYTES:
            break
    dictionary = trained(first)
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    if dictionary is not None:
        body = dictionary.as_bytes()
        yield struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
    for record in first:
        yield writer.compress(record)
    first.clear()
    for record in records:
        yield writer.compress(record)


def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for batch in batches:
            page_id, url, digest, refers_to = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "digest", "refers_to"))
            payload = texts_of(batch, "html").cast(pa.binary())
            for row in zip(page_id, url, payload, digest, refers_to, strict=True):
                yield warc_record(*(x.as_py() for x in row))

    out, held = [], 0
    for frame in compressed(records()):
        out.append(frame)
        held += len(frame)
        if held >= 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def with_referrals(pages: DataFrame, tasks: int) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses), dealt by page and digest: the one
    shuffle of payloads serves the join and sizes the files."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html",
                        F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    keys = rows.where(size >= MIN_REVISIT).select("page_id", "digest", size.alias("size"))
    groups = keys.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = groups.where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    older = F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))
    page = F.coalesce("page_id", F.lit(NO_ID)).alias("page")
    revisits = keys.join(groups, ["digest", "size"]).where(older).select(page, "digest", "refers_to").distinct()
    dealt = rows.select("*", page).repartition(tasks, "page", "digest")
    return dealt.join(revisits, ["page", "digest"], "left").drop("page")


def write_archives(pages: DataFrame, path: str) -> None:
    frames = with_referrals(pages, tasks_for(pages, FILE_BYTES)).mapInArrow(archived, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, by its header and block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    at_block = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[at_block: at_block + 3], "little")
        at_block += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at_block + (4 if flags & 4 else 0)


def file_records(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every record of an archive."""
    reader, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        magic, length = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8: at + 8 + length])))
            at += 8 + length
            continue
        end = frame_end(data, at)
        yield at, reader.decompress(data[at:end])
        at = end


def parsed(record: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("WARC-Page-ID"), length, digest, kind, number("WARC-Refers-To-Page-ID"), fields["WARC-Target-URI"], payload


def unpacked(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, held = [], 0
            for at, record in file_records(memoryview(content.as_buffer())):
                *fields, payload = parsed(record)
                rows.append((*fields, file, at, payload if payloads else None))
                held += len(payload) if payloads else 0
                if held > 4 << 20 or len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: its fields, place and, where wanted, payload; digests are verified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: unpacked(batches, payloads), RECORDS)


def archive(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write all pages to archives in shared storage and read them back."""
    spark = pages.sparkSession
    path = shared_directory(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads)
