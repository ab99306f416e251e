"""Token records, merge replay and archives: exact round trips against the public libraries."""

import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from steward.llm import bpe_replay, chunks, token_records, warc_archive
from steward.staging import shared_directory

REPO = Path(__file__).resolve().parents[2]
PARTS = ["a", "b ", "  ", "\n", " \t", "é", "中", " ", "'s", "!!", "12", "<|endoftext|>", " ", " x", "\x1c", "​", "😀", "aaaa", "hello", "ing"]


def odd_texts(n=300):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40))) for _ in range(n)]
    return [*texts, "", " ", "  ", "a ", "\n", "a" * 3000, "ab" * 2000, " " * 999, None, "word " * 20_000]


def reference_ids(texts):
    path = public_tokenizers.path(bpe_replay.RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_replay.read_ranks(path), special_tokens={})
    return [known.encode_ordinary(t or "") for t in texts]


def test_replay_equals_library(llm):
    texts = odd_texts()
    docs = llm.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    path = public_tokenizers.path(bpe_replay.RANKS)
    out = bpe_replay.encoded_and_decoded(docs, path, public_tokenizers.PATTERN).collect()
    got = {r.carried.doc_id: r for r in out}
    for i, ids in enumerate(reference_ids(texts)):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert bytes(got[i].decoded).decode() == (texts[i] or "") and got[i].carried.ids == 5
    separate = bpe_replay.decoded(bpe_replay.encoded(docs, path, public_tokenizers.PATTERN), path)
    assert sorted(bytes(r.decoded) for r in separate.collect()) == sorted(bytes(r.decoded) for r in out)
    assert bpe_replay.tokens(docs.where("doc_id < 0"), path, public_tokenizers.PATTERN).count() == 0


def test_replay_order_of_merges():
    # "bc" comes before "ab"; "abc" splits two ways, and a later merge of lower rank must go first.
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"aa": 258, b"aaa": 259, b"abab": 300, b"ba": 298}
    known = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    replay = bpe_replay.Replay(ranks)
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 30))) for _ in range(500)]
    for word, got in zip(words, replay.words([w.encode() for w in words]), strict=True):
        want = known.encode_ordinary(word) if word.encode() not in ranks else None
        assert want is None or got == want
    assert replay.words([w.encode() for w in words]) == replay.one_by_one([w.encode() for w in words])


@pytest.mark.parametrize("limit", [2, 40, 10_000])
def test_chunk_table_equals_library(limit):
    # Words leave the dictionary and come back; runs in which an id count doesn't fit go word by word.
    path = public_tokenizers.path(token_records.TOKENIZER)
    library = Tokenizer.from_file(path)
    known = token_records.tokenizer_encoder(path)
    table = chunks.ChunkTable(known.encode, known.opens, known.dtype.str, limit)
    texts = [t or "" for t in odd_texts()] + [f"plain words {i % 7} and {'x' * (i % 90)} ends" for i in range(200)]
    for k in range(0, len(texts), 23):
        part = texts[k: k + 23]
        ids, sizes = table.texts(pa.array(part))
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(table.words) <= limit and table.texts(pa.array([], pa.string()))[0].tolist() == []


def test_records_round_trip(llm):
    texts = odd_texts(120)
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, texts[1], "x")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    path = public_tokenizers.path(token_records.TOKENIZER)
    library = Tokenizer.from_file(path)
    got = token_records.tokenized(docs, path).orderBy("start").collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t, _ in rows]
    want = sorted(((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids, strict=True)), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == want
    assert [r.start for r in got] == [sum(w[1] for w in want[:i]) for i in range(len(want))]
    r = got[5]  # seek by the index
    with open(r.file.removeprefix("file:"), "rb") as f:
        f.seek(r.offset)
        (_, payload), *_ = token_records.frames(memoryview(f.read(r.length + 17)))
    assert zlib.crc32(np.frombuffer(payload[9:], "<u2").astype("<u4").tobytes()) == r.ids_crc32
    assert token_records.tokenized(docs.where("doc_id < 0"), path).count() == 0


def test_damaged_record_is_found():
    good = token_records.frame(b"payload of a record") + b"\n"
    assert [bytes(p) for _, p in token_records.frames(memoryview(good * 2))] == [b"payload of a record"] * 2
    for at in (3, 9, 15, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.frames(memoryview(bytes(bad))))


def pages(llm):
    rnd = random.Random(9)
    body = lambda n: "<p>" + " ".join(rnd.choice(["ü", "alpha", "beta"]) + str(rnd.randrange(99)) for _ in range(n)) + "</p>"
    same, small = body(300), body(20)
    rows = [(i, f"http://h{i % 3}.org/{i}", body(rnd.randrange(400))) for i in range(80)]
    rows += [(100 + i, "http://x.org/\n y", same) for i in range(9)] + [(200 + i, None, small) for i in range(3)]
    rows += [(300, "u", None), (301, "u", ""), (None, "u", same), (108, "u", same), (400, "http://big.org", body(60_000))]
    return rows, llm.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(2)


def test_archive_round_trip(llm):
    rows, table = pages(llm)
    path = shared_directory(llm, "warc")
    warc_archive.write_archives(table, path)
    got = warc_archive.read_archives(llm, path).collect()
    assert len(got) == len(rows)
    html = {}
    for i, _, h in rows:
        html.setdefault(i, (h or "").encode())
    for r in got:
        data = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        revisit = (r.page_id is None or 100 <= r.page_id < 108)
        assert (r.record_type, r.refers_to) == (("revisit", 108) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else data)
    with open(got[0].file.removeprefix("file:"), "rb") as f:
        assert f.read(4) == bytes.fromhex("5d2a4d18")
    assert warc_archive.archive(table.where("page_id < 0")).count() == 0


def test_archive_without_dictionary():
    records = [b"x" * 10, b"", b"y" * 3000]
    sep = warc_archive.BETWEEN.encode()
    data = b"".join(f + sep for f in warc_archive.compressed(iter(records)))
    assert [r for _, r in warc_archive.file_records(memoryview(data))] == records


def test_texts_by_chunks_of_slices():
    encoder = token_records.tokenizer_encoder(public_tokenizers.path(token_records.TOKENIZER))
    texts = [t or "" for t in odd_texts(50)]
    whole, sizes = encoder.texts(pa.array(texts))
    part, _ = encoder.texts(pa.array(texts).slice(10, 20))
    assert part.tolist() == whole[sizes[:10].sum(): sizes[:30].sum()].tolist()


REPLAYED = """
import random, re, sys
import pyarrow as pa, public_tokenizers
from steward.llm import bpe_replay

rnd = random.Random(9)
def batches(n):
    for _ in range(n):
        texts = [" ".join("".join(rnd.choices("etaoinshrdlu", k=8)) for _ in range(100)) for _ in range(500)]
        yield pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], ["carried", "text"])

path = public_tokenizers.path(bpe_replay.RANKS)
rows = sum(len(b) for b in bpe_replay.encoded_batches(batches(int(sys.argv[1])), path, public_tokenizers.PATTERN))
print(rows, int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10)
"""


def test_memory_of_a_replay():
    # All words are new. A worker holds a bounded part of the texts at a time: several of them share an executor with its heap.
    peaks = []
    for n in (8, 20):
        out = subprocess.run([sys.executable, "-c", REPLAYED, str(n)], capture_output=True, text=True, check=True, cwd=REPO).stdout
        rows, peak = map(int, out.split())
        assert rows == 500 * n
        peaks.append(peak)
    assert peaks[1] < 1.25 * peaks[0] and peaks[1] < 400, peaks
