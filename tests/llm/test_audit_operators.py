"""Dataset manifest and divergence audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from steward.llm import divergence_audit, merkle_manifest
from steward.llm.perfect_hash import PerfectHash


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """Root and, per leaf, the siblings (None for a lone node) with whether they stand left."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, path in enumerate(paths):
            other = at[i] ^ 1
            path.append((level[other] if other < len(level) else None, other < at[i]))
            at[i] //= 2
        level = [digest("".join(level[k: k + 2])) for k in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    leaf = lambda r: digest("".join(framed(v) for v in (r[0], r[3], r[2], r[4], r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of_lang = {}
    for lang in langs:
        members = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        of_lang[lang] = (members, *tree([leaf(r) for r in members]))
    root, above = tree([of_lang[x][1] for x in langs])
    out = []
    for lang, upper in zip(langs, above, strict=True):
        members, subroot, paths = of_lang[lang]
        for r, path in zip(members, paths, strict=True):
            steps = path + upper
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                changed = (*r[:4], r[4] + 1)
            fold = leaf(changed)
            for sibling, left in steps:
                fold = digest(fold if sibling is None else sibling + fold if left else fold + sibling)
            out.append((r[0], leaf(r), subroot, root, digest("".join(s for s, _ in steps if s)), fold, fold == root))
    return out


@pytest.mark.parametrize("tier", [10, 3])
def test_manifest(llm, monkeypatch, tier):
    monkeypatch.setattr(merkle_manifest, "TIER", tier)
    rnd = random.Random(tier)
    rows = [(i * 3, "é" * rnd.randrange(9) + "text " * rnd.randrange(5), rnd.choice(["en", "en", "en", "de", None, "ä", ""]), rnd.choice([None, "web"]), rnd.randrange(99))
            for i in range(90)]
    rows += [(1000, None, "en", None, None), (None, "a", "en", "x", 1), (None, None, None, None, None), (3, "other", "en", "x", 1), (2000, "long " * 30_000, "de", "x", 150_000),
             (3, "again", "fr", "x", 1), (3, "again", "fr", "x", 1), (4001, "lone", "zz", "x", 1)]
    docs = llm.createDataFrame([(*r, 7, "n") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rank int, digest string").repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0

    def audit(table):
        got = merkle_manifest.manifest(table, tampered, {"n_chars": F.col("n_chars") + 1})
        fold = merkle_manifest.folded(F.col("presented"), F.col("steps"))
        return got.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.siblings(F.col("steps")), 256), fold, fold == F.col("root")).collect()

    assert sorted(map(tuple, audit(docs)), key=str) == sorted(brute(rows), key=str)
    assert audit(docs.where("doc_id < 0")) == []
    assert [r[6] for r in audit(docs.where("doc_id = 4001"))] == [True]


def test_intervals_nest(llm):
    leaves = llm.range(37).select(F.lit(0).cast("long").alias("tree"), F.lit(37).cast("long").alias("n"), F.col("id").alias("lo"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    nodes, roots, steps = merkle_manifest.trees(leaves)
    found = {(r.level, r.lo): r for r in nodes.collect()}
    assert roots.count() == 1 and steps.count() == 37 and len(found) == 37 + 19 + 10 + 5 + 3 + 2 + 1
    for (level, lo), r in found.items():
        assert r.hi == min(lo + 2**level, 37)
        if level < 6:
            parent = found[level + 1, lo >> level + 1 << level + 1]
            assert parent.lo <= lo and r.hi <= parent.hi


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, least, top):
    frequency, counts = Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(CAPITALS))
        frequency.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    kept = defaultdict(set)
    for (lang, term), n in frequency.items():
        if n >= least:
            kept[lang].add(term)
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    for lang in {x for x, _ in counts}:
        terms, sources = kept[lang], sorted((s for x, s in counts if x == lang), key=str.encode)
        size = lambda c: sum(c[t] for t in terms)
        whole = sum((counts[lang, s] for s in sources), Counter())
        p = {s: {t: share(counts[lang, s][t], size(counts[lang, s]), len(terms)) for t in terms} for s in sources}
        for s in sources:
            order = lambda xs: sorted(xs, key=lambda x: (-x[1], x[0].encode()))
            pairs = order((o, sum(abs(p[s][t] - p[o][t]) for t in terms)) for o in sources if o != s)
            over = order((t, p[s][t] - q) for t in terms if counts[lang, s][t] and (q := share(whole[t], size(whole), len(terms))) < p[s][t])
            out += [(lang, s, "pair", o, v, k) for k, (o, v) in enumerate(pairs, 1)]
            out += [(lang, s, "term", o, v, k) for k, (o, v) in enumerate(over[:top], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(llm, monkeypatch, small):
    monkeypatch.setattr(divergence_audit, "LEAST", 3)
    if small:  # several shards, a round each, sorted pairs instead of dense slots, many blocks and tiles
        for name, value in {"SHARD_KEYS": 16, "ROUND_BYTES": 1000, "DENSE": 20, "TILE_SOURCES": 2, "BLOCK_SLOTS": 8, "TOP": 3}.items():
            monkeypatch.setattr(divergence_audit, name, value)
    rnd = random.Random(8)
    words = ["Alpha", "beta", "É", "é", "straße", "x" * 70, "x" * 71, "\u3000wide", *(f"{a}{b}" for a in "abcde" for b in "vwxyz")]
    rows = [(rnd.choice(["", " ", "7-"]).join(rnd.choice(words) + rnd.choice([" ", "\n", "_", "1"]) for _ in range(rnd.randrange(30))),
             rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["a", "b", "ä", "c", None, "a\0b"])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("Alpha", "rare", "one"), ("beta", "rare", "two"), ("...", "none", "only"), ("long " * 20_000, "en", "a"), rows[0], rows[0]]
    docs = llm.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = [tuple(r) for r in divergence_audit.audit(docs).collect()]
    want = audited(rows, 3, divergence_audit.TOP)
    assert sorted(got) == sorted(want)
    assert {r[2] for r in want} == {"pair", "term"}
    if small:
        assert divergence_audit.audit(docs.where("n < 0")).collect() == []


def test_perfect_hash_is_minimal_and_keys_are_verified():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 300, 50_000):
        hashes = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        perfect = PerfectHash.of(hashes)
        assert len(perfect) == len(hashes) and sorted(perfect.slots(hashes).tolist()) == list(range(len(hashes)))
    with pytest.raises(ValueError):
        PerfectHash.of(np.array([5, 5], np.uint64))
    keys = divergence_audit.keys_of(pa.array(["en"] * 40), pa.array([f"t{i}" for i in range(40)]))
    hashes = divergence_audit.key_hashes(keys)
    hashes[7] = hashes[8] = hashes[9]  # keys equal in hash
    rows = pa.table({"shard": pa.array([0] * 40), "h": pa.array(hashes.view(np.int64)), "key": keys.cast(pa.string())})
    row = next(divergence_audit.built(iter(rows.to_batches()))).to_pylist()[0]
    shard = divergence_audit.Shard(0, row["words"], row["starts"], row["keys"])
    assert len(shard) == 40 and sorted(shard.slots(hashes, keys).tolist()) == list(range(40))
    strangers = divergence_audit.keys_of(pa.array(["de"] * 40), pa.array([f"t{i}" for i in range(40)]))
    assert set(shard.slots(hashes, strangers).tolist()) == {-1}
