"""Near duplicates, repeated strings, embeddings and languages against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from steward.llm import language_fusion, near_embeddings, shingles, suffix_dedup, super_kmers, super_minhash
from steward.llm.components import components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return words


@pytest.mark.parametrize("block", [256, 8])
def test_near_documents(documents, monkeypatch, block):
    monkeypatch.setattr(super_minhash, "BLOCK", block)
    rnd = random.Random(block)
    word = lambda: f"v{rnd.randrange(3000)}"
    base = [word() for _ in range(150)]
    rows = [(i, " ".join(edited(rnd, base, rnd.randrange(0, 9))), "s") for i in range(60)]
    rows += [(100 + i, " ".join(word() for _ in range(rnd.randrange(1, 60))), "s") for i in range(40)]
    rows += [(200 + i, "\t".join(base).upper() + "\n", "s") for i in range(5)]
    rows += [(300, None, "s"), (301, "", "s"), (302, " \n", "s"), (303, "One two", "s"), (304, "one  two", "s"), (305, "ÜBER one", "s"),
             (306, "über one", "s"), (307, "a b c d", "s"), (308, "a b c d e", "s"), (303, "One two", "s"), (400, "long " + " ".join(word() for _ in range(20_000)), "s")]
    sets = {}
    for i, text, _ in rows:
        w = SPLIT.findall(lower(text or ""))
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots_of(ids, links)
    got = super_minhash.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id]), r
    if block == 8:
        kept = super_minhash.unique_documents(documents(rows))
        assert {r.doc_id for r in kept.collect()} == {i for i in ids if want[i] == i} and "kept" in kept.columns
        assert super_minhash.near_duplicates(documents(rows).where("doc_id < 0")).count() == 0


def test_pipeline_takes_near_documents_from_080(llm, documents):
    words = [f"n{i}" for i in range(150)]
    other = [*words[:40], "x", *words[41:80], "y", *words[81:120], "z", *words[121:]]  # 146 shingles each, 131 shared: 0.814
    rows = [(1, " ".join(words), "s"), (2, " ".join(other), "s"), (3, " ".join(reversed(words)), "s")]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(llm, documents(rows), "").collect()} == {1, 3}
    assert {r.doc_id for r in super_minhash.unique_documents(documents(rows)).collect()} == {1, 2, 3}


def test_one_row_of_each_group_stays(documents):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(1, a, "s"), (1, a, "t"), (2, a, "s"), (None, a, "s"), (None, b, "s"), (None, b.upper(), "s"), (None, b, "s"), (3, c, "s"),
            (4, "", "s"), (None, None, "s"), (None, None, "s"), (5, d, "s"), (5, d, "s")]
    docs = documents(rows)
    out = super_minhash.unique_documents(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (None, b), (3, c), (4, ""), (None, ""), (None, ""), (5, d)], key=str)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100, dtype=np.uint64)])
    small = [np.sort(a[:n]) for n in (1, 2, 3, 130)]
    s = super_minhash.signatures([a, b, *small])
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15
    assert (super_minhash.signatures([small[2]])[0] == s[4]).all()
    steps = np.sort(s[2] >> np.uint64(48))  # one element offers every step once
    assert steps.tolist() == list(range(super_minhash.SIGNATURE))


def test_component_chains(llm):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(500, 500), (7, 100)]
    edges = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in edges]
    want = roots_of({x for e in edges for x in e} - {500}, edges[:-2] + edges[-1:])
    got = components(llm.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert components(llm.createDataFrame([], "u long, v long")).count() == 0


def without_repeats(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            s = data[k: k + length]
            if s in seen:
                gone[k: k + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, text] = (len(data), sum(gone), spans, bytes(x for x, y in zip(data, gone, strict=True) if not y))
    return out


def test_repeated_strings(documents):
    rnd = random.Random(5)
    some = lambda n: " ".join(rnd.choice(["alpha", "beta", "é", "delta"]) + str(rnd.randrange(40)) for _ in range(n))
    base = [some(60) for _ in range(8)]
    rows = []
    for i in range(90):
        b, kind = rnd.choice(base), rnd.randrange(6)
        at = rnd.randrange(len(b))
        rows.append((i * 2, [b, some(9) + b[at: at + rnd.randrange(60, 300)] + some(9) + rnd.choice(base)[:150], "ab" * rnd.randrange(150),
                             some(rnd.randrange(1, 120)), some(3) + b[:130] + some(2), b + b[5:]][kind]))
    rows += [(1000, None), (1001, ""), (1002, "x" * 99), (1003, "y" * 300), (1004, "y" * 100), (4, rows[2][1]), (1003, "z" * 120),
             (1005, "q" * 130 + "long" + some(9000)), (None, base[0]), (2001, base[0])]
    want = without_repeats(rows)
    table = documents([(i, t, "s") for i, t in rows])
    got = suffix_dedup.without_repeats(table).collect()
    assert len(got) == len(rows)
    wanted = sorted(((i is not None, i or 0, *want[i, t][:3], want[i, t][3]) for i, t in rows), key=str)
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got), key=str) == wanted
    assert suffix_dedup.without_repeats(table.where("doc_id < 0")).count() == 0


def test_bucket_pointers_sort_into_classes():
    rng = np.random.default_rng(2)
    block = rng.integers(97, 100, 400).astype(np.uint8)
    body = np.concatenate([block, rng.integers(97, 100, 50).astype(np.uint8), block])
    starts = np.arange(len(body) - 99)
    classes = suffix_dedup.string_classes(body, starts, np.ones(len(body), bool))
    strings = [body[i: i + 100].tobytes() for i in starts]
    assert len(set(zip(classes.tolist(), strings, strict=True))) == len(set(strings)) == len(set(classes.tolist()))


@pytest.mark.parametrize("members, asking", [(1024, 4096), (7, 11)])
def test_near_embeddings(llm, monkeypatch, members, asking):
    monkeypatch.setattr(near_embeddings, "MEMBERS", members)
    monkeypatch.setattr(near_embeddings, "ASKING", asking)
    rng = np.random.default_rng(6)
    rows, centre = [], rng.standard_normal((30, 24))
    for i in range(400):
        x = centre[0 if i % 3 == 0 else rng.integers(30)] + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.25])
        rows.append((i, [float(np.float32(v)) for v in x * rng.uniform(0.1, 9)], int(rng.integers(3))))
    odd = [None, [], [0.0] * 24, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, rows[0][1][:12], rows[0][1][:12]]
    rows += [(500 + k, v, 0) for k, v in enumerate(odd)]
    rows += [(600, rows[1][1], rows[1][2]), (601, rows[1][1], rows[1][2]), (602, rows[1][1], None), (603, [None] + [1.0] * 23, 1)]
    good = {i: np.array(v) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: y for i, _, y in rows}
    links = []
    for a in good:
        for b in good:
            if a < b and label[a] == label[b] and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.93:
                    links.append((a, b))
    want = roots_of([r[0] for r in rows], links)
    table = llm.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    got = {r.vec_id: r for r in near_embeddings.near_duplicates(table).collect()}
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert 0.99 * 2 * len(links) <= found <= 2 * len(links)
    counts = dict.fromkeys(got, 0)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    assert all(got[i].n_links <= counts[i] for i in got)
    if found == 2 * len(links):
        assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert near_embeddings.near_duplicates(table.where("vec_id < 0")).count() == 0


def test_languages(llm):
    rnd = random.Random(9)
    speech = {"xx": ["lorem", "dolor", "amet"], "yy": ["kvik", "zjom", "wrak"], "zz": ["bao", "dei", "fou"]}
    say = lambda k, n: " ".join(rnd.choice(speech[k]) + rnd.choice("aeiou") for _ in range(n))
    docs = llm.createDataFrame([(i, say(k := "xyz"[i % 3] * 2, 60), k) for i in range(90)] + [(99, None, "xx"), (100, "t", None)], "doc_id long, text string, lang string")
    rows, truth = [], {}
    for i in range(240):
        k = "xyz"[i % 3] * 2
        truth[i] = k
        short = i % 8 == 0  # nothing to read: declaration and host must do
        declared = "" if i % 16 == 0 else f' lang="{k}"'
        rows.append((i, f"https://{k}{i % 4}.{k}host.{k}/p{i}", f"<html{declared}><script>{say('xx', 30)}</script><p>{'' if short else say(k, 25)}</p></html>"))
    rows += [(900, None, None), (901, "no host", ""), (902, "http://u@Xx1.xxhost.xx:80/", "<p></p>"), (5, rows[5][1], rows[5][2])]
    pages = llm.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int").repartition(3)
    got = language_fusion.languages_of(pages, docs).collect()
    assert len(got) == len(rows)
    right = [r.language == truth[r.page_id] for r in got if r.page_id in truth]
    assert sum(right) >= 0.99 * len(right)
    by_id = {r.page_id: r for r in got}
    assert by_id[902].host == "xx1.xxhost.xx" and by_id[902].language == "xx"
    assert by_id[900].language in speech and all(0 < r.posterior <= 1.000001 for r in got)
    assert language_fusion.languages_of(pages.where("page_id < 0"), docs).count() == 0
    assert language_fusion.languages_of(pages, docs.where("doc_id < 0")).where("language IS NOT NULL").count() == 0


def test_labelled_documents_count_whole(llm, monkeypatch):
    monkeypatch.setattr(language_fusion, "HELD_LANGUAGES", 1)
    rows = [(1, "one two " * 4000 + "kvik zjom wrak", "xx"), (2, "bao dei é", "yy"), (3, "", "yy"), (4, "kvik " * 9, "xx"), (5, "a", "zz")]
    languages, model = language_fusion.trigram_model(llm.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1))
    want = np.full((3, language_fusion.SLOTS), 0.05)
    for _, text, lang in rows:
        for slot in language_fusion.trigram_slots(np.frombuffer(text.encode(), np.uint8)).tolist():
            want[languages.index(lang), slot] += 1
    assert languages == ["xx", "yy", "zz"]
    assert np.allclose(np.exp(model), want / want.sum(axis=1, keepdims=True))


def test_every_label_is_a_language(llm):
    rnd = random.Random(12)
    names = [a + b for a in "abcdefghi" for b in "klmnopqr"]  # 72 labels
    vocabulary = {k: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for k in names}
    say = lambda k, n: " ".join(rnd.choice(vocabulary[k]) for _ in range(n))
    docs = llm.createDataFrame([(i, say(k, 40), k) for i, k in enumerate(names * 2)], "doc_id long, text string, lang string")
    pages = llm.createDataFrame([(i, f"https://{k}.example/", f'<html lang="{k}"><p>{say(k, 30)}</p></html>') for i, k in enumerate(names)],
                                "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.language for r in language_fusion.languages_of(pages, docs).collect()}
    assert got == dict(enumerate(names))


def test_shingles_of_odd_texts():
    import pyarrow as pa

    texts = ["", "a", "a b c d e", "A B\tC\nD\x0bE", " a  b c d e f ", "ß é"]
    sets = shingles.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [0, 1, 1, 1, 2, 1]
    assert (sets[2] == sets[3]).all() and sets[2][0] in sets[4]
    assert (shingles.shingle_sets(pa.array(texts).slice(2, 2))[1] == sets[3]).all()


def without_windows(rows, length=35):
    texts = [SPLIT.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[k: k + length]) for w in texts for k in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k: k + length])] > 1:
                gone[k: k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeated_windows(documents, monkeypatch, hot):
    monkeypatch.setattr(super_kmers, "HOT", hot)
    rnd = random.Random(hot)
    some = lambda n: [rnd.choice(["alpha", "Beta", "é", "délta"]) + str(rnd.randrange(30)) for _ in range(n)]
    base, line = [some(90) for _ in range(6)], some(20)
    rows = []
    for i in range(120):
        b, at = rnd.choice(base), rnd.randrange(60)
        words = [b, some(9) + b[at: at + rnd.randrange(20, 60)] + some(9) + rnd.choice(base)[:40], ["a", "b"] * rnd.randrange(60),
                 some(rnd.randrange(1, 60)), some(20) + line + some(20), some(30) + b[:35] + some(2), b + some(1) + b][rnd.randrange(7)]
        rows.append((i * 2, rnd.choice([" ", "\n", " \t\x0b"]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, " ".join(["y"] * 35)), (1004, " ".join(["y"] * 34)), (1005, " ".join(["z"] * 36)),
             (None, " ".join(base[0])), (None, " ".join(base[0])), (4, rows[2][1]), rows[7], rows[7], (1006, " ".join(["q"] * 40 + some(9000))), (1007, " ".join(some(40))),
             (1008, "\u00a0".join(base[1]) + " tail")]
    rows += [(1009, rows[-2][1].upper()), (1010, "\x00 " + rows[-2][1])]
    table = documents([(i, t, "s") for i, t in rows])
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in super_kmers.without_repeats(table).collect()]
    assert sorted(got, key=str) == sorted(without_windows(rows), key=str)
    if hot == 3:
        assert super_kmers.without_repeats(table.where("doc_id < 0")).count() == 0


def test_windows_are_counted_across_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(super_kmers, "SORTED_BYTES", 1)
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(3, 41))
    schema = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("single", pa.bool_()), ("times", pa.int64()), ("row", pa.int64()), ("place", pa.int64())])
    place = lambda first: (first << 6 | 1) << 12
    rows = [(1, a.encode(), False, 1, 10, place(0)), (1, b.encode(), False, 1, 11, place(100)), (2, a.encode(), False, 1, 12, place(0)),
            (3, b"s", True, 1, 20, place(0)), (3, b"s", True, 1, 21, place(5)), (3, b"s", True, 2, None, None), (4, b"t", True, 1, 22, place(0)),
            (5, b"u", True, 2, None, None), (5, b"u", True, 1, 23, place(7)), (6, None, False, 2, 30, place(9))]
    batches = [pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(r, schema, strict=True)], schema=schema) for r in rows]
    found = sorted((r["row"], r["place"] >> 18, r["place"] >> 12 & 63) for out in super_kmers.counted(iter(batches)) for r in out.to_pylist())
    assert found == [(10, 3, 3), (11, 100, 3), (20, 0, 1), (21, 5, 1), (23, 7, 1), (30, 9, 1)]


def test_visible_text_equals_one_pattern():
    pattern = re.compile(r"<(script|style|noscript|nav|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.DOTALL | re.IGNORECASE)
    parts = ["<script>", "<SCRIPT a='>'", "</script >", "</Script", "<nav", "</nav>", "<navy>", "<!--", "-->", "<", ">", "</", "text ", "é", "<p>", "<style>", "</style>", "-", "\n"]
    rnd = random.Random(5)
    for _ in range(20_000):
        html = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert language_fusion.visible(html) == pattern.sub(" ", html), html


@pytest.mark.parametrize("part", ["<script>", "<!--", "<", "<html ", "</script ", "<html lang=", "<nav></na>", "<html lang=  ", "lang" + " " * 50, "<html>"])
def test_long_pages_take_time_in_proportion(part):
    page = part * (1_000_000 // len(part))
    begun = time.process_time()
    language_fusion.visible(page)
    language_fusion.declared_language(page)
    language_fusion.declared_language("<html lang=" + " " * 500_000)
    assert time.process_time() - begun < 5


def test_declared_language():
    cases = {"<html lang=en>": "en", "<html data-lang=fr>": None, "<html data-lang=fr lang='DE'>": "de", "<html><HTML class=x lang = \" pt-BR\">": "pt",
             "<htmllang=en>": None, "<html lang=english>": None, "": None, "<html lang=es": "es", "<html x>lang=en": None, "<html xml:lang=it>": "it"}
    assert {html: language_fusion.declared_language(html) for html in cases} == cases


def test_fused_posterior_equals_brute_force(llm):
    words = {"de": "der hund und die katze ", "en": "the dog and the cat ", "fr": "le chien et la chatte "}
    docs = llm.createDataFrame([(i, w * 5, lang) for i, (lang, w) in enumerate(list(words.items()) * 4)], "doc_id long, text string, lang string")
    rnd = random.Random(9)
    hosts = ["a.site.de", "b.site.de", "news.org.fr", "x.com", "y.com"]
    rows = []
    for i in range(80):
        lang = rnd.choice(list(words))
        head = rnd.choice(["<html>", f"<html lang={lang}>", "<html lang='en'>", "<p data-lang=fr>"])
        rows.append((i, f"https://{rnd.choice(hosts)}/{i}", head + words[lang][: rnd.randrange(24)] + "</html>"))
    rows += [(80, None, None), (81, "https://x.com/", ""), (82, "no host", "<!-- the dog"), (83, rows[0][1], rows[0][2])]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(3)

    languages, model = language_fusion.trigram_model(docs)
    n = len(languages)
    facts = {}
    for page, url, html in rows:
        html = html or ""
        slots = language_fusion.trigram_slots(np.frombuffer(language_fusion.visible(html).encode(), np.uint8))
        scores = sum((model[:, s] for s in slots), np.zeros(n)) * min(1, 60 / max(1, len(slots)))
        host = url.split("/")[2] if url and "//" in url else ""
        labels = host.split(".")
        found = np.exp(scores - scores.max())
        facts[page] = (found / found.sum(), language_fusion.declared_language(html), host, ".".join(labels[-2:]), labels[-1])

    def total(place=None, key=None):
        return sum((f[0] for f in facts.values() if place is None or f[place] == key), np.zeros(n))

    def smooth(counts, wider, weight=4.0):
        return (counts + weight * wider) / (counts.sum() + weight)

    said = {d: total(1, d) for d in {f[1] for f in facts.values()} - {None}}
    by_language = sum(said.values(), np.zeros(n))
    got = {r.page_id: r for r in language_fusion.languages_of(pages, docs).collect()}
    assert set(got) == set(facts)
    for page, (found, declared, host, domain, suffix) in facts.items():
        wider = smooth(total(3, domain), smooth(total(4, suffix), smooth(total(), np.full(n, 1 / n))))
        logs = np.log(smooth(np.maximum(total(2, host) - found, 0), wider) + 1e-12) + np.log(found + 1e-12)
        if declared is not None:
            guess = np.array([0.5 if x == declared else 0.5 / len(said) for x in languages])
            logs += np.log((said[declared] + 2 * guess) / (by_language + 2) + 1e-12)
        r = got[page]
        assert r.host == host and r.declared == declared
        assert r.posterior == pytest.approx(1 / np.exp(logs - logs.max()).sum(), rel=1e-9)
        assert logs[languages.index(r.language)] == pytest.approx(logs.max(), rel=1e-12)
