"""Language of web pages by Bayesian fusion of their evidence.

Four kinds of evidence meet in one posterior per page:
* text: letter-trigram likelihoods of the visible text, from labelled documents, tempered by the
  number of trigrams, which aren't independent;
* declared markup language: how often pages of a language declare which one;
* host: how the pages of the same host spread over languages, without the page itself; its prior is
  the spread of the registered domain, that of the domain's prior the address suffix, and that of the
  suffix all pages (additive smoothing at each step).
Both tables are grouped sums of the text posteriors of all pages, so no label of a page is needed and
hosts of any size cost a partial sum per task. Only the trigram model is fitted on a sample.

Defined cases: a null or empty html has no text and no declaration; a null url, or one without host,
belongs to the empty host; a page without any evidence gets the corpus's commonest language; ties go
to the first language by name; without labelled documents there is no language to choose and the
result is null; repeated rows are judged each and count each; an empty table gives an empty result;
other columns aren't read. Pages of any length and form take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steward.llm.common import mixed, pieces, texts_of
from steward.staging import staged

#: Labelled documents of each language that the trigram model is fitted on (expected number). They and
#: the pages are read whole.
SAMPLE = 200
SLOTS = 1 << 14
#: Weight of the wider level in a host's, domain's and suffix's spread; pseudo-counts of declarations.
PRIOR_WEIGHT, DECLARED_WEIGHT = 4.0, 2.0
#: A text's likelihood counts as that of so many independent trigrams at most.
EVIDENCE_TRIGRAMS = 60
TEXTS = "row long, url string, declared string, n_trigrams long, posterior array<double>"
_SKIPPED = "script|style|noscript|nav|template"
_OPENING = re.compile(rf"<(?:({_SKIPPED})\b|!--)", re.IGNORECASE)
_CLOSING = re.compile(rf"</({_SKIPPED})\s*+>", re.IGNORECASE)
_HTML = re.compile(r"<html\b", re.IGNORECASE)
_LANG = re.compile(r"(?<![\w-])lang\s*+=\s*+(?:[\"']\s*+)?([A-Za-z]{2,3})\b", re.IGNORECASE)
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"): ord("z") + 1] = True
_LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_LOWER[~_LETTER[_LOWER]] = ord(" ")


def trigram_slots(body: np.ndarray) -> np.ndarray:
    """Slot of each byte trigram of lower-cased text; everything but letters is a blank."""
    x = _LOWER[body].astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    grams = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
    grams = grams[grams != np.uint64(0x202020)]
    return (mixed(grams) % np.uint64(SLOTS)).astype(np.int64)


#: Languages whose counts a task holds before it sends them.
HELD_LANGUAGES = 64


def label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of the texts of rows (lang, text) by language and slot."""
    held: dict[str, np.ndarray] = {}

    def sent() -> pa.RecordBatch:
        slots = [np.flatnonzero(x) for x in held.values()]
        langs = [lang for lang, s in zip(held, slots, strict=True) for _ in range(len(s))]
        counts = [x[s] for x, s in zip(held.values(), slots, strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(slots), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], ["lang", "slot", "n"])

    for batch in batches:
        for piece in pieces(batch, "text", 4 << 20):
            for lang, text in zip(piece.column(0).to_pylist(), texts_of(piece, "text"), strict=True):
                if lang not in held and len(held) >= HELD_LANGUAGES:
                    yield sent()
                body = np.frombuffer(text.as_buffer() or b"", np.uint8)
                counts = np.bincount(trigram_slots(body), minlength=SLOTS)
                held[lang] = held[lang] + counts if lang in held else counts
    if held:
        yield sent()


def trigram_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the log-probability of each slot in each of them."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    most = labelled.groupBy("lang").count().collect()  # one row per language, all of them
    languages = sorted(r.lang for r in most)
    table = np.full((len(languages), SLOTS), 0.05)
    if not languages:
        return languages, table
    # One scan draws about SAMPLE documents of every language by hash.
    share = F.coalesce(*(F.when(F.col("lang") == r.lang, F.lit(SAMPLE / r["count"])) for r in most))
    drawn = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1_000_000)) < 1_000_000 * share
    counts = labelled.where(drawn).select("lang", "text").mapInArrow(label_counts, "lang string, slot long, n long")
    sums = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most a row per language and slot
    number = {lang: i for i, lang in enumerate(languages)}
    rows = np.array([number[lang] for lang in sums["lang"].to_pylist()], np.int64)
    table[rows, sums["slot"].to_numpy()] += sums["n"].to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def visible(html: str) -> str:
    """The text outside tags, comments and elements that hold no prose; what is dropped becomes a blank.

    An element or comment that is never closed is a tag only, and a `<` that no `>` follows is text. Every
    search goes on where the last one of its kind ended, so the time is in proportion to the page.
    """
    closings: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSING.finditer(html):
        closings.setdefault(m[1].lower(), []).append(m.span())
    for spans in closings.values():
        spans.reverse()  # the next one last
    out, at, comments = [], 0, True
    start = html.find("<")
    while start >= 0:
        stop = -1
        opening = _OPENING.match(html, start)
        if opening and opening[1]:
            spans = closings.get(opening[1].lower(), [])
            while spans and spans[-1][0] < opening.end():
                spans.pop()
            if spans:
                stop = spans[-1][1]
        elif opening and comments:
            stop = html.find("-->", opening.end()) + 3
            comments = stop > 2
        if stop < 3:
            stop = html.find(">", start) + 1
            if not stop:
                break
        out += (html[at:start], " ")
        at, start = stop, html.find("<", stop)
    return "".join((*out, html[at:]))


def declared_language(html: str) -> str | None:
    """The `lang` of the first html tag that has one, in lower case."""
    tag = _HTML.search(html)
    while tag:
        end = html.find(">", tag.end())
        m = _LANG.search(html, tag.end(), len(html) if end < 0 else end)
        if m or end < 0:
            return m[1].lower() if m else None
        tag = _HTML.search(html, end)
    return None


def text_posteriors(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in TEXTS.split(", ")]
    for batch in batches:
        for piece in pieces(batch, "html", 4 << 20):
            pages = texts_of(piece, "html").to_pylist()
            declared, counts, posteriors = [], [], []
            for html in pages:
                declared.append(declared_language(html))
                slots = trigram_slots(np.frombuffer(visible(html).encode(), np.uint8))
                times = np.bincount(slots, minlength=SLOTS)
                seen = np.flatnonzero(times)  # bounds the work by the model, however long the page
                scores = model[:, seen] @ times[seen]
                scores = scores * min(1.0, EVIDENCE_TRIGRAMS / max(1, len(slots)))
                weights = np.exp(scores - scores.max()) if len(scores) else scores
                counts.append(len(slots))
                posteriors.append(weights / weights.sum() if len(weights) else weights)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(declared, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(posteriors, pa.list_(pa.float64()))], names)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"\.$", "")


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def vector_sum(column: str, languages: int) -> list[Column]:
    return [F.sum(F.get(column, F.lit(i))).alias(f"{column}_{i}") for i in range(languages)]


def spreads(pages: DataFrame, keys: list[str], languages: int, name: str) -> DataFrame:
    """Sums of the text posteriors by key, as one array."""
    sums = pages.groupBy(*keys).agg(*vector_sum("posterior", languages))
    return sums.select(*keys, F.array(*(F.col(f"posterior_{i}") for i in range(languages))).alias(name))


def smoothed(counts: Column, wider: Column, weight: float) -> Column:
    """(counts + weight * wider) / (their total + weight)."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x, i: (x + weight * F.get(wider, i)) / (total + weight))


def languages_of(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Per page: page_id, language, posterior, and what each kind of evidence says alone."""
    languages, model = trigram_model(docs)
    if not languages:
        empty = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), empty.alias("language"), F.lit(None).cast("double").alias("posterior"),
                            empty.alias("text_language"), empty.alias("declared"), host_of(F.col("url").cast("string")).alias("host"))
    n = len(languages)
    rows = pages.select(F.col("page_id").cast("long").alias("row"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    texts = rows.mapInArrow(lambda batches: text_posteriors(batches, model), TEXTS)
    host = host_of(F.col("url"))
    scored = staged(texts.select(
        "row", "declared", "n_trigrams", "posterior", host.alias("host"), last_labels(host, 2).alias("domain"), last_labels(host, 1).alias("suffix")), "page-texts")

    def no_nulls(counts: Column) -> Column:
        return F.transform(counts, lambda x: F.coalesce(x, F.lit(0.0)))

    even = F.array(*[F.lit(1.0 / n)] * n)
    everything = spreads(scored, [], n, "counts").select(smoothed(no_nulls(F.col("counts")), even, PRIOR_WEIGHT).alias("spread"))
    flat = F.array(*(F.lit(float(x)) for x in everything.first()["spread"]))  # one number per language
    suffixes = spreads(scored, ["suffix"], n, "counts").select("suffix", smoothed(no_nulls(F.col("counts")), flat, PRIOR_WEIGHT).alias("suffix_spread"))
    domains = spreads(scored, ["domain", "suffix"], n, "counts").join(suffixes, "suffix").select(
        "domain", "suffix", smoothed(no_nulls(F.col("counts")), F.col("suffix_spread"), PRIOR_WEIGHT).alias("domain_spread"))
    hosts = spreads(scored, ["host", "domain", "suffix"], n, "host_counts").join(domains, ["domain", "suffix"]).select("host", "host_counts", "domain_spread")
    said = staged(spreads(scored.where("declared IS NOT NULL"), ["declared"], n, "said"), "declarations")
    # Share of a language's declaring pages that say this; the same kinds are counted for all.
    totals = said.select(F.posexplode("said").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("kinds")).collect()
    by_language = {r.i: (r.x, r.kinds) for r in totals}
    likelihoods = said.select("declared", F.array(*(
        (F.get("said", F.lit(i)) + DECLARED_WEIGHT * F.when(F.col("declared") == language, 0.5).otherwise(0.5 / max(1, by_language.get(i, (0, 1))[1])))
        / (by_language.get(i, (0.0, 0))[0] + DECLARED_WEIGHT) for i, language in enumerate(languages))).alias("said_likelihood"))

    joined = scored.join(hosts, "host", "left").join(likelihoods, "declared", "left")
    # The page's own share is taken out of its host's counts.
    others = F.transform("host_counts", lambda x, i: F.greatest(x - F.get("posterior", i), F.lit(0.0)))
    prior = smoothed(others, F.col("domain_spread"), PRIOR_WEIGHT)
    floor = 1e-12
    logs = F.transform(prior, lambda p, i: F.log(p + floor) + F.log(F.get("posterior", i) + floor)
                       + F.coalesce(F.log(F.get("said_likelihood", i) + floor), F.lit(0.0)))
    fused = joined.select("row", "host", "declared", "posterior", logs.alias("logs"))
    best = F.array_max("logs")
    weights = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    names = F.array(*(F.lit(x) for x in languages))
    return fused.select(
        F.col("row").alias("page_id"),
        F.get(names, (F.array_position("logs", best) - 1).cast("int")).alias("language"),
        (F.lit(1.0) / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)).alias("posterior"),
        F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")).alias("text_language"),
        "declared", "host")
