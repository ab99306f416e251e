"""Secret scans by fixed patterns and by inferred credential grammars.

One pass over the texts finds the spans of the fixed patterns and counts character pairs. A bounded
sample of the found credentials, labelled with the kind of their pattern, becomes one prefix tree per
kind; states whose futures agree under a Hoeffding bound are merged (red-blue order), which leaves a
small probabilistic automaton. A second pass takes as candidates all runs of credential characters as
long as the shortest credential a pattern can label, words included. Every candidate is scored by its
likelihood under the best automaton against a character-pair model of all text of the corpus, and is a
span of kind `format` where the ratio is high enough. A bound that no path through an automaton can
exceed, taken for all candidates at once, settles most words; the others get the exact score.

Defined cases: a null text is empty; empty texts have no spans; overlapping spans of different kinds all
stand, but candidates over a fixed span are none; repeated rows are scanned each; without labelled
credentials no candidate is added; very long texts are scanned whole; other columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.llm.common import byte_view, pieces, texts_of
from steward.staging import staged

KINDS = ("assign", "access", "hex", "format")
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Candidates are at least as long as the shortest credential that a pattern labels.
MIN_CANDIDATE = min(MIN_ASSIGN, MIN_ACCESS, MIN_HEX)
#: Labelled credentials per kind that grammars are inferred from.
SAMPLE = 300
CONFIDENCE, SMOOTHING = 0.05, 0.5
#: Least log-likelihood ratio (natural) of a span.
MIN_SCORE = 12.0
#: Words times states that are scored at once.
SCORED_CELLS = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODE = np.full(256, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
SPAN = "struct<kind:int,start:int,stop:int,value:string>"
FOUND = f"row long, base array<{SPAN}>, pairs array<long>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of set positions, cut at the ends of texts."""
    opens, closes = inside.copy(), np.append(inside, False)[1:]
    opens[1:] &= ~inside[:-1]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    opens[cuts] = inside[cuts]
    goes_on = closes.copy()
    goes_on[cuts - 1] = False
    return np.flatnonzero(opens), np.flatnonzero(inside & ~goes_on) + 1


def span_array(spans: list) -> pa.Array:
    struct = lambda found: [{"kind": k, "start": s, "stop": e, "value": v} for k, s, e, v in sorted(found, key=lambda x: (x[1], x[0]))]
    return pa.array([None if found is None else struct(found) for found in spans], _SPAN_TYPE)


class Scan:
    """The texts of a piece end to end, and the spans of the fixed patterns in each."""

    def __init__(self, texts: pa.Array):
        self.body, self.ends = body, ends = byte_view(texts)
        self.base: list[list[tuple]] = [[] for _ in range(len(texts))]
        self.codes = _CODE[body]
        point = np.cumsum((body & 0xC0) != 0x80, dtype=np.int64)  # code points up to each byte
        self.before = np.append(0, point)
        for i in np.flatnonzero(pc.match_substring_regex(texts, rf"(?i)({KEYWORDS})[\"']?\x20*[:=]").to_numpy(zero_copy_only=False)).tolist():
            for m in ASSIGN.finditer(texts[i].as_py()):
                if len(m[2]) >= MIN_ASSIGN:
                    self.base[i].append((0, m.start(), m.end(), m[2]))
        for i in np.flatnonzero(pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)).tolist():
            for m in ACCESS.finditer(texts[i].as_py()):
                if m.end() - m.start() >= MIN_ACCESS:
                    self.base[i].append((1, m.start(), m.end(), m[0]))
        start, stop = runs(_HEX[body], ends)
        long = stop - start >= MIN_HEX
        for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True):
            i, span = self.span(2, a, b)
            self.base[i].append(span)

    def span(self, kind: int, a: int, b: int) -> tuple[int, tuple]:
        """The text that holds the bytes from a to b, all ASCII, and their span in it."""
        i = int(np.searchsorted(self.ends, a, side="right")) - 1
        at = int(self.before[a] - self.before[self.ends[i]])
        return i, (kind, at, at + b - a, self.body[a:b].tobytes().decode())

    def pairs(self) -> np.ndarray:
        size = len(ALPHABET) + 1
        codes = np.where(self.codes < 0, size - 1, self.codes)
        return np.bincount(codes[:-1] * size + codes[1:], minlength=size * size) if len(codes) > 1 else np.zeros(size * size, np.int64)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        start, stop = runs(self.codes >= 0, self.ends)
        long = stop - start >= MIN_CANDIDATE
        return start[long], stop[long]


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its base spans; one more row per piece with its character pairs."""
    for batch in batches:
        for piece in pieces(batch, "text", 2 << 20):
            scan = Scan(texts_of(piece, "text"))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([piece.column(0), pa.array([None], piece.column(0).type)]), span_array([*scan.base, None]),
                pa.array([*[None] * piece.num_rows, scan.pairs().tolist()], pa.list_(pa.int64()))], ["row", "base", "pairs"])


class Automaton:
    """Probabilistic automaton of a prefix tree, its compatible states merged."""

    def __init__(self, words: list[str]):
        self.count, self.final, self.next, self.seen = [0], [0], [{}], [Counter()]
        for word in words:
            state = 0
            self.count[0] += 1
            for c in word:
                self.seen[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.count)
                    self.count.append(0)
                    self.final.append(0)
                    self.next.append({})
                    self.seen.append(Counter())
                state = self.next[state][c]
                self.count[state] += 1
            self.final[state] += 1
        self._merge()
        self._tabulate()

    def _differ(self, a: int, b: int) -> bool:
        """Whether the futures of two states differ more than chance allows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            m, n = self.count[a], self.count[b]
            if not m or not n:
                continue
            bound = math.sqrt(0.5 * math.log(2 / CONFIDENCE)) * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.final[a] / m - self.final[b] / n) > bound:
                return True
            for c in self.seen[a].keys() | self.seen[b].keys():
                if abs(self.seen[a][c] / m - self.seen[b][c] / n) > bound:
                    return True
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return False

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below `b` to the state `a`."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            self.seen[a].update(self.seen[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self) -> None:
        red = [0]
        while True:
            kept = set(red)
            blue = [(self.count[t], state, c, t) for state in red for c, t in self.next[state].items() if t not in kept]
            if not blue:
                self.states = len(red)
                return
            _, parent, c, state = max(blue, key=lambda x: (x[0], -x[3]))
            home = next((r for r in red if not self._differ(r, state)), None)
            if home is None:
                red.append(state)
            else:
                self.next[parent][c] = home
                self._fold(home, state)

    def _tabulate(self) -> None:
        """Log-probabilities of steps, of a character out of turn, and of the end, by state."""
        number, order = {0: 0}, [0]
        for state in order:
            for t in self.next[state].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
        share = SMOOTHING / (len(ALPHABET) + 1)
        total = np.log([self.count[state] + SMOOTHING for state in order])
        self.step = np.full((len(order), len(ALPHABET)), -np.inf)
        self.goes = np.zeros((len(order), len(ALPHABET)), np.int64)
        for i, state in enumerate(order):
            for c, n in self.seen[state].items():
                self.step[i, ALPHABET.index(c)] = math.log(n) - total[i]
                self.goes[i, ALPHABET.index(c)] = number[self.next[state][c]]
        self.leap = math.log(share / len(order)) - total
        self.end = np.log(np.array([self.final[state] for state in order]) + share) - total
        #: No path gains more from a character, nor from the end.
        self.most, self.most_end = np.maximum(self.step.max(axis=0), self.leap.max()), self.end.max()

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihoods of the likeliest paths; a step costs its share of the count, or the smoothing's
        share, and then the path goes on in any state, so a format is known again after a strange character."""
        out = np.zeros(len(words))
        states = len(self.end)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        for first in range(0, len(words), block := max(1, SCORED_CELLS // states)):
            chosen = order[first: first + block]
            length = sizes[chosen]
            begins = np.cumsum(length) - length
            codes = _CODE[np.frombuffer(b"".join(words[i] for i in chosen.tolist()), np.uint8)]
            if states == 1:
                out[chosen] = np.add.reduceat(self.most[codes], begins) + self.end[0]
                continue
            paths = np.full((len(chosen), states), -np.inf)
            paths[:, 0] = 0
            active = len(chosen) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
            for k, n in enumerate(active.tolist()):  # the words longer than k
                c = codes[begins[:n] + k]
                new = np.repeat((paths[:n] + self.leap).max(axis=1), states)
                to = (np.arange(n) * states)[:, None] + self.goes[:, c].T
                np.maximum.at(new, to.reshape(-1), (paths[:n] + self.step[:, c].T).reshape(-1))
                paths[:n] = new.reshape(n, states)
            out[chosen] = (paths + self.end).max(axis=1)
        return out

    def score(self, word: str) -> float:
        return float(self.scores([word.encode()])[0])


def background(pairs: np.ndarray) -> np.ndarray:
    """Log-probability of each character after another in the corpus's text."""
    size = len(ALPHABET) + 1
    table = pairs.reshape(size, size) + 1.0
    return np.log(table / table.sum(axis=1, keepdims=True))


def format_spans(scan: Scan, automata: list[Automaton], table: np.ndarray) -> list[list[tuple]]:
    """Spans of the candidates whose likelihood ratio is high enough, per text."""
    found: list[list[tuple]] = [[] for _ in scan.base]
    start, stop = scan.candidates()
    if not automata or not len(start):
        return found
    size = len(ALPHABET)
    codes = np.where(scan.codes < 0, size, scan.codes)
    text = np.append(0, np.cumsum(table[codes[:-1], codes[1:]]))
    text = text[stop - 1] - text[start] + table[size, codes[start]] + table[codes[stop - 1], size]
    hopeful = np.zeros(len(start), bool)
    for a in automata:
        most = np.append(0, np.cumsum(np.append(a.most, 0)[codes]))
        hopeful |= most[stop] - most[start] + a.most_end - text >= MIN_SCORE - 1e-3
    start, stop, text = start[hopeful], stop[hopeful], text[hopeful]
    if not len(start):
        return found
    number: dict[bytes, int] = {}
    word_of = np.array([number.setdefault(scan.body[a:b].tobytes(), len(number)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    words = list(number)
    best = np.max([a.scores(words) for a in automata], axis=0)
    hit = np.flatnonzero(best[word_of] - text >= MIN_SCORE)
    for a, b in zip(start[hit].tolist(), stop[hit].tolist(), strict=True):
        i, span = scan.span(3, a, b)
        if all(span[2] <= s or e <= span[1] for _, s, e, _ in scan.base[i]):
            found[i].append(span)
    return found


def marked(texts: pa.Array, automata: list[Automaton], table: np.ndarray) -> pa.Array:
    """All spans of each text, in order."""
    scan = Scan(texts)
    return span_array([b + f for b, f in zip(scan.base, format_spans(scan, automata, table), strict=True)])


def marked_batches(batches: Iterator[pa.RecordBatch], automata: list[Automaton], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([piece.column(0), marked(texts_of(piece, "text"), automata, table)], ["row", "spans"])


def redacted_text(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for s in spans:
        if s["stop"] > at:
            parts += [text[at:max(at, s["start"])], "[secret]" if s["start"] >= at else ""]
            at = s["stop"]
    return "".join(parts) + text[at:]


def redacted_batches(batches: Iterator[pa.RecordBatch], automata: list[Automaton], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", 2 << 20):
            texts = piece.column(1)
            spans = marked(texts_of(piece, "text"), automata, table)
            hit = np.flatnonzero(pc.list_value_length(spans).to_numpy(zero_copy_only=False) > 0)
            out = texts
            if len(hit):
                values = texts.to_pylist()
                for i in hit.tolist():
                    values[i] = redacted_text(values[i], spans[i].as_py())
                out = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([piece.column(0), out], ["row", "clean"])


def fitted(docs: DataFrame) -> tuple[list[Automaton], np.ndarray]:
    """The grammars and the text model of `docs` (row, text)."""
    kind = docs.schema["row"].dataType.simpleString()
    found = staged(docs.select("row", "text").mapInArrow(scanned, FOUND.replace("row long", f"row {kind}")), "secrets")
    size = (len(ALPHABET) + 1) ** 2
    pairs = found.where("pairs IS NOT NULL").select(F.posexplode("pairs").alias("pair", "n")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size)
    for pair, n in pairs:  # one row per character pair
        counts[pair] = n
    labelled = found.where("pairs IS NULL").select(F.explode("base").alias("s")).select("s.kind", "s.value")
    automata = []
    for number in range(3):
        sample = labelled.where(F.col("kind") == number).select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect()
        if sample:
            automata.append(Automaton([r.value for r in sample]))
    return automata, background(counts)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (row, text): row, spans (kind number, start, stop, value), in order.

    The texts are scanned once to infer the grammars and once to score, so no candidate is stored.
    """
    kind = docs.schema["row"].dataType.simpleString()
    automata, table = fitted(docs)
    return docs.select("row", "text").mapInArrow(lambda batches: marked_batches(batches, automata, table), f"row {kind}, spans array<{SPAN}>")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with `[secret]` in place of every span; all columns and rows stay.

    The texts are scanned once to infer the grammars and once to redact, with no join in between.
    """
    columns = docs.columns
    numbered = docs.select(F.col("doc_id").alias("row"), "text")
    automata, table = fitted(numbered)
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "text")
    kind = carried.schema["row"].dataType.simpleString()
    clean = carried.mapInArrow(lambda batches: redacted_batches(batches, automata, table), f"row {kind}, clean string")
    return clean.select(*(F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns))


def digest_text(spans, kinds: int):
    """kind:start:stop of the spans whose kind is below `kinds`, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    chosen = F.filter(spans, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
