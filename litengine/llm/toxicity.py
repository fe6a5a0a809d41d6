"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps look-alike letters of other scripts and digits or signs that stand for letters to plain small letters, one
for one. The lexicon is learned: words and word beginnings that are far more common in texts marked toxic, each with a
log odds ratio as its weight. Harmless phrases are found first: neighbouring words that stand together in texts not marked
toxic and hardly in others; what stands inside one doesn't speak for or against a word. Exception phrases are pairs of an
entry and a neighbour with which it is not toxic; an entry inside one does not count, whatever stands between its words
beside letters and digits. The weights found are summed, divided by a power of the text's length in words, and put
through a logistic curve.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, modest_batches
from .training import sample

#: Labelled rows that training takes at most.
TRAINING_ROWS = 8000
#: Texts marked toxic that an entry needs, as a number and a share of them, and the least log odds ratio.
MIN_TEXTS, MIN_SHARE, MIN_WEIGHT = 6, 0.02, 3.0
#: Lengths of word beginnings that may be entries.
STEMS = (4, 5, 6, 7)
#: Powers of the length among which the one is chosen that tells the training texts apart best.
POWERS = (0.25, 0.5, 1.0)

# Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _folding() -> dict[int, str]:
    table = {}
    for c in range(0x80, 0x590):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = low
    for c in range(0xFF21, 0xFF5B):  # full width letters
        if chr(c).isalpha():
            table[c] = chr(c - 0xFEE0).lower()
    for c, plain in HOMOGLYPHS.items():
        table[ord(c)] = plain
        table[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = plain
    for c in range(65, 91):
        table[c] = chr(c + 32)
    # Anything that ends a word is a space; the length stays.
    for c in range(0x80):
        if not chr(c).isalnum() and c not in (39,):
            table[c] = " "
    for c in "\x85\xa0«»“”„‘’…–—¡¿":
        table[ord(c)] = " "
    return table


_FOLD = _folding()
_SUBST = {ord(c): v for c, v in SUBSTITUTES.items()}


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutes to plain letters, other signs to spaces; as long as the text.

    A digit or sign only stands for a letter beside one: in `1d10t` all do, in `1999` and `oh!` none does.
    """
    plain = text.translate(_FOLD)
    for c in SUBSTITUTES:
        if c in text:
            break
    else:
        return plain
    out, n = list(plain), len(text)
    letter = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
    at = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sub = np.isin(at, np.fromiter(_SUBST, np.uint32))
    is_letter = (letter != 32) & ~((letter >= 48) & (letter <= 57))
    # Runs of letters and substitutes that begin and end beside letters.
    joined = np.concatenate(([False], is_letter | sub, [False]))
    edge = np.flatnonzero(joined[1:] != joined[:-1])
    letters = np.concatenate(([0], np.cumsum(is_letter)))
    for i, j in zip(edge[::2], edge[1::2], strict=True):
        if letters[j] - letters[i] and letters[j] - letters[i] < j - i:
            while j > i and sub[j - 1] and chr(at[j - 1]) == "!":
                j -= 1
            for k in range(i, j):
                if sub[k]:
                    out[k] = _SUBST[int(at[k])]
    return "".join(out) if n else plain


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    power: float = 0.5
    slope: float = 1.0
    intercept: float = -3.0

    def __post_init__(self):
        self._machine = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_machine"}

    def __setstate__(self, state):
        self.__dict__.update(state, _machine=None)

    def machine(self):
        """The automaton: entries with their word borders as spaces."""
        if self._machine is None:
            a = ahocorasick.Automaton()
            for w, x in self.stems.items():
                a.add_word(f" {w}", ("stem", len(w), x))
            for w, x in self.words.items():
                a.add_word(f" {w} ", ("word", len(w), x))
            for w in self.exceptions:
                a.add_word(f" {w} ", ("exception", len(w), 0.0))
            if len(a):
                a.make_automaton()
            self._machine = a
        return self._machine

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """start, end (code points) and weight of the entries that count; of entries that begin together, the heaviest."""
        machine = self.machine()
        if not len(machine) or not text:
            return []
        # Runs of signs between words count as one space; `place` leads back to the text.
        plain = f" {fold(text)} "
        letter = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
        single = np.ones(len(letter), bool)
        single[1:] = (letter[1:] != 32) | (letter[:-1] != 32)
        place = np.flatnonzero(single) - 1
        found: dict[int, tuple[int, float]] = {}
        harmless = []
        for end, (kind, n, weight) in machine.iter(letter[single].tobytes().decode("utf-32-le", "surrogatepass")):
            start = end - n + 1 if kind == "stem" else end - n
            if kind == "exception":
                harmless.append((start, start + n))
            elif start not in found or weight > found[start][1]:
                found[start] = (start + n, weight)
        harmless.sort()
        out, k, reach = [], 0, -1
        for s, (e, w) in sorted(found.items()):
            while k < len(harmless) and harmless[k][0] <= s:
                reach, k = max(reach, harmless[k][1]), k + 1
            if e > reach:
                out.append((int(place[s]), int(place[e - 1]) + 1, w))
        return out

    def raw(self, text: str) -> tuple[float, int]:
        return sum(w for _, _, w in self.spans(text)), len(text.split())

    def score(self, text: str) -> float:
        total, n = self.raw(text)
        return _logistic(self.intercept + self.slope * total / max(n, 1) ** self.power)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on one number, by Newton's steps with a small ridge; slope, intercept, loss."""
    scale = x.std() or 1.0
    a = np.stack((x / scale, np.ones(len(x))), 1)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (p - y) + 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
        w = np.clip(w, -60, 60)
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -40, 40))), 1e-9, 1 - 1e-9)
    return float(w[0] / scale), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def train(texts: list[str], toxic: list[int]) -> Lexicon:
    y = np.array(toxic, float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Lexicon(intercept=-3.0 if not y.sum() else 3.0)
    folded = [fold(t).split() for t in texts]
    a, b = y.sum() + 1, len(y) - y.sum() + 1
    least = max(MIN_TEXTS, MIN_SHARE * y.sum())
    harmless = _harmless(folded, toxic, least)
    words: tuple[Counter, Counter] = (Counter(), Counter())
    stems: tuple[Counter, Counter] = (Counter(), Counter())
    for ws, t in zip(folded, toxic, strict=True):
        own = set(ws)
        if not harmless.keys().isdisjoint(own):
            own = {w for k, w in enumerate(ws) if w not in harmless or not (ws[k - 1 : k] and (ws[k - 1], w) in harmless[w] or ws[k + 1 : k + 2] and (w, ws[k + 1]) in harmless[w])}
        words[t].update(own)
        stems[t].update({w[:n] for w in own for n in STEMS if len(w) > n})
    weigh = lambda c, w: math.log((c[1][w] + 0.5) / a) - math.log((c[0][w] + 0.5) / b)
    # An entry's lead must also be beyond chance, however many words there are.
    sure = lambda c, w: (c[1][w] - a * (c[0][w] + 0.5) / b) / math.sqrt(c[1][w] + 1) > 2.0
    pick = lambda c: {w: weigh(c, w) for w, n in c[1].items() if n >= least and len(w) > 2 and weigh(c, w) >= MIN_WEIGHT and sure(c, w)}
    found, begin = pick(words), pick(stems)
    # A stem stands for its longer forms, unless it only repeats one word.
    begin = {s: x for s, x in begin.items() if stems[1][s] >= 2 * max((words[1][w] for w in found if w.startswith(s)), default=0)}
    begin = {s: x for s, x in begin.items() if not any(s[:n] in begin for n in range(1, len(s)))}
    found = {w: x for w, x in found.items() if not any(w[:n] in begin for n in STEMS)}
    lexicon = Lexicon(found, begin)
    lexicon.exceptions = frozenset(_exceptions(folded, toxic, lexicon))
    lexicon._machine = None
    raw = np.array([lexicon.raw(t) for t in texts])
    curves = [(*_fit_curve(raw[:, 0] / np.maximum(raw[:, 1], 1) ** q, y), q) for q in POWERS]
    lexicon.slope, lexicon.intercept, _, lexicon.power = min(curves, key=lambda c: c[2])
    return lexicon


def _harmless(folded: list[list[str]], toxic: list[int], least: float) -> dict[str, set[tuple[str, str]]]:
    """For words that enough toxic texts hold: the pairs with a neighbour that toxic texts hold far more seldom than others do."""
    words, n_toxic = Counter(), sum(toxic)
    for ws, t in zip(folded, toxic, strict=True):
        if t:
            words.update(set(ws))
    known = {w for w, n in words.items() if n >= least and len(w) > 2}
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for ws, t in zip(folded, toxic, strict=True):
        if not known.isdisjoint(ws):
            seen[t].update({(x, z) for x, z in zip(ws, ws[1:], strict=False) if x in known or z in known})
    ratio = n_toxic / max(1, len(toxic) - n_toxic)
    out: dict[str, set[tuple[str, str]]] = {}
    for pair, n in seen[0].items():
        if n * ratio >= 2 and seen[1][pair] < n * ratio / 4:
            for w in pair:
                if w in known:
                    out.setdefault(w, set()).add(pair)
    return out


def _exceptions(folded: list[list[str]], toxic: list[int], lexicon: Lexicon) -> Iterator[str]:
    """Pairs of an entry and a neighbour that stand in texts not marked toxic, and hardly in others."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    is_entry = lambda w: w in lexicon.words or any(w[:n] in lexicon.stems for n in STEMS)
    for ws, t in zip(folded, toxic, strict=True):
        seen[t].update({f"{x} {z}" for x, z in zip(ws, ws[1:], strict=False) if is_entry(x) or is_entry(z)})
    for phrase, n in seen[0].items():
        if n >= 3 and n > 4 * seen[1][phrase]:
            yield phrase


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Lexicon:
    """Learns from a bounded sample of labelled rows outside the held-out fold. Repeated labels of a document count once."""
    marks = labels.where(~held_out()).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("bytes", F.octet_length("text"))
    got = sample(texts.join(marks, "doc_id"), rows)
    return train(got.column("text").to_pylist(), got.column("toxic").to_pylist())


SCORED = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,weight:double>>"


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row for each of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), spans (code points) that count.

    Null and empty texts score as texts without entries. Null doc_ids count as held out. Repeated rows come as often.
    Very long texts are read whole; other columns are not looked at. An empty table gives an empty one. The lexicon is
    bounded by its training sample.
    """
    modest_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = sent.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))
        for batch in source:
            spans, scores = [], []
            for t in batch.column(2):
                text = t.as_py() or ""
                found = own.spans(text)
                spans.append([{"start": s, "end": e, "weight": w} for s, e, w in found])
                scores.append(_logistic(own.intercept + own.slope * sum(w for _, _, w in found) / max(len(text.split()), 1) ** own.power))
            score = np.array(scores, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)
