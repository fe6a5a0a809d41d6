"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns give base spans, which always stay. The field looks at windows of tokens around digits and at-signs. Its
candidates are whole segments of at most `LONGEST` tokens; features of a whole span (its shape, counts, checksum, what
stands beside it) score each candidate for each kind, and dynamic programming over segments of bounded length chooses
boundaries and kinds together. It is trained on windows whose base spans are the truth, partly rewritten into forms that
the patterns miss, and adds a span only where its marginal probability is high. A window may be as long as a text: its
candidates are made and scored in bands of `BAND` tokens, from sums over its tokens, and are not kept.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches
from .training import sample
from .words import mix

KINDS = ("email", "ip", "card", "phone")
#: Texts that training takes at most, windows it draws from them, and passes over these.
TRAINING_ROWS, WINDOWS, EPOCHS = 1500, 900, 6
#: Tokens whose candidates are in memory at once; longer windows are searched, but not learned from.
BAND = 4096
#: Tokens of a segment at most: a name of three parts, [at], and a host of five labels with [dot] between them.
LONGEST = 26
#: Characters of context on either side of what starts a window.
MARGIN = 24
#: The marginal probability at which a span is added.
SURE = 0.9
SLOTS = 1 << 13

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PARTS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
#: Digits in groups, four numbers with dots in brackets or apart, an at-sign in any form with the host behind it, and a bare
#: `at` where a dot of the host is spelled out.
_DOT = r"(?: ?[\[(] ?(?:\.|dot) ?[\])] ?| dot )"
_TRIGGER = re.compile(
    rf"[0-9][0-9 ().+/-]{{5,}}[0-9]|[0-9]+(?:(?:[ .]+|{_DOT})[0-9]+){{3}}"
    rf"|(?:@|[\[(] ?at ?[\])])(?: ?[a-z0-9-]++(?:(?:\.|{_DOT})[a-z0-9-]++)++)?"
    rf"|(?<=[a-z0-9_]) at [a-z0-9-]++(?:\.[a-z0-9-]++)*+{_DOT}[a-z0-9-]++(?:(?:\.|{_DOT})[a-z0-9-]++)*+",
    re.I | re.A,
)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind and start. Linear in the text's length, whatever is in it."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _PARTS.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((1, at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Ranges of text around triggers, cut at white space, not overlapping."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        while 0 < s and not text[s - 1].isspace() and m.start() - s < 2 * MARGIN:
            s -= 1
        while e < len(text) and not text[e].isspace() and e - m.end() < 2 * MARGIN:
            e += 1
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_BUCKETS = np.zeros(LONGEST * 40, np.int64)
for _b, _low in enumerate((1, 4, 7, 9, 10, 11, 13, 16, 17, 20), 1):
    _BUCKETS[_low:] = _b
#: Signs whose presence in a span is a feature; any other sign counts as one more.
SIGNS = " -.()/+@[]_%:,"
#: Digits of a span without an at-sign at most: a card's.
MOST_DIGITS = 19
FEATURES = 15
_BASE = 0x9E3779B97F4A7C15
_POWER = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(BAND + 2 * LONGEST, _BASE, np.uint64))))
_INVERSE = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(BAND + 2 * LONGEST, pow(_BASE, -1, 2**64), np.uint64))))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)))


def _beside(c: str) -> int:
    return 1 if c.isspace() else 2 if c.isalnum() else 3 + ord(c)


class Window:
    """Tokens of a range of a text, and the candidates that begin at some of them."""

    def __init__(self, text: str, lo: int, hi: int):
        self.text = text
        at = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        self.n = len(at)
        self.start, self.end = (np.array(c, np.int64) for c in zip(*at, strict=True)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def candidates(self, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, token after the last one, and slots of the features of each candidate that begins in [begin, stop)."""
        text, far = self.text, min(self.n, stop + LONGEST)
        start, end = self.start[begin:far], self.end[begin:far]
        words = [text[s:e] for s, e in zip(start, end, strict=True)]
        low, m = [w.lower() for w in words], len(words)
        first = [w[0] for w in words]
        number = np.array(["0" <= c <= "9" for c in first], bool)
        letters = np.array([c.isalpha() for c in first], bool)
        alnum = np.array([c.isalnum() for c in first], bool)
        sizes = end - start
        mark = np.array([w == "@" or w == "at" for w in low], bool)
        dot = np.array([w == "." or w == "dot" for w in low], bool)
        gaps = [text[e:s] for e, s in zip(end[:-1], start[1:], strict=True)]
        gap = np.array([0, *(min(len(g), 2) for g in gaps)], np.int64)[:m]
        line = np.array([0, *("\n" in g for g in gaps)], np.int64)[:m]

        # Candidates: begins and ends that a span may have, on one line, with an at-sign or a number of digits.
        digits, marks, lines = _sums(np.where(number, sizes, 0)), _sums(mark.astype(np.int64)), _sums(line)
        i = np.repeat(np.arange(min(stop, self.n) - begin), LONGEST)
        j = i + np.tile(np.arange(1, LONGEST + 1), min(stop, self.n) - begin)
        opens = alnum | np.array([c in "+(" for c in first], bool)
        ok = j <= m
        i, j = i[ok], j[ok]
        n_digits, n_marks = digits[j] - digits[i], marks[j] - marks[i]
        ok = opens[i] & alnum[j - 1] & (lines[j] == lines[i + 1]) & np.where(n_marks > 0, j - i >= 3, (n_digits >= 4) & (n_digits <= MOST_DIGITS))
        i, j, n_digits, n_marks = i[ok], j[ok], n_digits[ok], n_marks[ok]
        if not len(i):
            return i, j, np.zeros((0, FEATURES), np.int32)

        kind = np.where(number, 1, np.where(mark & letters, 2, np.where(dot & letters, 3, np.where(letters, 4, [5 + ord(c) for c in first])))).astype(np.uint64)
        power, inverse = _POWER[:m], _INVERSE
        shapes = _sums((kind * np.uint64(4) + gap.astype(np.uint64)) * power)
        shape = (shapes[j] - shapes[i + 1]) * inverse[i + 1] * np.uint64(31) + kind[i]
        numbers = _sums(number.astype(np.int64))
        groups = _sums(np.where(number, sizes + 1, 0).astype(np.uint64) * _POWER[numbers[:-1]])
        group = (groups[j] - groups[i]) * inverse[numbers[i]]
        words_in, dots = _sums((letters & ~mark & ~dot).astype(np.int64)), _sums(dot.astype(np.int64))
        plain = (words_in[j] - words_in[i] == 0) & (n_marks == 0)
        wide = _sums(np.array([k and (len(w) > 3 or int(w) > 255) for k, w in zip(number, words, strict=True)], np.int64))
        quad = plain & (numbers[j] - numbers[i] == 4) & (wide[j] == wide[i])
        signs = np.zeros(len(i), np.int64)
        for b, c in enumerate(SIGNS):
            there = _sums(gap if c == " " else np.array([w == c for w in words], np.int64))
            signs |= ((there[j] > there[i + 1 if c == " " else i]).astype(np.int64)) << b
        other = _sums(np.array([not a and w not in SIGNS for a, w in zip(alnum, words, strict=True)], np.int64))
        signs |= (other[j] > other[i]).astype(np.int64) << len(SIGNS)
        # The checksum doubles every other digit from the right, so those whose place has the parity of the end.
        each = np.frombuffer("".join(w for k, w in zip(number, words, strict=True) if k).encode(), np.uint8).astype(np.int64) - 48
        odd = np.arange(len(each)) % 2
        twice = 2 * each - 9 * (each > 4)
        by = [(_sums(np.where(odd == q, twice, each))) for q in (0, 1)]
        a, z = digits[i], digits[j]
        total = np.where(z % 2 == 0, by[0][z] - by[0][a], by[1][z] - by[1][a])
        check = np.where(plain & (n_digits >= 13) & (n_digits <= MOST_DIGITS), 1 + (total % 10 == 0), 0)
        bucket = _BUCKETS[np.minimum(n_digits, len(_BUCKETS) - 1)]
        left = np.array([_beside(text[s - 1]) if s else 1 for s in start], np.int64)
        right = np.array([_beside(text[e]) if e < len(text) else 1 for e in end], np.int64)
        crc = np.array([zlib.crc32(w.encode()) for w in low], np.int64)
        before = np.concatenate(([zlib.crc32(text[self.start[begin - 1] : self.end[begin - 1]].lower().encode()) if begin else 1], crc))[i]
        after = np.concatenate((crc, [1]))[j]
        tail = np.array([1 < len(w) < 7 and w.islower() and w.isascii() and w.isalpha() and s > 0 and (text[s - 1] in ".])" or text[s - 1].isspace()) for w, s in zip(words, start, strict=True)], bool)
        tail = tail[j - 1] & (j - i > 1)
        at_sign = (signs >> SIGNS.index("@")) & 1
        plus = np.array([c == "+" for c in first], bool)[i]
        n_dots = np.minimum(dots[j] - dots[i], 4)
        values = (
            shape, (bucket * 2 + at_sign) * 2 + plus, group, signs, quad * 2 + ((signs >> SIGNS.index(".")) & 1), check * 16 + bucket, left[i], right[j - 1], before, after,
            tail * 2 + (n_marks > 0), np.zeros(len(i), np.int64), (n_marks * 8 + n_dots) * 2 + tail, (n_marks > 0) * 32 + np.minimum(j - i, 31), kind[i].astype(np.int64) * 8 + np.minimum(words_in[j] - words_in[i], 7),
        )
        slots = np.stack([(mix(v.astype(np.uint64) * np.uint64(2 * FEATURES + 1) + np.uint64(f)) % np.uint64(SLOTS)).astype(np.int32) for f, v in enumerate(values)], 1)
        return i + begin, j + begin, slots


ANY = int(mix(np.array([11], np.uint64))[0] % np.uint64(SLOTS))


@dataclass
class Lattice:
    """A short window's candidates, all at once: tokens [i, j) of each, and the slots of its features."""

    n: int
    start: np.ndarray
    end: np.ndarray
    segments: list[tuple[int, int]]
    slots: np.ndarray


def lattice(text: str, lo: int, hi: int) -> Lattice:
    w = Window(text, lo, hi)
    i, j, slots = w.candidates(0, w.n)
    return Lattice(w.n, w.start, w.end, list(zip(i.tolist(), j.tolist(), strict=True)), slots)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # (SLOTS, kinds)

    def scores(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(1) if len(slots) else np.zeros((0, len(KINDS)))


Band = tuple[list[int], list[int], list[float]]


def _log_sums(score: np.ndarray) -> list[float]:
    return np.logaddexp.reduce(score, axis=1).tolist() if len(score) else []


class FromLeft:
    """Log sums over the segmentations of the first tokens, fed with bands of candidates by their first token; a token outside any span scores 0."""

    def __init__(self, n: int):
        self.alpha, self.high, self.part, self.at = array("d", bytes(8 * (n + 1))), array("d", [-math.inf]) * (n + 1), array("d", bytes(8 * (n + 1))), 0

    def _go(self, to: int) -> None:
        alpha, high, part, at = self.alpha, self.high, self.part, self.at
        while at < to:
            a, h = alpha[at], high[at + 1]
            at += 1
            m = a if a > h else h
            alpha[at] = a if h == -math.inf else m + math.log(math.exp(a - m) + part[at] * math.exp(h - m))
        self.at = at

    def feed(self, begins: list[int], ends: list[int], totals: list[float]) -> None:
        alpha, high, part = self.alpha, self.high, self.part
        for i, j, t in zip(begins, ends, totals, strict=True):
            if self.at < i:
                self._go(i)
            v, h = alpha[i] + t, high[j]
            if v <= h:
                part[j] += math.exp(v - h)
            else:
                part[j] = part[j] * math.exp(h - v) + 1
                high[j] = v

    def sums(self) -> array:
        self._go(len(self.alpha) - 1)
        return self.alpha


def _to_right(n: int, bands: Iterable[Band]) -> array:
    """Log sums over the segmentations of the tokens from each on; bands come last to first."""
    beta, at = array("d", bytes(8 * (n + 1))), n
    for begins, ends, totals in bands:
        k = len(begins)
        while k:
            i = begins[k - 1]
            while at > i + 1:
                at -= 1
                beta[at] = beta[at + 1]
            terms = [beta[i + 1]]
            while k and begins[k - 1] == i:
                k -= 1
                terms.append(beta[ends[k]] + totals[k])
            m = max(terms)
            beta[i] = m + math.log(sum([math.exp(t - m) for t in terms]))
            at = i
    while at > 0:
        at -= 1
        beta[at] = beta[at + 1]
    return beta


def marginals(lat: Lattice, score: np.ndarray) -> np.ndarray:
    """The probability of each (candidate, kind)."""
    if not len(score):
        return score
    i, j = (list(c) for c in zip(*lat.segments, strict=True))
    band = (i, j, _log_sums(score))
    left = FromLeft(lat.n)
    left.feed(*band)
    alpha, beta = np.array(left.sums()), np.array(_to_right(lat.n, [band]))
    return np.exp(np.minimum(0, alpha[i][:, None] + score + beta[j][:, None] - alpha[lat.n]))


class Best:
    """The best segmentation, fed with bands of candidates by their first token."""

    def __init__(self, n: int):
        self.value, self.high, self.at = array("d", bytes(8 * (n + 1))), array("d", bytes(8 * (n + 1))), 0
        self.back: dict[int, tuple[int, int, float]] = {}

    def _go(self, to: int) -> None:
        value, high, at = self.value, self.high, self.at
        while at < to:
            at += 1
            value[at] = max(value[at - 1], high[at])
        self.at = at

    def feed(self, begins: list[int], ends: list[int], score: np.ndarray) -> None:
        top, kind = (score.max(1).tolist(), score.argmax(1).tolist()) if len(score) else ([], [])
        for i, j, t, k in zip(begins, ends, top, kind, strict=True):
            if t > 0:
                self._go(i)
                v = self.value[i] + t
                if v > self.high[j]:
                    self.high[j], self.back[j] = v, (i, k, t)

    def spans(self) -> list[tuple[int, int, int, float]]:
        """First token, token after the last, kind and score of its spans."""
        j = len(self.value) - 1
        self._go(j)
        out = []
        while j:
            if j in self.back and self.high[j] > self.value[j - 1]:
                i, k, t = self.back[j]
                out.append((i, j, k, t))
                j = i
            else:
                j -= 1
        return out[::-1]


def rewritten(rng: random.Random, kind: int, span: str) -> str:
    """A form of a base span that people write and the patterns miss."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        at = rng.choice(("(at)", "[at]", " (at) ", " [at] ", " @ ", " at "))
        dot = rng.choice((" dot ", "[dot]", "(dot)") if at == " at " else (".", ".", " dot ", "[dot]", "(dot)"))
        name, _, host = span.partition("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return rng.choice((" . ", "[.]", "(.)")).join(span.split("."))
    if kind == 2:
        return rng.choice((".", "/", " - ", "  ")).join(re.findall(".{1,4}", digits))
    rest = digits[-10:]
    return rng.choice(("({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "({0}){1}-{2}", "00{3} {0} {1} {2}")).format(rest[:3], rest[3:6], rest[6:], digits[:-10])


def train(texts: list[str], seed: int = 7) -> Model:
    """Maximum conditional likelihood by adaptive gradient steps; no windows leave a model that adds nothing."""
    rng = random.Random(seed)
    data: list[tuple[Lattice, dict[int, int]]] = []
    drawn: list[tuple[str, int, int, list[Span]]] = []
    for text in texts:
        # Rewritten first, so that windows open here on what they open on in the search.
        pieces, truth, at, size = [], [], 0, 0
        for kind, s, e in sorted(base_spans(text), key=lambda x: x[1]):
            if s < at:
                continue
            piece = rewritten(rng, kind, text[s:e]) if rng.random() < 0.5 else text[s:e]
            pieces += [text[at:s], piece]
            size += s - at + len(piece)
            truth.append((kind, size - len(piece), size))
            at = e
        out = "".join([*pieces, text[at:]])
        for lo, hi in windows(out):
            inside = [x for x in truth if x[1] < hi and lo < x[2]]
            if inside or rng.random() < 0.5:
                drawn.append((out, lo, hi, inside))
    # Which windows are learned from is drawn over all texts; one whose truth is no candidate says nothing.
    rng.shuffle(drawn)
    for out, lo, hi, inside in drawn:
        if len(data) >= WINDOWS:
            break
        if hi - lo > BAND:
            continue
        lat = lattice(out, lo, hi)
        place = {(int(lat.start[i]), int(lat.end[j - 1])): k for k, (i, j) in enumerate(lat.segments)}
        gold = {place[s, e]: kind for kind, s, e in inside if (s, e) in place}
        if len(gold) == len(inside) and lat.segments:
            data.append((lat, gold))
    weights, square = np.zeros((SLOTS, len(KINDS))), np.full((SLOTS, len(KINDS)), 1e-6)
    weights[ANY] = -2.0
    model = Model(weights)
    for _ in range(EPOCHS):
        rng.shuffle(data)
        for lat, gold in data:
            gradient = -marginals(lat, model.scores(lat.slots))
            for k, kind in gold.items():
                gradient[k, kind] += 1
            touched, rows = np.unique(lat.slots.ravel(), return_inverse=True)
            step = np.repeat(gradient, lat.slots.shape[1], axis=0)
            g = np.stack([np.bincount(rows, step[:, k], len(touched)) for k in range(len(KINDS))], 1) - 1e-3 * weights[touched]
            square[touched] += g**2
            weights[touched] += 0.3 * g / np.sqrt(square[touched] + 0.1)
    return Model(weights) if data else Model(np.full((SLOTS, len(KINDS)), -9.0))


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Spans beside the base ones: in the best segmentation that keeps clear of these, and with a marginal of at least `SURE`.

    Time is linear in the text, and memory is a few numbers for each token of a window and the candidates of a band.
    """
    out: list[Span] = []
    for lo, hi in windows(text):
        w = Window(text, lo, hi)
        taken = np.zeros(w.n + 1, np.int64)
        for _, s, e in base:
            if s < hi and lo < e:
                taken[np.searchsorted(w.end, s, "right") : np.searchsorted(w.start, e, "left")] = 1
        taken = _sums(taken)
        best, left, last = Best(w.n), FromLeft(w.n), None
        for k in range(0, w.n, BAND):
            i, j, slots = w.candidates(k, k + BAND)
            score = model.scores(slots)
            ok = taken[i] == taken[j]
            best.feed(i[ok].tolist(), j[ok].tolist(), score[ok])
            last = (i.tolist(), j.tolist(), _log_sums(score))
            left.feed(*last)
        chosen = best.spans()
        if chosen:
            # The other direction makes the candidates again, but for the last band.
            def back(w=w, last=last) -> Iterator[Band]:
                yield last
                for k in reversed(range(0, w.n - BAND, BAND)):
                    i, j, slots = w.candidates(k, k + BAND)
                    yield i.tolist(), j.tolist(), _log_sums(model.scores(slots))

            alpha, beta = left.sums(), _to_right(w.n, back())
            out += [(kind, int(w.start[i]), int(w.end[j - 1])) for i, j, kind, score in chosen if alpha[i] + score + beta[j] - alpha[w.n] >= math.log(SURE)]
    return out


def fit(docs: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Learns from a bounded sample of texts that hold digits or an at-sign, out of eight times as many drawn by a hash; no labels are needed."""
    share = min(1.0, 8 * rows / max(1, docs.count()))
    known = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    known = known.where(F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).where(F.col("text").rlike("@|[0-9]{4}"))
    return train(sample(known, rows).column("text").to_pylist())


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def found(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each of docs: counts and the digest of base spans, all spans (code points), and how many were added.

    A null text is an empty one. Rows without a doc_id, and repeated ones, come like others; other columns are not looked
    at. Very long texts are read whole, in time linear in their length. An empty table gives an empty one. The model has
    a fixed size.
    """
    modest_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, sent.value)
                n = [sum(x[0] == k for x in base) for k in range(len(KINDS))]
                rows.append((doc, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            names = [x.split()[0] for x in FOUND.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
