"""WIN8, ALN3: the window of a text that a passage fits best, by blocks of matching entries.

Pairs to compare come from runs of words that both hold, by an equi-join of hashes that carries no text. A pair is then
compared in its task: numbers for words or characters, bounds of all windows at once, and blocks only in windows whose
bound reaches the best one so far. That gives the same best window as trying all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

C = F.col

# Lengths of parts of a passage that are looked for, how much of its ends may be left out, what a window has
# to reach, and what a share of common words is worth. POPULAR: in texts so long, characters that make up more than a hundredth
# begin no block.
LENGTHS, PREFIX, SUFFIX, ANCHOR = (96, 72, 48, 32, 20, 12), 8, 4, 4
LEAST_RATIO, LEAST_COVERAGE, SHARED = 0.42, 0.38, 0.85
POPULAR = 200


def sharing_runs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text", n: int = 4) -> DataFrame:
    """Distinct pairs of ids whose texts share a run of n words (of the normal form); only ids and hashes are shuffled."""

    def runs(df: DataFrame, ident: str) -> DataFrame:
        words = F.split(T.normalize_for_search(F.coalesce(C(text), F.lit(""))), " ")
        at = F.sequence(F.lit(1), F.size("w") - n + 1)
        keys = F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "))))
        return df.select(ident, words.alias("w")).where(F.size("w") >= n).select(ident, F.explode(keys).alias("_key"))

    return runs(left, left_id).join(runs(right, right_id), "_key").select(left_id, right_id).distinct()


def matched(a: np.ndarray, b: np.ndarray, usable: np.ndarray | None = None) -> int:
    """How many entries stand in matching blocks: the longest common run (the earliest in a, then in b), and so on to its left and right.

    Entries of b that are not usable begin no block, but lengthen one.
    """
    total, open_parts = 0, [(0, len(a), 0, len(b))]
    while open_parts:
        a0, a1, b0, b1 = open_parts.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        same = a[a0:a1, None] == b[None, b0:b1]
        if usable is not None:
            same &= usable[None, b0:b1]
        run, size, i, j = np.zeros(b1 - b0 + 1, np.int64), 0, a0, b0
        for row in np.flatnonzero(same.any(1)):
            # A row without a match ends all runs, so the run of the row before counts only if it is the one just above.
            if row and not same[row - 1].any():
                run[:] = 0
            run[1:] = np.where(same[row], run[:-1] + 1, 0)
            k = int(run.max())
            if k > size:
                size, i, j = k, a0 + int(row) - k + 1, b0 + int(run[1:].argmax()) - k + 1
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            open_parts += [(a0, i, b0, j), (i + size, a1, j + size, b1)]
    return total


def _numbers(*texts: Sequence[str]) -> list[np.ndarray]:
    number: dict[str, int] = {}
    return [np.array([number.setdefault(t, len(number)) for t in text], np.int64) for text in texts]


def targets(n: int, page: int) -> list[tuple[int, int]]:
    """Parts of a passage of n words that are looked for on a page: (start, end), whole ones and such without some words at the ends."""
    if n < ANCHOR:
        return []
    sizes = sorted({m for m in (min(n, page, length) for length in LENGTHS) if m >= ANCHOR}, reverse=True)
    starts = sorted({*range(min(PREFIX, n - ANCHOR) + 1), *((n // 4, n // 3, n // 2) if n > 24 else ())})
    parts = [(s, min(n, s + size)) for s in starts for size in sizes] + [(0, min(n - cut, page)) for cut in range(1, min(SUFFIX, n - ANCHOR) + 1)]
    return [p for p in dict.fromkeys(parts) if p[1] - p[0] >= ANCHOR]


def best_window(passage: Sequence[str], page: Sequence[str]) -> tuple[int, int, int, float, float]:
    """WIN8: start, end, matches, ratio and coverage of the page's words that fit the passage best; (-1, -1, 0, 0, 0) for none.

    Ratio is the most of equal places, matching blocks and 0.85 of the share of the passage's different words. Of equal
    ones the greater coverage, then more equal places, then the first.
    """
    best, best_key = (-1, -1, 0, 0.0, 0.0), (0.0, 0.0, 0)
    words, on_page = _numbers(passage, page)
    for start, end in targets(len(words), len(on_page)):
        target, n = words[start:end], end - start
        if n > len(on_page):
            continue
        kinds, times = np.unique(target, return_counts=True)
        before = np.zeros((len(kinds), len(on_page) + 1), np.int32)
        np.cumsum(on_page[None] == kinds[:, None], axis=1, out=before[:, 1:])
        held = before[:, n:] - before[:, :-n]
        shared = (held > 0).sum(0)
        exact = (np.lib.stride_tricks.sliding_window_view(on_page, n) == target).sum(1)
        flat = np.maximum(exact / n, shared / len(kinds) * SHARED)
        # No more entries can stand in blocks than both have of each word.
        bound = np.maximum(flat, np.minimum(held, times[:, None]).sum(0) / n)
        found = None
        for at in np.argsort(-bound, kind="stable").tolist():
            if bound[at] < best_key[0] or found is not None and bound[at] < found[0][0]:
                break
            ratio = max(float(flat[at]), matched(target, on_page[at : at + n]) / n)
            key = ((ratio, float(shared[at] / len(kinds)), int(exact[at])), -at)
            if found is None or key > (found[0], found[1]):
                found = (key[0], key[1])
        if found is not None and found[0] > best_key:
            at = -found[1]
            best_key, best = found[0], (at, at + n, max(int(exact[at]), int(shared[at])), found[0][0], found[0][1])
    return best


def located(pairs: DataFrame, passage: str, page: str) -> DataFrame:
    """WIN8: pairs of word arrays to window_start, window_end, match_count, match_ratio, coverage and fits (is it good enough?).

    Null and empty arrays fit nowhere.
    """

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces:
            found = [best_window(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(pdf[passage], pdf[page], strict=True)]
            start, end, matches, ratio, coverage = (list(x) for x in zip(*found, strict=True)) if found else ([],) * 5
            fits = [r >= LEAST_RATIO and c >= LEAST_COVERAGE and m >= ANCHOR for m, r, c in zip(matches, ratio, coverage, strict=True)]
            rest = pdf.drop(columns=[passage, page])
            yield rest.assign(window_start=start, window_end=end, match_count=matches, match_ratio=[round(r, 3) for r in ratio], coverage=[round(c, 3) for c in coverage], fits=fits)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name not in (passage, page)]
    return pairs.mapInPandas(run, ", ".join([*fields, "window_start int, window_end int, match_count int, match_ratio double, coverage double, fits boolean"]))


def text_ratio(selected: str, text: str) -> float:
    """ALN3: the best share of characters in matching blocks, of the selection and the text or a window of the selection's length,
    a quarter of it apart; the last window ends with the text."""
    if not selected or not text:
        return 0.0
    a, b = _numbers(selected, text)
    n, step = len(a), max(1, len(a) // 4)
    cuts = [(0, len(b))]
    if len(b) > n:
        cuts += [(s, s + n) for s in range(0, len(b) - n + 1, step)] + [(len(b) - n, len(b))]
    kinds, times = np.unique(a, return_counts=True)
    most = [2 * np.minimum(times, (b[i:j][None] == kinds[:, None]).sum(1)).sum() / (n + j - i) for i, j in cuts]
    best = 0.0
    for k in np.argsort(-np.array(most), kind="stable").tolist():
        if most[k] <= best:
            break
        window = b[slice(*cuts[k])]
        usable = None
        if len(window) >= POPULAR:
            held = np.bincount(window, minlength=int(b.max()) + 1)
            usable = held[window] <= len(window) // 100 + 1
        best = max(best, 2 * matched(a, window, usable) / (n + len(window)))
    return best


def fuzzy(pairs: DataFrame, selected: str, text: str) -> DataFrame:
    """ALN3: pairs of texts to ratio (six digits), in place of the texts; a null or empty text has 0."""

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces:
            yield pdf.drop(columns=[selected, text]).assign(ratio=[round(text_ratio(a or "", b or ""), 6) for a, b in zip(pdf[selected], pdf[text], strict=True)])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name not in (selected, text)]
    return pairs.mapInPandas(run, ", ".join([*fields, "ratio double"]))
