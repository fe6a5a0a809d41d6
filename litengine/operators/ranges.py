"""Range joins by bins of pages, and the alignment of chunks with the lines of their pages that is built on them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence, Set

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

#: Widths of bins. A range is put into bins of the least width of which it covers at most 17, and into those of the last otherwise.
WIDTHS = (1, 16, 256, 4096)
#: Rows of a bin and side that meet in one task; fuller bins are cut.
BOUND = 1000


def _binned(df: DataFrame, columns: Sequence[str], key: str, bins: Column) -> DataFrame:
    """One row for each bin a row stands in: _k, _bin (width and number), and the row as _row."""
    return df.select(C(key).alias("_k"), F.explode(bins).alias("_bin"), F.struct(*columns).alias("_row"))


def held(points: DataFrame, ranges: DataFrame, key: str, at: str, low: str, high: str, ident: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Points with the ranges of their key that hold them, low and high included; an open end counts as the start.

    Both sides are joined on bins of positions (whole numbers), each pair in exactly one; a bin with many rows is cut into a
    grid, a point going to one row of cells and a range to one column, so a key with very many ranges is no single task's work.
    Null keys, positions and starts meet nothing, as do ranges that end before they start. how: `inner`, or `left`, which keeps
    points without a range, told by the columns `ident`. Columns of ranges other than the key must not be named as those of points.
    """
    last = F.coalesce(C(high), C(low))
    width = F.coalesce(*[F.when(last - C(low) < 16 * w, w) for w in WIDTHS[:-1]], F.lit(WIDTHS[-1]))
    at_bin = lambda x, w: F.floor(x / w).cast("long")
    of_point = F.array(*[F.struct(F.lit(w).alias("w"), at_bin(C(at), w).alias("b")) for w in WIDTHS])
    of_range = F.transform(F.sequence(at_bin(C(low), width), at_bin(last, width)), lambda b: F.struct(width.alias("w"), b.alias("b")))
    p = _binned(points.where(C(key).isNotNull() & C(at).isNotNull()), points.columns, key, of_point)
    r = _binned(ranges.where(C(key).isNotNull() & (last >= C(low))), ranges.columns, key, of_range)
    cell = ["_k", "_bin"]
    size = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BOUND).cast("int").alias(name))
    sizes = size(r, "_nr").join(size(p, "_np"), cell)
    each = lambda n: F.explode(F.sequence(F.lit(0), C(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("_row"), C(n)).cast("int")
    p = p.join(sizes, cell).select(*cell, C("_row").alias("_p"), dealt("_np").alias("_cp"), each("_nr").alias("_cr"))
    r = r.join(sizes, cell).select(*cell, C("_row").alias("_r"), dealt("_nr").alias("_cr"), each("_np").alias("_cp"))
    met = p.join(r, [*cell, "_cp", "_cr"]).where(C(f"_p.{at}").between(C(f"_r.{low}"), F.coalesce(C(f"_r.{high}"), C(f"_r.{low}"))))
    found = met.select(*[C(f"_p.{c}").alias(c) for c in points.columns], *[C(f"_r.{c}").alias(c) for c in ranges.columns if c != key])
    if how == "inner":
        return found
    alone = points.join(found.select(*ident).distinct(), list(ident), "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


# How strong and how weak a line is, the least mean score of a window, and what a window's score is made of.
STRONG, MEDIUM, EDGE, DENSITY = 0.72, 0.35, 0.25, 0.28
OVERLAP, PER_STRONG, PER_MEDIUM, PER_LINE_OVER, FREE_LINES, PER_LOW = 1.25, 0.08, 0.03, 0.06, 6, 0.12
LABEL = r"(?:图|表)\s*\d+(?:[-－]\d+)?"
APART = ("header", "page_number", "footer")
#: What is no letter or digit, in plain and in all texts; tokens; runs that are cut into pairs.
BETWEEN = {k: None for k in range(128) if not chr(k).isalnum()}
NO_LETTER, WORD, CJK_RUN = re.compile(r"[\W_]+"), re.compile(r"[a-z0-9]{2,}|[\u4e00-\u9fff]{2,}"), re.compile(r"[\u4e00-\u9fff]{4,}")
#: Lines in one piece of a page; a window may reach into the next piece. Pieces that a task holds at once.
PIECE, HELD = 64, 8


def _forms(text: str) -> tuple[str, frozenset[str], np.ndarray]:
    """A text's letters and digits without anything between them, its tokens (STR25), and the runs of three of the former as sorted numbers."""
    low = text.lower()
    if low.isascii():
        bare, held = low.translate(BETWEEN), WORD.findall(low)
        codes = np.frombuffer(bare.encode(), np.uint8).astype(np.int64)
    else:
        bare, held = NO_LETTER.sub("", low), WORD.findall(low)
        held += [run[i : i + 2] for run in CJK_RUN.findall(low) for i in range(len(run) - 1)]
        codes = np.frombuffer(bare.encode("utf-32-le"), np.uint32).astype(np.int64)
    grams = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]  # a character has 21 bits
    grams.sort()
    return bare, frozenset(held), grams[np.concatenate(([True], grams[1:] != grams[:-1]))] if len(grams) else grams


def _overlap(a: Set[str], b: Set[str]) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


class _Piece:
    """The lines of a piece of a page, told apart by their words and their runs of three characters once for all chunks."""

    def __init__(self, lines: pa.StructArray):
        self.lines = list(zip(*(lines.field(c).to_pylist() for c in ("index", "line", "own", "caption", "shown")), strict=True))
        self.bare, self.words, grams = zip(*map(_forms, lines.field("match").to_pylist()), strict=True)
        self.sizes = [len(g) for g in grams]
        self.grams, at = np.unique(np.concatenate(grams), return_inverse=True)
        self.holds = np.zeros((len(self.grams), len(lines)), np.float32)
        self.holds[at, np.repeat(np.arange(len(lines)), self.sizes)] = 1
        self.tokens = {w: k for k, w in enumerate(set().union(*self.words))}
        self.holds_token = np.zeros((len(self.tokens), len(lines)), np.float32)
        for k, words in enumerate(self.words):
            self.holds_token[[self.tokens[w] for w in words], k] = 1

    def shared(self, tokens: Set[str], grams: np.ndarray) -> Iterator[tuple[float, float]]:
        """How many of a chunk's words and runs each line has."""
        of_token = self.holds_token[[self.tokens[w] for w in tokens if w in self.tokens]].sum(0)
        at = np.searchsorted(self.grams, grams).clip(max=len(self.grams) - 1) if len(self.grams) else grams[:0]
        return zip(of_token.tolist(), self.holds[at[self.grams[at] == grams[: len(at)]]].sum(0).tolist(), strict=True)

    def rows(self, text: str, chunk: tuple[str, frozenset[str], np.ndarray]) -> list[tuple]:
        """Lines that may take part with a chunk (index, line, owned, words), how much of each it holds, and whether all of it."""
        bare, tokens, grams = chunk
        labels = None
        out = []
        for (index, line, owned, caption, shown), own, words, n, (of_token, of_gram) in zip(self.lines, self.bare, self.words, self.sizes, self.shared(tokens, grams), strict=True):
            if caption:
                labels = set(re.findall(LABEL, text)) if labels is None else labels
                if not any(label in shown for label in labels):
                    continue
            score, exact = 0.0, False
            if own and (own in bare or (len(bare) >= 24 and bare in own)):
                score, exact = 1.0, True
            elif own and (of_token or of_gram):
                score = round(max(of_token and of_token / min(len(tokens), len(words)), of_gram and of_gram / min(len(grams), n)), 4)
            out.append((index, line, owned, words, score, exact))
        return out


def _best_window(tokens: Set[str], rows: list[tuple], longest: int) -> tuple | None:
    """WIN7: of all runs of consecutive rows (index, line, owned, words, score, exact) with an owned start: score, length, -start, rows.

    The highest score wins, then the longer run, then the earlier one; None where no run will do.
    """
    best, least = None, 0.0
    scores = [x[4] for x in rows]
    gains = [max(0.0, s + (PER_STRONG if s >= STRONG else PER_MEDIUM if s >= MEDIUM else -PER_LOW)) for s in scores]
    most = [sum(gains[i : i + longest]) + OVERLAP + 0.001 for i in range(len(rows))]
    for i in sorted(range(len(rows)), key=most.__getitem__, reverse=True):
        if most[i] < least:
            break
        start, owned = rows[i][0], rows[i][2]
        if not owned or max(scores[i : i + longest]) < MEDIUM:
            continue
        total, strong, medium, held, seen = 0.0, 0, 0, set(), i
        for at in range(i, min(i + longest, len(rows))):
            n = at - i + 1
            if rows[at][0] - start != n - 1:
                break
            score = scores[at]
            total += score
            if score >= STRONG:
                strong += 1
            elif score >= MEDIUM:
                medium += 1
            if (strong or medium > 1) and total / n >= DENSITY:
                rest = PER_STRONG * strong, PER_MEDIUM * medium, PER_LINE_OVER * max(0, n - FREE_LINES), PER_LOW * (n - strong - medium)
                # No overlap is above 1: a run that even then stays below the best one needs no words.
                if total + OVERLAP + rest[0] + rest[1] - rest[2] - rest[3] + 0.001 < least:
                    continue
                held.update(*(x[3] for x in rows[seen : at + 1]))
                seen = at + 1
                value = total + OVERLAP * _overlap(tokens, held) + rest[0] + rest[1] - rest[2] - rest[3]
                rank = (round(value, 4), n, -start)
                if best is None or rank > best[0]:
                    best, least = (rank, i), rank[0]
    return best and (*best[0], rows[best[1] : best[1] + best[0][1]])


def _runs(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[tuple, _Piece] = {}
        for batch in batches:
            found = []
            places = zip(*(batch.column(c).to_pylist() for c in ("_key", "page", "piece")), strict=True)
            for k, (place, text) in enumerate(zip(places, batch.column("chunk_text").to_pylist(), strict=True)):
                if place not in pieces:  # rows of a piece come together, also over batches: its lines are read once
                    if len(pieces) == HELD:
                        pieces.clear()
                    pieces[place] = _Piece(batch.column("lines")[k].values)
                chunk = _forms(text)
                found.append(_best_window(chunk[1], pieces[place].rows(text, chunk), longest))
            at = pa.array([k for k, x in enumerate(found) if x], pa.int64())
            best = [x for x in found if x]
            links = [[{"line": r[1], "score": r[4], "exact": r[5]} for r in x[3]] for x in best]
            kind = pa.list_(pa.struct([("line", pa.int64()), ("score", pa.float64()), ("exact", pa.bool_())]))
            held = [batch.column(c).take(at) for c in ("_key", "chunk", "page")]
            columns = [*held, pa.array([x[0] for x in best], pa.float64()), pa.array([x[1] for x in best], pa.int32()), pa.array([x[2] for x in best], pa.int64()), pa.array(links, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "chunk", "page", "total", "n", "start", "lines"])

    return run


def _on_pages(chunks: DataFrame, pages: DataFrame, key: str, span: int | None) -> DataFrame:
    """Key, page, chunk and chunk_text of the pages that a chunk covers."""
    if span is None:
        places = held(pages, chunks.select(key, "chunk", "page_start", "page_end"), key, "page", "page_start", "page_end")
        return places.select(key, "chunk", "page").join(chunks.select(key, "chunk", "chunk_text"), [key, "chunk"])
    last = F.coalesce("page_end", "page_start")
    wide = F.raise_error(F.format_string("a chunk covers more than %d pages", F.lit(span))).cast("array<bigint>")
    covered = F.when(last - C("page_start") < span, F.sequence(C("page_start").cast("long"), last.cast("long"))).otherwise(wide)
    return chunks.where(last >= C("page_start")).select(key, F.explode(covered).alias("page"), "chunk", "chunk_text")


def aligned_lines(chunks: DataFrame, lines: DataFrame, key: str, longest: int = 10, span: int | None = None) -> DataFrame:
    """ALN6, WIN7, J11: each chunk's lines: key, chunk, page, line, score, method and confidence.

    chunks: key, chunk, page_start, page_end, chunk_text; lines: key, page, line_index, line, text, role. On each page a chunk
    covers, every run of at most `longest` lines with consecutive indexes is scored, and the chunk gets the best run of all
    (at the same score the earlier page, the longer run, the earlier start), less weak lines at its ends. Heads, feet, page
    numbers, blank lines and captions that the chunk does not name take no part, and break a run. Of lines with one index on
    a page the least `line` counts. Pages are cut into pieces of bounded length that overlap by a run, so a page may have any
    number of lines. Chunks without a page or text, and null lines, have no links. span: how many pages a chunk covers at most,
    where that is known: chunks are then dealt to their pages without a range join, and one that covers more is an error.
    """
    shown = lines.where(C("page").isNotNull() & C("line_index").isNotNull() & C("line").isNotNull() & (F.trim("text") != "") & ~F.coalesce("role", F.lit("body")).isin(*APART))
    match = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[`*_#]+", " "), r"\s+", " "))
    caption = F.coalesce(C("role") == "figure_caption", F.lit(False))
    piece = F.floor(C("line_index") / PIECE).cast("long")
    owners = F.when((C("line_index") % PIECE < longest - 1) & (piece > 0), F.array(piece, piece - 1)).otherwise(F.array(piece))
    dealt = shown.select(key, "page", "line_index", C("line").cast("long").alias("line"), match.alias("match"), caption.alias("caption"), F.when(caption, C("text")).alias("shown"), F.explode(owners).alias("piece"))
    # Lines are shuffled once: the page holds its pieces, a piece its lines.
    line = F.struct(C("line_index").alias("index"), "line", "match", "caption", "shown", (piece == C("piece")).alias("own"))
    first = dealt.repartition(key, "page").groupBy(key, "page", "piece", "line_index").agg(F.min_by(line, "line").alias("l"))
    pieces = first.groupBy(key, "page", "piece").agg(F.array_sort(F.collect_list("l")).alias("lines"))

    at = _on_pages(chunks.where(C("chunk_text").isNotNull()), shown.select(key, "page").distinct(), key, span)
    both = pieces.join(at, [key, "page"])
    types = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = f"_key {types[key]}, chunk {types['chunk']}, page {types['page']}, total double, n int, start bigint, lines array<struct<line: bigint, score: double, exact: boolean>>"
    runs = both.select(C(key).alias("_key"), "chunk", "page", "piece", "lines", "chunk_text").mapInArrow(_runs(longest), schema).withColumnRenamed("_key", key)
    best = runs.groupBy(key, "chunk").agg(F.max_by(F.struct("page", "lines"), F.struct(C("total"), -C("page"), C("n"), C("start"))).alias("b"))
    places_of = F.transform("b.lines", lambda x, i: F.when(x["score"] >= EDGE, i))
    ends = best.withColumn("_a", F.array_min(places_of)).withColumn("_z", F.array_max(places_of))
    links = ends.select(key, "chunk", C("b.page").alias("page"), F.explode(F.slice("b.lines", C("_a") + 1, C("_z") - C("_a") + 1)).alias("l"))
    method = F.when(C("l.score") < STRONG, "line_window").when(C("l.exact"), "exact_text").otherwise("token_overlap")
    return links.select(key, "chunk", "page", C("l.line").alias("line"), C("l.score").alias("score"), method.alias("method"), F.when(C("l.score") >= STRONG, "high").otherwise("medium").alias("confidence"))
