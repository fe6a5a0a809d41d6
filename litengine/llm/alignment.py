"""Cross-tokenizer alignment: which tokens of one tokenizer hold the same bytes as which of another.

A text is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B). np.repeat gives each byte the index
of the A token and of the B token that own it. Where the pair of owners changes, a new overlap begins; where both change
at once, both tokenizations are cut, and what lies between two cuts is a group.

Encoding runs in Arrow batches; what is counted over all documents is counted by Spark.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, stored
from .words import batches

#: Links of a pair with at least this share of all links are hot; at most 1 / HOT_SHARE pairs are, and they go to all tasks (17 bytes each).
HOT_SHARE = 1 / (1 << 18)
#: Different pairs that a task holds while it counts.
HELD = 2_000_000
#: Bytes of text that are encoded at a time; a longer text goes alone.
BLOCK = 1 << 20


def default_paths() -> tuple[str, str]:
    """Where the installed vocabulary files are: byte_bpe_50k.json and piece_bpe_32k.model."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others, in order, U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Encoder:
    """Both tokenizers, and the bytes of their tokens. Built once in each Python worker from the contents of two files."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tiktoken

        alphabet = byte_alphabet()
        entry = {i: t for t, i in json.loads(a_json)["model"]["vocab"].items()}
        # Special tokens are left out, so that their strings are plain text.
        special = {t["id"] for t in json.loads(a_json).get("added_tokens", ())}
        self.a_bytes = [bytes(map(alphabet.__getitem__, entry[i])) if i in entry and i not in special else b"" for i in range(max(entry) + 1)]
        ranks = {b: i for i, b in enumerate(self.a_bytes) if b}
        # Fixed value: how byte-level BPE cuts a text before merging.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(size))]
        self.a_len = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_len = np.array(list(map(len, self.b_bytes)), np.int64)
        self.numbers = np.array([f"{i}{end}" for i in range(max(len(self.a_bytes), size)) for end in ",|;"], object)
        self._json, self._slow = a_json, None

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.a.encode_ordinary(text)
        except BaseException as error:  # the fast encoder gives up (a panic) on runs of a million like characters
            if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return self.encode_slow(text)

    def encode_slow(self, text: str) -> list[int]:
        """The file's own tokenizer: the same ids, at a third of the speed."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._json)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A for space and text, and of B for text (which puts the space itself); none where the bytes differ from these."""
        none = np.zeros(0, np.int32)
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            a, raw = self.encode_a(" " + text), b" " + text.encode()
            if text and b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
                yield np.array(a, np.int32), np.array(b, np.int32)
            else:
                yield none, none


def align(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths in bytes of two tokenizations of one text, to overlaps (A and B indices) and cuts (A and B tokens up to each).

    A token without bytes owns none: it overlaps nothing, and counts to the group of the token after it.
    """
    a, b = np.repeat(np.arange(len(a_len)), a_len), np.repeat(np.arange(len(b_len)), b_len)
    if not len(a):
        return a, b, a, b
    new_a, new_b = np.diff(a) != 0, np.diff(b) != 0
    begins = np.concatenate(([0], np.flatnonzero(new_a | new_b) + 1))
    ends = np.append(np.flatnonzero(new_a & new_b), len(a) - 1)
    return a[begins], b[begins], a[ends] + 1, b[ends] + 1


@cache
def _encoder(a_json: str, b_model: bytes) -> Encoder:
    return Encoder(a_json, b_model)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0)]).astype(np.int32)))


class Aligned(NamedTuple):
    """One text: its ids, its overlaps, and how many tokens of A and B stand before the end of each group."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    overlaps: int
    a_cuts: np.ndarray
    b_cuts: np.ndarray

    def text(self, numbers: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3`. numbers[3 * id + k] is the id followed by a comma, a bar or a semicolon."""
        a = 3 * self.a_ids.astype(np.int64)
        b = 3 * self.b_ids.astype(np.int64)
        a[self.a_cuts - 1] += 1
        b[self.b_cuts - 1] += 2
        # Groups in order, and in each the tokens of A before those of B.
        group_a = np.repeat(np.arange(len(self.a_cuts)), np.diff(self.a_cuts, prepend=0))
        group_b = np.repeat(np.arange(len(self.b_cuts)), np.diff(self.b_cuts, prepend=0))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        return "".join(numbers[np.concatenate((a, b))[order]].tolist())[:-1]

    def links(self, b_size: int) -> np.ndarray:
        """Pairs of tokens whose bytes end together, as a_id * b_size + b_id."""
        return self.a_ids[self.a_cuts - 1].astype(np.int64) * b_size + self.b_ids[self.b_cuts - 1]


Form = Callable[[Encoder, list[Aligned]], list[pa.Array]]


def _mapped(docs: DataFrame, files: tuple[str, bytes], schema: str, form: Form) -> DataFrame:
    """Every row of docs encoded and aligned in its task: row_id, doc_id and what `form` makes of a block of texts."""
    a_json, b_model = files[0], base64.b64encode(files[1])
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    modest_batches(rows)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(a_json, base64.b64decode(b_model))
        for piece in pieces:
            texts = piece.column("text")
            for i, j in batches(texts, BLOCK):
                found = [Aligned(a, b, len(over), *cuts) for a, b in coder.encode([t or "" for t in texts[i:j].to_pylist()]) for over, _, *cuts in [align(coder.a_len[a], coder.b_len[b])]]
                yield pa.RecordBatch.from_arrays([piece.column("row_id")[i:j], piece.column("doc_id")[i:j], *form(coder, found)], ["row_id", "doc_id", *names])

    return rows.mapInArrow(run, f"row_id long, doc_id long, {schema}")


def _files(paths: tuple[str, str] | None) -> tuple[str, bytes]:
    """Contents of the vocabulary files (3 MB), which the driver reads once and sends to the executors."""
    a_path, b_path = paths or default_paths()
    return Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): row_id (unique), doc_id, a_ids, b_ids, a_cuts, b_cuts, n_overlaps.

    Group k holds the A tokens from a_cuts[k - 1] to a_cuts[k], and so for B. `paths` are the vocabulary files. Texts that
    are null or empty, or whose tokens do not give back the text with a space before it, have no tokens. Whole texts are
    encoded, however long. Other columns are not looked at, null doc_ids and repeated rows are rows like others, and an
    empty table gives an empty one.
    """

    def form(_: Encoder, found: list[Aligned]) -> list[pa.Array]:
        lists = (_lists([getattr(f, name) for f in found]) for name in ("a_ids", "b_ids", "a_cuts", "b_cuts"))
        return [*lists, pa.array([f.overlaps for f in found], pa.int64())]

    return _mapped(docs, _files(paths), "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, n_overlaps long", form)


def _codes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Links of a batch's rows, end to end, and where each row's begin."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, kind)[at[0] // width : at[-1] // width] if raw is not None and at[-1] > at[0] else np.zeros(0, kind), (at - at[0]) // width


def _pair_counts(rows: DataFrame, kind: type, b_size: int) -> DataFrame:
    """pair, n (how often it is linked in all rows), best (no pair with the same B id is linked more often)."""

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for piece in pieces:
            codes, _ = _codes(piece.column(0), kind)
            pair, n = np.unique(codes, return_counts=True)
            held, at = np.unique(np.concatenate((held, pair)), return_inverse=True)
            times = np.bincount(at, np.concatenate((times, n)), len(held)).astype(np.int64)
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(times)], ["pair", "n"])
                held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(times)], ["pair", "n"])

    counts = stored(rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair") % b_size
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    return stored(counts.join(most, b_id == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _row_sums(rows: DataFrame, pairs: DataFrame, kind: type) -> DataFrame:
    """row_id, n_best, count_sum: over the links of a row, how many are best, and their pairs' counts.

    A bounded number of pairs is hot and goes to the rows. Links of the others, none of which has a large share of all
    links, are shuffled to their pairs.
    """
    total = pairs.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") >= total * HOT_SHARE
    hot = pairs.where(is_hot).toArrow()  # at most 1 / HOT_SHARE rows
    order = np.argsort(hot.column("pair").to_numpy())
    # A last entry that no pair equals, so that there is always one to look at.
    keys = np.append(hot.column("pair").to_numpy()[order], np.iinfo(np.int64).max)
    n, best = (np.append(hot.column(c).to_numpy(zero_copy_only=False)[order], 0).astype(np.int64) for c in ("n", "best"))

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces:
            codes, first = _codes(piece.column("links"), kind)
            at = np.searchsorted(keys, codes)
            have = keys[at] == codes
            sums = [np.diff(np.concatenate(([0], np.cumsum(np.where(have, x[at], 0))))[first]) for x in (best, n)]
            ids, names = piece.column("row_id"), ["row_id", "n_best", "count_sum", "pair"]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, sums), pa.nulls(len(ids), pa.int64())], names)
            ids = ids.take(pa.array(np.repeat(np.arange(len(ids)), np.diff(first))[~have]))
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, none, none, pa.array(codes[~have].astype(np.int64))], names)

    parts = stored(rows.select("row_id", "links").mapInArrow(run, "row_id long, n_best long, count_sum long, pair long"), "link-sums")
    cold = parts.where("pair is not null").select("row_id", "pair").join(pairs.where(~is_hot), "pair")
    far = cold.select("row_id", F.col("best").cast("long").alias("n_best"), F.col("n").alias("count_sum"))
    return parts.where("pair is null").select("row_id", "n_best", "count_sum").unionByName(far).groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """For each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps.

    Links are the pairs of an A and a B token whose bytes end together; a pair of ids counts how often it is linked in all
    of docs. n_best counts the links whose pair no other of the same B id exceeds, count_sum adds the counts of all.
    groups_sha256 is of `a1,a2|b1;a3|b2,b3`, the ids group by group; without tokens it is empty. Edge cases are those of
    `aligned`.
    """
    import sentencepiece

    files = _files(paths)
    a_size, b_size = max(json.loads(files[0])["model"]["vocab"].values()) + 1, sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    kind = np.int32 if a_size * b_size < 1 << 31 else np.int64

    def form(coder: Encoder, found: list[Aligned]) -> list[pa.Array]:
        counts = ([len(f.a_ids) for f in found], [len(f.b_ids) for f in found], [len(f.a_cuts) for f in found], [f.overlaps for f in found])
        digests = [hashlib.sha256(f.text(coder.numbers).encode()).hexdigest() if len(f.a_ids) else "" for f in found]
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([f.links(b_size).astype(kind).tobytes() for f in found], pa.binary())]

    rows = stored(_mapped(docs, files, "n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, links binary", form), "aligned")
    sums = _row_sums(rows, _pair_counts(rows, kind, b_size), kind)
    return rows.drop("links").join(sums, "row_id").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", "n_overlaps")
