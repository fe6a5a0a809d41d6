"""op11 to op13 against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from litengine.llm import alignment, exact_dedup, lexical_search

from .conftest import clashing, prose

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_copies(rows):
    norm = [(d, (t or "").translate(UPPER)) for d, t in rows]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return [(d, keep[t], len(groups[t]), d == keep[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in norm]


def odd_texts(corpus):
    rng = random.Random(5)
    more = [(400, "ÄÖ Straße"), (401, "äö straße"), (402, "ABC"), (403, "abc"), (404, " abc"), (405, "x\0y"), (406, None), (None, "abc"), (None, "alone"), (407, "𐍈 é́\r\n\t  end "), (408, "İ K")]
    more += [(500 + k, "Copied by many") for k in range(300)] + [(408, "İ K"), (900, prose(rng, 60_000))]
    return [r[:2] for r in corpus] + more


@pytest.fixture(scope="module")
def odd(spark, corpus):
    return spark.createDataFrame(odd_texts(corpus), "doc_id long, text string").repartition(6)


def test_copies(spark, odd, corpus):
    want = Counter(brute_copies(odd_texts(corpus)))
    assert Counter(map(tuple, exact_dedup.copies(odd).collect())) == want
    assert Counter(map(tuple, exact_dedup.copies(odd, capacity=4).collect())) == want
    assert Counter(map(tuple, exact_dedup.copies(clashing(odd)).collect())) == want


def test_copies_with_colliding_keys(odd, corpus):
    """Seven keys for all texts: the texts of a key are chained, and only equal bytes are copies."""
    weak = lambda text: F.length(text).cast("long") % 7 * (1 << 58)
    assert Counter(map(tuple, exact_dedup.copies(odd, key=weak).collect())) == Counter(brute_copies(odd_texts(corpus)))


def test_directory(odd, corpus):
    index = exact_dedup.build(odd, capacity=5)
    texts = {(t or "").translate(UPPER) for _, t in odd_texts(corpus)}
    entries, slots = index.entries.collect(), index.directory.collect()
    assert len(entries) == len(texts) and all(e.chain == 1 for e in entries)
    assert sorted(s.slot for s in slots if s.bucket in {e.bucket for e in entries}) == sorted({s.slot for s in slots if s.bucket in {e.bucket for e in entries}})
    assert max(Counter(e.bucket for e in entries).values()) <= 5
    depths = {s.bucket: s.depth for s in slots}
    assert max(depths.values()) == index.depth and len(set(depths.values())) > 1
    for bucket, depth in depths.items():
        assert sum(s.bucket == bucket for s in slots) == 1 << (index.depth - depth)


def test_without_copies(odd, corpus, nothing):
    kept = exact_dedup.without_copies(clashing(odd))
    assert kept.columns == clashing(odd).columns
    want = Counter((d, t) for (d, t), r in zip(odd_texts(corpus), brute_copies(odd_texts(corpus)), strict=True) if r[3])
    assert Counter((r.doc_id, (r.text or "")) for r in kept.collect()) == Counter({(d, t or ""): 1 for d, t in want})
    assert exact_dedup.copies(nothing).count() == 0 and exact_dedup.without_copies(nothing).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_search(rows, items, k=10):
    docs = [(d, Counter(words(t))) for d, t in rows if words(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        wanted, found = Counter(words(text)), []
        for d, c in docs:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def questions(corpus):
    rng = random.Random(8)
    texts = [r[1] for r in corpus if r[1]]
    items = [(k, " ".join(rng.sample(words(rng.choice(texts)) or ["a"], 1) + words(rng.choice(texts))[:30] * rng.randint(1, 2))) for k in range(40)]
    return [*items, (100, None), (101, "?!"), (102, "no such words zzzz"), (103, "copied by many many"), (103, "copied by many many"), (None, "STRASSE straße abc")]


@pytest.mark.parametrize(("documents", "size", "characters"), [(4096, 1 << 20, 2_000_000), (16, 1 << 20, 900), (1, 50, 2_000_000)])
def test_search(spark, odd, corpus, documents, size, characters, monkeypatch):
    monkeypatch.setattr(lexical_search, "QUERY_CHARACTERS", characters)
    items = questions(corpus)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(lexical_search.build(odd, documents, size), queries)
    assert Counter(map(tuple, got.collect())) == Counter(brute_search(odd_texts(corpus), items))


def test_search_edges(spark, odd, nothing):
    queries = spark.createDataFrame([(1, "copied")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build(nothing), queries).count() == 0
    index = lexical_search.build(clashing(odd))
    assert lexical_search.search(index, queries.limit(0)).count() == 0
    got = lexical_search.search(index, queries.selectExpr("*", "1 as query", "2 as score"), k=3).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got)] == [(1, 500), (2, 501), (3, 502)]


def plain_alignment(paths, texts):
    """Groups and links of each text from character-free byte offsets, and the slow tokenizer of the file."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    byte = alignment.byte_alphabet()
    out = []
    for text in texts:
        groups, raw = [], (" " + (text or "")).encode()
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ib = b.encode(text or "")
        ba = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != raw or b"".join(bb) != raw:
            out.append(([], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, ba))).tolist(), np.cumsum(list(map(len, bb))).tolist()
        x = y = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ia[x:i], ib[y:j]))
            x, y = i, j
        out.append((ia, ib, groups))
    return out


def test_alignment(spark, nothing):
    rng = random.Random(4)
    pieces = ["hello", " ", "  ", "\n", "<s>", "<|endoftext|>", "<unk>", "é", "é", "𐍈", "日本語", "\0", "\t", "'s", "123", "ﬁ", "▁", "_", "Ünïcödé", "\r\n", " ", "​", "don't", "A", "."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", " ", "a", "▁", prose(rng, 3000), "hello hello", "hello hello"]
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)]
    want = plain_alignment(alignment.default_paths(), texts)
    pairs = Counter((g[0][-1], g[1][-1]) for _, _, gs in want for g in gs)
    most = defaultdict(int)
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    expected = Counter()
    for (doc, _), (a, b, gs) in zip(rows, want, strict=True):
        linked = [(g[0][-1], g[1][-1]) for g in gs]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        expected[doc, len(a), len(b), len(gs), len(gs), sum(pairs[p] == most[p[1]] for p in linked), sum(pairs[p] for p in linked), digest] += 1
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    for share in (alignment.HOT_SHARE, 0.05):
        alignment.HOT_SHARE, before = share, alignment.HOT_SHARE
        got = alignment.alignment_counts(docs).drop("n_overlaps").collect()
        alignment.HOT_SHARE = before
        assert Counter(map(tuple, got)) == expected
    assert alignment.alignment_counts(nothing).count() == 0


def test_align_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        cut = lambda: np.diff(np.concatenate(([0], np.unique(rng.integers(1, n + 1, 8)), [n])))
        a, b = (x[x > 0] for x in (cut(), cut()))
        over_a, over_b, cuts_a, cuts_b = alignment.align(a, b)
        ends_a, ends_b = np.cumsum(a), np.cumsum(b)
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if min(ends_a[i], ends_b[j]) > max(ends_a[i] - a[i], ends_b[j] - b[j])]
        assert list(zip(over_a, over_b, strict=True)) == want
        assert [ends_a[i - 1] for i in cuts_a] == [ends_b[j - 1] for j in cuts_b] == sorted(set(ends_a) & set(ends_b))


def test_long_runs():
    """Runs that the fast encoder gives up on go through the file's own tokenizer."""
    a_path, b_path = alignment.default_paths()
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        coder = alignment.Encoder(a.read(), b.read())
    text = "x" * 3000 + " " * 5000 + "!" * 2000
    assert coder.encode_a(text) == coder.encode_slow(text)
    (a_ids, b_ids), (none, _) = coder.encode([" " * 1_200_000 + "end", ""])
    assert b"".join(coder.a_bytes[i] for i in a_ids) == b"".join(coder.b_bytes[i] for i in b_ids) and not len(none)
