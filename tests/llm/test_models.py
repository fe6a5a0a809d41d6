"""op1, op4 to op7, op9 and op10 against brute force, held-out texts or planted cases."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litengine.llm import ann, decontamination, language_id, mixing, pii, quality, toxicity
from litengine.llm.words import split

from .conftest import clashing, prose

held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0


# --- op1


def expected(cells, dim):
    """Shares of a marginal in the expected sample, and its tokens over all."""
    kept = (cells.p * cells.tokens).groupby(cells[f"_{dim}"]).sum()
    return kept / kept.sum(), (cells.p * cells.tokens).sum() / cells.tokens.sum()


def test_mixture_reaches_targets(spark):
    """Small values that are asked for more than they have give all of it, and others make up for it: targets and budget hold."""
    rng, rows = random.Random(21), []
    for k in range(3000):
        source = "big" if k % 3 else f"s{k % 5}"
        rows.append((k, " ".join(["word"] * rng.randint(1, 30)), rng.choice(("en", "en", "en", "de", "fr")), source))
    rows += [(5000 + k, "all rights reserved by one", "xx", "rare") for k in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"big": 0.4, "s0": 0.15, "s1": 0.15, "s2": 0.1, "s3": 0.1, "s4": 0.1}, "lang": {"en": 0.5, "de": 0.25, "fr": 0.25}}
    cells = mixing.fitted(frame, targets, budget=0.3).toPandas()
    assert ((cells.p >= 0) & (cells.p <= 1)).all() and abs(cells.weight.sum() - 1) < 1e-9
    for dim, asked in targets.items():
        got, size = expected(cells, dim)
        assert abs(size - 0.3) < 0.003
        assert all(abs(got[name] - share) < 0.005 for name, share in asked.items()), (dim, got)
    # By default, rare values are asked for more than they have: their cells are kept whole, and the budget still holds.
    cells = mixing.fitted(frame).toPandas()
    got, size = expected(cells, "lang")
    assert abs(size - 0.5) < 0.005 and cells[cells._source == "rare"].p.min() == 1
    for dim in mixing.DIMENSIONS:
        got, _ = expected(cells, dim)
        want = cells.groupby(f"_{dim}")[f"target_{dim}"].first()
        assert (abs(got - want / want.sum()) < 0.005).all(), (dim, got, want / want.sum())


def test_mixture_is_a_calibrated_sample(spark):
    rows = [(k, "word " * (1 + k % 5), ("en", "fr")[k % 2], "big" if k % 3 else f"s{k % 4}") for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got, again = mixing.mixed(frame).collect(), mixing.mixed(frame.repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in again)
    total = sum(1 + k % 5 for k, *_ in rows)
    # Weighting by 1 / p gives the whole back, and the sample holds about the budget.
    assert abs(sum(r.mix_tokens * r.mix_weight for r in got) / total - 1) < 0.08
    assert 0.3 < sum(r.mix_tokens for r in got) / total <= 0.6


def test_mixing_odd_tables(docs, nothing):
    assert mixing.mixed(nothing).count() == 0
    kept = mixing.mixed(docs).collect()
    assert len(kept) == mixing.mixed(clashing(docs)).count()
    assert not {300, 301} & {r.doc_id for r in kept}


TOLD = (
    ("COPYRIGHT 2020 by no one", "licence"), ("ALL RIGHTS RESERVED", "licence"), ("Licenced under terms", "licence"), ("Password = x", "secret"), ("TOKEN\t= x", "secret"),
    ("akia" + "0" * 16, "secret"), ("jo@mail.org", "contact"), ("call +1 234", "contact"), ("a | b", "table"), ("<p>open", "markup"), ("### head", "markup"),
    ("forgot my password again", "prose"), ("AKIA", "prose"), ("at @ home", "prose"), ("1 + x", "prose"), ("</", "prose"), ("a|b", "prose"), ("token here, and x = 1", "prose"), ("", "prose"), (None, "prose"),
)


def test_topics_and_words(spark):
    """Topics whatever the case, and never by a mark alone; words between runs of any ASCII white space."""
    texts = [t for t, _ in TOLD] + ["a\tb\x0bc\x0cd\r\n    e  f \n", "  ", "\u00a0 \u00e9 x\u2003y", "\x01 \x02"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    got = {r.doc_id: r for r in mixing.with_cells(frame).collect()}
    assert [got[k]._topic for k in range(len(TOLD))] == [topic for _, topic in TOLD]
    assert [got[k]._tokens for k in range(len(texts))] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# --- op4


def test_toxicity_held_out(spark):
    rng, rows, labels = random.Random(1), [], []
    for k in range(900):
        words, toxic = prose(rng, 60).split(), k % 6 == 0
        for _ in range(4 * toxic):
            words[rng.randrange(60)] = rng.choice(("idiotic", "idiotism", "scumbag", "idiotly"))
        if k % 6 == 1:  # a phrase that is not toxic
            words[10:12] = ["scumbag", "museum"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.scored(docs, lexicon).collect()}
    assert all(got[k].held_out == held(k) and 0 <= got[k].score <= 1 and got[k].predicted == (got[k].score >= 0.5) for k, _ in rows)
    wrong = [k for k, t in labels if held(k) and got[k].predicted != t]
    assert len(wrong) <= 2
    assert "scumbag museum" in lexicon.exceptions
    assert lexicon.score("you are an 1d10tic sсumbаg") > 0.5 > lexicon.score("the scumbag museum is open in 1999!")
    for between in (", ", "  ", "-", "... \n "):
        text = f"the Scumbag{between}museum and one scumbag too"
        assert [(s, text[s:e]) for s, e, _ in lexicon.spans(text)] == [(text.rindex("scumbag"), "scumbag")]
    r = got[0]
    assert all(toxicity.fold(rows[0][1][s.start : s.end]).startswith(("idio", "scum")) for s in r.spans)


def brute_toxic(lexicon, text):
    """Entries by a search for each, on folded text with single spaces; the heaviest of those that begin together; none inside an exception."""
    plain = re.sub(" +", " ", f" {toxicity.fold(text)} ")
    at = lambda w: [m.start() + 1 for m in re.finditer(f"(?= {re.escape(w)})", plain)]
    hits = [(s, len(w), x) for w, x in lexicon.stems.items() for s in at(w)] + [(s, len(w), x) for w, x in lexicon.words.items() for s in at(f"{w} ")]
    apart = [(s, s + len(w)) for w in lexicon.exceptions for s in at(f"{w} ")]
    heaviest = {}
    for s, n, x in hits:
        if s not in heaviest or x > heaviest[s][1]:
            heaviest[s] = (n, x)
    return sorted((plain[s : s + n], x) for s, (n, x) in heaviest.items() if not any(a <= s and s + n <= b for a, b in apart))


def test_toxicity_against_a_search_for_each_entry(spark, docs, corpus, nothing):
    rng = random.Random(8)
    lexicon = toxicity.Lexicon({"scumbag": 4.0, "bag": 3.5}, {"idio": 5.0, "scum": 3.0}, frozenset({"scumbag museum", "old scumbag", "idiotic joke"}))
    parts = ("scumbag", "Scumbags", "museum", "idiotic", "1d10t", "joke", "old", "bag", ",", "  ", "- ", "fine", "\n", "é")
    texts = ["".join(rng.choice(parts) + rng.choice((" ", "", ", ")) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["scumbag " * 50_000]
    for t in texts:
        got = lexicon.spans(t)
        assert sorted((re.sub(" +", " ", toxicity.fold(t[s:e])), w) for s, e, w in got) == brute_toxic(lexicon, t), t
    rows = toxicity.scored(clashing(docs), lexicon).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus)
    want = {r[0]: lexicon.score(r[1] or "") for r in corpus}
    assert all(abs(r.score - want[r.doc_id]) < 1e-12 and not r.spans for r in rows)
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(nothing, toxicity.fit(nothing, marks)).count() == 0 and all(0 <= r.score <= 1 for r in toxicity.scored(docs, toxicity.fit(docs, marks)).collect())


def test_folding_keeps_length():
    for text in ("1D10T!! 1999 о Trаsh $cum", "ÀÉ straße İ", "", "a\x00b", "𝔘 4ever"):
        assert len(toxicity.fold(text)) == len(text)
    assert toxicity.fold("1D10T") == "idiot" and toxicity.fold("in 1999") == "in 1999" and toxicity.fold("oh!") .rstrip() == "oh"


# --- op5


def test_language_held_out(spark, docs, corpus):
    model = language_id.fit(docs)
    got = language_id.predicted(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus)
    truth = {r[0]: r[2] for r in corpus if r[0] is not None and r[0] < 120}
    found = {r.doc_id: r for r in got}
    assert all(found[k].lang_pred == lang for k, lang in truth.items() if held(k))
    for k in (300, 301, 304):
        assert (found[k].lang_pred, found[k].score, found[k].rejected) == ("und", 0.0, True)
    kept = {r.doc_id for r in language_id.accepted(docs, model).collect()}
    assert kept == {r.doc_id for r in got if not r.rejected} and set(truth) <= kept
    assert language_id.accepted(clashing(docs), model).count() == language_id.accepted(docs, model).count()


def brute_means(table, text):
    """The mean over all runs of three and four bytes of a text's letters, one by one."""
    raw = bytes(c if 97 <= c <= 122 or c >= 0x80 else 32 for c in text.lower().encode())
    plain = re.sub(rb"([^ ]) +", rb"\1 ", re.sub(rb"^ +", b" ", raw))
    rows = []
    for n in language_id.SIZES:
        for k in range(len(plain) - n + 1):
            if 32 not in plain[k + 1 : k + n - 1]:
                h = 0
                for c in plain[k : k + n]:
                    h = (h * 257 + c) % 2**32
                rows.append(table[((h * 0x9E3779B1 + n) % 2**32) >> 16])
    return np.sum(rows, 0, dtype=float) / max(1, len(rows)) if rows else np.zeros(table.shape[1])


def test_language_means_against_plain_loops(monkeypatch):
    """Long texts give what short ones do, whatever the pieces."""
    import pyarrow as pa

    rng = random.Random(1)
    table = np.random.default_rng(0).normal(size=(language_id.BUCKETS, 3)).astype(np.float32)
    texts = ["", "a", "ab", "Ab 12 cd", "  été -- ÉTÉ", "ß", "x" * 400, prose(rng, 200), " ".join(prose(rng, 30, "fr") + " 12 " for _ in range(20)), "日本語" * 60]
    want = np.array([brute_means(table, t) for t in texts])
    for size in (1 << 18, 64, 7):
        monkeypatch.setattr(language_id, "BLOCK", size)
        assert np.allclose(language_id._means(table, pa.array(texts)), want, atol=1e-6)


def test_language_without_labels(docs, nothing):
    from pyspark.sql import functions as F

    assert language_id.predicted(nothing).count() == 0
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predicted(bare).collect()} == {"und"} and language_id.accepted(bare).count() == 0


def test_gibberish_is_rejected(docs):
    import pyarrow as pa

    model = language_id.fit(docs)
    p = model.probabilities(pa.array(["Ωβγδ ζηθ ξρσ τυφχ", "qqzx zzqk xxqj"]))
    assert (p.max(1) < model.threshold).all()


# --- op6


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, 30, "de")) for k in range(20)] + [(20, None), (None, "x y z"), (21, "a b"), (22, "seven words of their own stand here")]
    rows = []
    for k in range(20):
        words = items[k][1].split()
        match k % 4:
            case 1:
                for p in range(2, 30, 7):
                    words[p] = "edited"
            case 2:
                del words[5], words[14], words[20]
            case 3:
                words[10:10], words[22:22] = ["put"], ["in", "there"]
        rows.append((k, f"{prose(rng, 50)} {' '.join(words)} {prose(rng, 40)}"))
    rows += [(100 + k, prose(rng, 120)) for k in range(40)] + [(200, None), (201, ""), (None, items[0][1]), (202, "a b"), (203, "so: seven words OF their own stand here.")]
    rows += [(204, " ".join(items[3][1].split()[:6]) + " " + prose(rng, 80)), rows[0]]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k) for k in range(20)}
    for size in (4_000_000, 900):  # one block of items, or several
        got = decontamination.contaminated(docs, bench, block_chars=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    for r in got:
        text = dict(rows[:20])[r.doc_id][r.start : r.end]
        assert items[r.item_id][1].split()[-1] in text
    left = {r.doc_id for r in decontamination.without_contaminated(clashing(docs.withColumns({"lang": docs.text, "source": docs.text})), bench).collect()}
    assert left == {r[0] for r in rows[20:-1]}
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


def plain_score(text, item):
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_against_a_plain_table():
    """The score, and both ends: the first end of an alignment with that score, and the last beginning of those."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        text, item = rng.integers(1, 6, 14).astype(np.uint64), rng.integers(1, 7, 7).astype(np.uint64)
        best, start, end = (int(x[0]) for x in decontamination.align(text[None], item[None]))
        assert best == plain_score(text, item)
        if best:
            assert plain_score(text[start:end], item) == best and plain_score(text[start + 1 : end], item) < best and plain_score(text[: end - 1], item) < best


def test_alignment_spans(spark):
    """Put in, cut short and doubled words: the span holds the copy from its first word to its last, and nothing else."""
    item = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12".split()
    copies = [item[:6] + ["x", "y", "z"] + item[6:], item[:9], item[2:], item[:4] + item[5:], item]
    rows = [(k, " ".join(["q"] * 9 + c + ["r"] * 9)) for k, c in enumerate(copies)]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: dict(rows)[r.doc_id][r.start : r.end] for r in got} == {k: " ".join(c) for k, c in enumerate(copies)}


@pytest.mark.parametrize("edits", [0.1, 0.15, 0.2, 0.25])
def test_seeds_find_edited_copies(edits):
    """Of 200 items with so many words replaced at random, the share that seeds find, of those that a full alignment would."""
    rng = random.Random(17)
    words = [f"w{k}" for k in range(3000)]
    items = [[rng.choice(words) for _ in range(40)] for _ in range(200)]
    block = decontamination.Items(np.arange(200), [" ".join(i) for i in items])
    block.seeds(np.zeros(len(block.keys), np.int64))
    copies = [[rng.choice(words) if rng.random() < edits else w for w in i] for i in items]
    texts = [" ".join([rng.choice(words) for _ in range(60)] + c + [rng.choice(words) for _ in range(60)]) for c in copies]
    cut = split(pa.array(texts))
    found = decontamination._search(block, cut.first, cut.hashes(), cut.row(), decontamination.THRESHOLD)
    have = {(int(t), int(i)) for t, i in zip(found[0], found[1], strict=True)}
    wanted = {k for k in range(200) if plain_score(copies[k], items[k]) >= decontamination.THRESHOLD * 80}
    share = sum((k, k) in have for k in wanted) / len(wanted)
    print(f"edits {edits}: {share:.3f} of {len(wanted)}")
    assert share >= 0.9


# --- op7

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="01234579ab@@..+-- ()é", max_size=50))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_pii_on_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "4111111111111111 " * 2000):
        pii.base_spans(text)


def test_pii_query_shape(spark, nothing):
    rng = random.Random(5)

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    texts = []
    for k in range(200):
        what = (f"{rng.choice(('jo', 'max'))}.{k}@mail{k % 9}.example.com", f"{k}.{k + 1}.13.9", card(), f"+1 ({200 + k}) 555-{1000 + k}")[k % 4]
        texts.append((k, f"{prose(rng, 12)} {what} {prose(rng, 9)}"))
    texts += [(500, "card 4111.1111.1111.1111 then"), (501, None), (502, prose(rng, 50)), (None, "x@y.zz")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(docs, pii.fit(docs)).collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        base = brute_spans(t or "")
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(b[0] == kind for b in base) for kind in range(4)]
        assert set(pii.listed(base).split(",")) <= set(got[k].spans.split(","))
    assert got[502].spans == "" == got[501].spans
    assert all(r.n_added == len([x for x in r.spans.split(",") if x]) - r.n_email - r.n_ip - r.n_card - r.n_phone for r in got.values())
    assert pii.found(nothing, pii.fit(nothing)).count() == 0


def test_added_spans():
    """Forms that the patterns miss are found; numbers that are no cards are not, nor is anything in plain prose."""
    rng = random.Random(12)
    card = lambda: next(b + c for b in ["4" + "".join(rng.choice("0123456789") for _ in range(14))] for c in "0123456789" if pii.luhn(b + c))
    texts = [f"{prose(rng, 8)} {(f'jo.{k}@mail{k % 9}.example.com', f'{k % 250}.{k % 99}.13.9', card(), f'+1 ({200 + k % 700}) 555-{1000 + k}')[k % 4]} {prose(rng, 6)} {rng.randrange(10**6)}" for k in range(800)]
    model = pii.train(texts)
    found = lambda t: [(pii.KINDS[k], t[s:e]) for k, s, e in pii.added_spans(t, pii.base_spans(t), model)]
    hits = 0
    for _ in range(20):
        c = card()
        hits += found(f"{prose(rng, 8)} {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} {prose(rng, 5)}") == [("card", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")]
        assert found(f"{prose(rng, 8)} {rng.randrange(10**6)} {prose(rng, 5)}") == []
    assert hits >= 15, hits


def test_every_rewritten_form_is_searched():
    """Whatever training rewrites a span into lies in a window of the search, and is a segment of its lattice."""
    rng = random.Random(9)
    spans = [(0, "first.last@mail.example.com"), (0, "a.b.c@x.y.z.example.org"), (0, "jo7@host.net"), (1, "192.168.10.1"), (1, "8.8.8.8"), (2, "4111 1111 1111 1111"), (2, "4111111111111111110"), (3, "+1 (212) 555-1000"), (3, "+49 30 1234567")]
    forms = {(kind, pii.rewritten(rng, kind, span)) for kind, span in spans for _ in range(300)}
    forms |= {(0, "first.last [at] mail[dot]example[dot]com"), (0, "jo at host dot com"), (1, "192[.]168[.]10[.]1"), (1, "10(.)0(.)0(.)7")}
    for kind, form in forms:
        text = f"{prose(rng, 30)} {form} {prose(rng, 30)}"
        s = text.index(form)
        held = [w for w in pii.windows(text) if w[0] <= s and s + len(form) <= w[1]]
        assert len(held) == 1, (kind, form)
        lat = pii.lattice(text, *held[0])
        # A bracket before the first digit belongs to the span.
        assert (s, s + len(form)) in {(lat.start[i], lat.end[j - 1]) for i, j in lat.segments}, (kind, form)
    assert pii.windows("we met at noon and at example.com, dot the i") == []
    for text in ("a@" * 50_000, "@" + "a" * 200_000, "@a." * 50_000, " at a" * 50_000, "x at " + "a." * 100_000, "x at a dot " * 30_000, "1[.]" * 50_000):
        pii.windows(text)


def test_marginals_sum_over_segmentations():
    """The forward-backward pass against an enumeration of all segmentations."""
    text = "on 12 34 5678 x"
    lat = pii.lattice(text, 0, len(text))
    score = np.random.default_rng(0).normal(size=(len(lat.segments), 4))

    def every(i):
        if i == lat.n:
            yield 0.0, ()
            return
        yield from every(i + 1)
        for k, (a, b) in enumerate(lat.segments):
            if a == i:
                for kind in range(4):
                    for total, chosen in every(b):
                        yield total + score[k, kind], ((k, kind), *chosen)

    paths = list(every(0))
    whole = sum(np.exp(t) for t, _ in paths)
    want = np.zeros_like(score)
    for t, chosen in paths:
        for k, kind in chosen:
            want[k, kind] += np.exp(t) / whole
    assert np.allclose(pii.marginals(lat, score), want)
    top = max(paths, key=lambda p: p[0])
    i, j = zip(*lat.segments, strict=True)
    best = pii.Best(lat.n)
    best.feed(list(i), list(j), score)
    assert [(a, b, kind) for a, b, kind, _ in best.spans()] == [(*lat.segments[k], kind) for k, kind in top[1]]


def test_bands_give_what_a_whole_window_does(monkeypatch):
    """Windows longer than a band are scored piece by piece, with the same result; a megabyte of numbers takes seconds."""
    rng = random.Random(3)
    texts = [f"{prose(rng, 8)} {(f'jo.{k}@mail{k % 9}.example.com', f'{k % 250}.{k % 99}.13.9', f'+1 ({200 + k % 700}) 555-{1000 + k}')[k % 3]} {prose(rng, 6)}" for k in range(300)]
    model = pii.train(texts)
    numbers = " ".join(str(rng.randrange(10 ** rng.randint(1, 6))) for _ in range(900)) + " jo [at] mail [dot] example.com 212.555.1000 " + "host 10[.]0[.]0[.]7 is up " * 40
    assert len(pii.windows(numbers)) == 1
    whole = pii.added_spans(numbers, pii.base_spans(numbers), model)
    monkeypatch.setattr(pii, "BAND", 64)
    assert pii.added_spans(numbers, pii.base_spans(numbers), model) == whole and len(whole) > 10
    monkeypatch.undo()
    long = " ".join(str(rng.randrange(1000)) for _ in range(260_000))
    began = time.time()
    pii.added_spans(long, pii.base_spans(long), model)
    assert len(long) > 10**6 and time.time() - began < 30


# --- op9


def test_quality_held_out(spark, nothing):
    rng, rows, labels = random.Random(6), [], []
    for k in range(1200):
        good = k % 5 != 0
        text = ". ".join(prose(rng, rng.randint(6, 14)).capitalize() for _ in range(8)) + "."
        if not good:
            text = " ".join(f"{w}###" for w in text.split()) if k % 2 else " ".join(w for w in text.split()[:6] for _ in range(30))
        rows.append((k, text))
        labels.append((k, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marks)
    assert 0.6 < model.prior < 0.95
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    wrong = [k for k, good in labels if held(k) and got[k].predicted != good]
    assert len(wrong) < 12, len(wrong)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string")
    scored = quality.scored(odd, model).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
    assert quality.scored(nothing, quality.fit(nothing, marks)).count() == 0


# --- op10


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[500:1500] = x[500]  # a third of all rows are one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(3000, None), (3050, [0.0] * 24), (3100, [float("nan")] * 24), (3150, [None] + [1.0] * 23), (3200, [1.0, 2.0]), (None, [1.0] * 24), rows[50]]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)


def test_neighbours(spark, vectors):
    x, frame = vectors
    got: dict[int, list] = {}
    for r in sorted(ann.neighbours(frame).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 3000, 50))
    unit, hits = x.astype(float), 0
    norm = np.linalg.norm(unit, axis=1)
    for q, rows in got.items():
        score = unit @ unit[q] / (norm * norm[q])
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in rows}
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in rows)
        score[q] = -9
        best = np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:5]
        hits += len(set(best) & {r.vec_id for r in rows})
        if 500 <= q < 1500:
            assert [r.vec_id for r in rows] == [k for k in range(500, 507) if k != q][:5]
    assert hits / (5 * len(got)) >= 0.9


def test_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.neighbours(few).collect()}
    assert got == {(0, 1): 1, (0, 2): 50, (50, 1): 1, (50, 2): 0}
    assert ann.neighbours(few.limit(0)).count() == 0 and ann.neighbours(few.where("vec_id = 0")).count() == 0
