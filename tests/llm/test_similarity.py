"""op2, op3 and op8 against plain Python over all pairs."""

import bisect
import random
import re
from collections import Counter

import pyarrow as pa

from litengine.llm import graph, line_dedup, ngram_join, substring_dedup
from litengine.llm.words import fold, split

from .conftest import clashing, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def least_reachable(ids, linked):
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def brute_components(rows):
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    linked = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return least_reachable({i for i, _ in rows}, linked)


def test_similar_sets(spark, docs, corpus):
    got = [tuple(r) for r in ngram_join.similar_sets(docs).collect()]
    want = brute_components([r[:2] for r in corpus])
    assert Counter(got) == Counter((r[0], len(shingles(r[1])), want.get(r[0])) for r in corpus)


def test_similar_sets_in_large_groups(spark):
    """Many near copies of one text, some of them too far from it but near one another, and a passage that many share."""
    rng = random.Random(11)
    base = prose(rng, 120).split()
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    far = list(base)
    for i in range(5, 120, 12):
        far[i] = f"far{i}"
    for k in range(150, 200):
        words = list(far)
        words[rng.randrange(len(words))] = f"y{k}"
        rows.append((k, " ".join(words)))
    passage = prose(rng, 30)
    rows += [(k, f"{prose(rng, 40)} {passage} {prose(rng, 20)}") for k in range(200, 260)]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == brute_components(rows)
    assert len(set(got.values())) < len(rows) - 100


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3), (60, 50), (60, 50)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == least_reachable(ids, [e for e in edges if None not in e])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, min_words=1, min_edit=5):
    """Lines that go, each with the place of the line that stays for it: in rank order, one is kept unless a kept one is equal or near."""
    lines = sorted({(i, k, line.strip(" ").lower()) for i, t in rows if i is not None and t is not None for k, line in enumerate(t.split("\n"))})
    first = {}
    for i, k, line in lines:
        first.setdefault(line, (i, k))

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:p] + a[p + 1 :] == b for p in range(len(a)))

    gone, kept, edits = {}, [], {}
    for line, at in sorted(first.items(), key=lambda x: x[1]):
        words = line.split(" ")
        if len(words) >= min_edit:
            to = min((other for other, b in kept if other < at and near(words, b)), default=None)
            if to:
                edits[line] = to
            else:
                kept.append((at, words))
    for i, k, line in lines:
        if line and len(line.split(" ")) >= min_words and (first[line] != (i, k) or line in edits):
            gone[i, k] = edits.get(line, first[line])
    return gone


def test_repeated_lines(spark, docs, corpus):
    rng = random.Random(2)
    line = prose(rng, 14).split(" ")
    more = []
    for k in range(60):
        words = list(line)
        at = rng.randrange(len(words))
        match k % 4:
            case 0:
                words[at] = rng.choice(("p", "q", words[at - 1]))
            case 1:
                del words[at]
            case 2:
                words.insert(at, rng.choice(("p", words[at])))
            case 3:
                words[at], words[(at + 5) % len(words)] = "p", "q"
        more.append((400 + k, "x y\n  " + " ".join(words).upper() + " \nthe end of it all here\n\n a  b  c d e f g h"))
    frame = spark.createDataFrame(more, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    rows = more + [r[:2] for r in corpus]
    got = {(r.doc_id, r.line_no): r for r in line_dedup.repeated_lines(frame).collect()}
    want = brute_lines(rows)
    assert {k: (r.first_doc_id, r.first_line_no) for k, r in got.items()} == want
    assert not set(want) & set(want.values())
    texts = Counter((r.doc_id, r.text) for r in line_dedup.without_repeated_lines(frame).collect())
    keep = lambda i, t: t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got)
    assert texts == Counter((i, keep(i, t)) for i, t in rows)


def test_a_chain_of_lines_keeps_one_within_the_bound_of_each(spark):
    """Each of these lines is one word from the last; a line goes only for one that stays. A line that is a variant of others joins in."""
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join([f"x{q}" for q in range(k)] + words[k:])) for k in range(12)]
    rows += [(50, " ".join(words[:6])), (51, " ".join(words[:3] + words[4:6] + ["a"])), (52, " ".join(words[:3] + words[4:6])), (53, " ".join(words[:3] + words[4:6] + ["b"])), (54, " ".join(words[:6]))]
    rows += [(100 + k, f"user u{k} joined the room now") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_dedup.repeated_lines(frame).collect()}
    assert got == brute_lines(rows)
    assert not set(got) & set(got.values()) and len(got) > 300


def test_short_lines_go_from_the_query_and_the_pipeline(spark, tmp_path):
    """Exact copies of lines of one to three words go too; the earliest stay."""
    import corpus_pipeline
    from litengine.llm import queries

    rows = [(0, "end\nthe end\nonly here\n\nno more of"), (1, "END\nanother\n the end \n\nno more of"), (2, "end\nend"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: rows[0][1], 1: "another\n", 2: "", 3: None}
    assert {r.doc_id: r.text for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame, str(tmp_path)).collect()} == {0: want[0], 1: want[1]}


def test_substring_dedup(spark):
    """Passages of 60 words in the middle of lines are found wherever they are repeated; other texts stay."""
    rng = random.Random(4)
    unique = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = unique(60)
    rows = [(k, f"{unique(70)} {passage} {unique(50)}\n{unique(30)}") for k in range(12)] + [(50 + k, unique(200)) for k in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    runs = substring_dedup.repeated_runs(frame).collect()
    text = dict(rows)
    assert {r.doc_id for r in runs} == set(range(1, 12))
    for r in runs:
        cut = text[r.doc_id][r.start : r.end]
        assert cut in passage and text[r.first_doc_id][r.first_start :].startswith(cut)
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(frame).collect()}
    for i, t in rows:
        spans = sorted((r.start, r.end) for r in runs if r.doc_id == i)
        at, want = 0, ""
        for s, e in spans:
            want, at = want + t[at:s], e
        assert left[i] == want + t[at:]


def brute_runs(rows, min_words=substring_dedup.MIN_WORDS, radius=substring_dedup.RADIUS):
    """Runs by plain loops: word pairs' hashes give the cuts, and blocks are compared as tuples of words."""
    blocks, seen = [], {}
    for i, text in rows:
        if i is None or text is None:
            continue
        starts = [0, *(k + 1 for k, c in enumerate(text) if c == "\n")]
        found = [(m.start(), m.end(), m.group(), bisect.bisect_right(starts, m.start())) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        hashed = fold(split(pa.array([text])).hashes(), 2).tolist()
        pair = [hashed[k] if k + 1 < len(found) and found[k + 1][3] == found[k][3] else 2**64 - 1 for k in range(len(found))]
        near = lambda k: [pair[q] for q in range(max(0, k - radius), min(len(found), k + radius + 1)) if q != k and found[q][3] == found[k][3]]
        cuts = [k for k in range(len(found)) if k == 0 or found[k][3] != found[k - 1][3] or (pair[k] < 2**64 - 1 and all(pair[k] < x for x in near(k)))]
        stops = [*cuts[1:], len(found)] if cuts else []
        own = [(k, next((e for e in stops if e - k >= min_words), None)) for k in cuts]
        own = [(k, e) for k, e in own if e is not None]
        own += [(k, len(found)) for k, e in own[-1:] if e < len(found)]
        low = [re.sub("[A-Z]", lambda m: m.group().lower(), w[2]) for w in found]
        for k, e in own:
            words = tuple(low[k:e])
            blocks.append((i, text, k, e, found[k][0], found[e - 1][1], words))
            seen[words] = min(seen.get(words, (i, found[k][0])), (i, found[k][0]))
    covered: dict = {}
    for i, text, k, e, start, end, words in blocks:
        if seen[words] < (i, start):
            covered.setdefault((i, text), set()).add((k, e, start, end))
    out = Counter()
    for (i, _), spans in covered.items():
        runs: list[list[int]] = []
        for k, e, start, end in sorted(spans):
            if runs and k <= runs[-1][1]:
                runs[-1][1:] = [max(runs[-1][1], e), runs[-1][2], max(runs[-1][3], end)]
            else:
                runs.append([k, e, start, end])
        out.update((i, start, end, e - k) for k, e, start, end in runs)
    return out


def test_repeated_runs_are_exact_and_stable(spark, docs, corpus):
    """Against plain loops; the same however rows are dealt to tasks and batches; nothing is stitched from several texts."""
    rng = random.Random(14)
    lines = [prose(rng, 9) for _ in range(40)]
    more = [(1000 + k, "\n".join(rng.choice(lines) for _ in range(rng.randint(2, 9)))) for k in range(80)]
    words = [f"word{k}" for k in range(34)]
    more += [(2000 + k, w) for k, w in enumerate(words)] + [(2100, "\n".join(words))]  # each line stands elsewhere, never next to another
    more += [(2200, " ".join(words)), (2201, " ".join(words)), (2201, prose(rng, 30) + " " + " ".join(words)), (2300, None), (None, " ".join(words)), (2301, "")]
    rows = more + [r[:2] for r in corpus]
    frame = spark.createDataFrame(more, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    found = lambda f: Counter((r.doc_id, r.start, r.end, r.n_words) for r in substring_dedup.repeated_runs(f).collect())
    want = brute_runs(rows)
    assert found(frame) == want and len(want) > 30
    assert found(frame.repartition(13)) == want == found(frame.coalesce(1))
    assert not any(i == 2100 for i, *_ in want)
    assert any(i == 2201 for i, *_ in want)


def test_odd_tables(spark, docs, nothing):
    for f in (ngram_join.similar_sets, line_dedup.repeated_lines, line_dedup.without_repeated_lines, substring_dedup.repeated_runs, substring_dedup.without_repeats):
        assert f(nothing).count() == 0
        assert f(docs).count() == f(clashing(docs)).count()
