"""EVD1 against a plain reading of its rules, chunk by chunk."""

import random
import re

import pytest

from litengine.operators import evidence as E

END = re.compile(r"[.!?。！？](?:[\"'’”)]*)?(?=\s|$)")
SCHEMA = "document_id long, chunk_index long, chapter_id long, heading_path string, chunk_text string, overlap_before string, overlap_after string, pdf_page_start int, pdf_page_end int"


def squeeze(x):
    return " ".join((x or "").split())


def glue(a, b):
    return a + b if not a or not b or a[-1].isspace() or b[0].isspace() else f"{a} {b}"


def ends(x):
    return [m.end() for m in END.finditer(x)]


def lines_kept(text):
    out, after_header = [], False
    for line in text.splitlines():
        bare = line.strip()
        if not bare:
            out.append(line)
        elif re.match(r"^\d+(?:\.\d+)+\.\s+.+\*\s*$", bare):
            after_header = True
        elif after_header and re.match(r"^\d{1,4}$", bare):
            after_header = False
        else:
            after_header = False
            footer = re.search(r"[“\"][^”\"]+[”\"]\.\s*Online version\.", line, re.I)
            if re.match(r"^Author:\s+.+(?:license|copyright|©|\(C\))", bare, re.I):
                continue
            kept = line[: footer.start()].rstrip() if footer else line
            if kept or not footer:
                out.append(kept)
    return "\n".join(out)


def equation_of(text):
    text = squeeze(lines_kept(text or ""))
    labels = list(re.finditer(r"\(\d+\.\d+\)", text))
    if not labels or "=" not in text[: labels[-1].end()]:
        return None
    text = text[: labels[-1].end()]
    cues = [m.start("c") for m in re.finditer(r"(?:^|(?<=[.!?])\s+)(?P<c>Using\s+Equation\b|This\s+gives\b|The\s+posterior\s+predictive\b|The\s+predictive\s+distribution\b)", text, re.I)]
    start = cues[-1] if cues else max(ends(text[: text.rfind("=")]), default=0)
    found = text[start:].strip()
    return None if re.search(r"\b(?:Figure|Table)\s+\d+(?:\.\d+)?\s*[:.]", found, re.I) else found or None


def leaning(text):
    if re.match(r"^(?:where|which|and|whose|with|for which)\b", text, re.I):
        return 0
    for m in re.finditer(r"[.!?]\s+(?P<c>where|which|and|whose|with|for which)\b", text):
        before = text[: m.start("c")].rstrip()
        last = ends(before)
        sentence = before[last[-2] if len(last) > 1 else 0 :]
        if re.search(r"\bGenerated by\b[^.!?]*?\.ipynb\.$", before, re.I) or re.search(r"\b(?:Figure|Table)\s+\d+(?:\.\d+)?\s*[:.]", sentence, re.I):
            return m.start("c")
    return None


def plain(chunk, before, after):
    """before: chunks of the section, the nearest first; after: the next one or None."""
    d, k, _, _, text, lap, tail, p0, p1 = chunk
    lap, tail, previous = lap or "", tail or "", before[0] if before else None
    at = (previous[4] or "").rfind(lap) if previous and lap else -1
    prefix = lap if at < 0 else previous[4][max(ends(previous[4][:at]), default=0) : at + len(lap)].lstrip()
    t, used = squeeze(lines_kept(prefix + (text or ""))), [(p0, p1)]
    lean = leaning(t)
    if lean is not None:
        source = next(((e, b) for b in before[:8] if (e := equation_of(b[4]))), None)
        if source:
            t = glue(source[0], t[lean:])
            used.append(source[1][7:9])
        else:
            m = END.search(t, lean)
            t = glue(t[:lean].rstrip(), t[m.end() :].lstrip()) if m else t[:lean].rstrip()
    t = t.lstrip()
    if t[:1].islower() and ends(t):
        t = t[ends(t)[0] :].lstrip()
    least, more = len(t), ""
    t = glue(t, tail)
    start = len(t)
    if after and not END.search(t, least):
        more, lap2 = after[4] or "", tail.strip()
        if lap2 and lap2 in more:
            more = more[more.find(lap2) + len(lap2) :]
        t = glue(t, more)
    m = END.search(t, least)
    consumed = m.end() if m else len(t)
    out = squeeze(t[:consumed])
    out = out or squeeze(text)
    if len(out) > 2400:
        cut = ends(out[:2400])
        out = out[: cut[-1]] if cut else out[:2400].rstrip()
    if lap and previous:
        used.append(previous[7:9])
    if more:
        used.append(after[7:9])
    told = previous[4] or "" if previous else ""
    told = told[:at] if lap and at >= 0 else told
    e = ends(told)
    context = told[e[-2] : e[-1]] if len(e) > 1 else told[-400:]
    left = more[min(max(0, consumed - start), len(more)) :].lstrip()
    m = END.search(left)
    pages = [p for both in used for p in both if p is not None]
    return d, k, out, min(pages, default=None), max(pages, default=None), squeeze(context) or None, squeeze(left[: m.end()] if m else left[:400]) or None


PIECES = ["The motion is learned", "a model", ".", "!", " ", " ", "\n", "and so on", "where x is", "Which one", "Figure 2.1: A plot.", "Generated by a.ipynb.", "f(x) = y (3.2)", "This gives g = 2 (1.4).",
          "(3.3)", "1.2. Header line *", "\n12\n", "Author: A license", "“Book”. Online version. x", "Next", "? ", ".\" ", "because", "et al", "中文。", "word " * 30]


def chunks_of(seed):
    rng = random.Random(seed)
    out = []
    for d in range(25):
        texts = ["".join(rng.choice(PIECES) + rng.choice(("", " ")) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))]
        chapter = 1
        for k, t in enumerate(texts):
            chapter += rng.random() < 0.15
            lap = rng.choice((None, "", texts[k - 1][-20:], texts[k - 1][-40:-10], "odd")) if k else None
            tail = rng.choice((None, "", texts[k + 1][:25], "odd tail")) if k + 1 < len(texts) else None
            out.append((d, k, chapter, None, rng.choice((t, t, t, None)), lap, tail, rng.choice((None, k)), rng.choice((None, k + 1))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_coherent(spark, seed):
    rows = chunks_of(seed)
    want = set()
    for c in rows:
        same = {r[1]: r for r in rows if r[0] == c[0]}
        before, k = [], c[1] - 1
        while k in same and same[k][2] == c[2]:
            before.append(same[k])
            k -= 1
        after = same.get(c[1] + 1)
        want.add(plain(c, before, after if after and after[2] == c[2] else None))
    got = E.coherent(spark.createDataFrame(rows, SCHEMA)).select("document_id", "chunk_index", "evidence", "page_first", "page_last", "context_before", "context_after")
    got = {tuple(r) for r in got.collect()}
    assert sorted(map(repr, got - want))[:3] == sorted(map(repr, want - got))[:3]


def test_literal_cases(spark):
    rows = [
        (1, 0, None, "M", "First sentence. The observed", None, " values rise.", 3, 3), (1, 1, None, "M", " values rise. It", "The observed", " becomes complete. Next", 4, 4),
        (1, 2, None, None, "becomes complete. Next", "It", None, 5, 5), (1, 3, None, "Other", "lower start. Done.", None, None, None, None),
    ]
    got = {r.chunk_index: (r.evidence, r.page_first, r.page_last) for r in E.coherent(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == ("The observed values rise. It becomes complete.", 3, 4) and got[3] == ("Done.", None, None)
    assert got[0] == ("First sentence. The observed values rise.", 3, 3)
