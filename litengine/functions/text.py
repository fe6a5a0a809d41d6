"""String functions as column expressions: normal forms, tokens, snippets, identifiers, hashes and overlaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that count as a hyphen, and prefixes, markers and units of the library's records.
DASHES = "‐‑‒–—−"
METADATA_PREFIXES = ("- backend:", "backend:")
METADATA_MARKERS = ("backend:", "page_count:", "pages_with_text:", "headings_detected:", "sections_detected:")
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def normalize_for_search(x: Column) -> Column:
    """STR1, STR3: lower case, every run of characters that are no letters or numbers one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(x, DASHES, "-" * len(DASHES))), r"[^\p{L}\p{N}]+", " "))


def compact_identifier(x: Column) -> Column:
    """STR2: the normal form without spaces."""
    return F.replace(normalize_for_search(x), F.lit(" "), F.lit(""))


def normalize_text(x: Column, preserve_paragraphs: bool = True) -> Column:
    """STR4: no NULs, line ends as LF, blanks inside a line as one, at most one blank line; or all white space as one space."""
    x = F.regexp_replace(F.regexp_replace(x, "\x00", ""), "\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    if not preserve_paragraphs:
        return F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def build_index_text(*parts: Column) -> Column:
    """STR5: distinct parts (letter case ignored, the first one stays) on lines of their own; null and blank parts are left out."""
    every = F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != ""))
    first = F.filter(every, lambda p, i: ~F.exists(F.slice(every, 1, i), lambda q: F.lower(q) == F.lower(p)))
    return F.array_join(first, "\n")


def infer_language(x: Column) -> Column:
    """STR6: zh, en, mixed or und, by which of CJK (from U+3400 on) and Latin letters occur; null for a null or blank text."""
    cjk, latin = x.rlike(r"[\x{3400}-\x{9fff}]"), x.rlike("[A-Za-z]")
    return F.when(x.rlike(r"[^\s\x00]"), F.when(cjk & latin, "mixed").when(cjk, "zh").when(latin, "en").otherwise("und"))


def html_to_text(x: Column) -> Column:
    """STR7 by regular expressions: block tags end lines, list items begin with a dash, five entities are read."""
    x = F.regexp_replace(x, r"(?i)<li[^>]*>", "\n- ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|h[1-6]|ul|ol|table|tr|blockquote|section|article)[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return normalize_text(x)


def parse_heading_path(x: Column) -> Column:
    """STR8: parts of a heading path: a JSON list, or parts between ` > `, ` / `, `::` or lines, whichever comes first in this order."""
    parts = F.when(x.contains(" > "), F.split(x, " > ")).when(x.contains(" / "), F.split(x, " / ")).when(x.contains("::"), F.split(x, "::")).otherwise(F.split(x, "\n"))
    parts = F.coalesce(F.from_json(F.when(x.startswith("["), x), "array<string>"), parts)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def normalize_string_list(x: Column) -> Column:
    """STR9: a JSON list, or items between commas, semicolons and lines; trimmed, distinct whatever their case, order kept."""
    items = F.coalesce(F.from_json(F.when(x.startswith("["), x), "array<string>"), F.split(x, "[,;\n]"))
    items = F.filter(F.transform(items, lambda p: F.trim(p)), lambda p: p != "")
    return F.filter(items, lambda p, i: ~F.exists(F.slice(items, 1, i), lambda q: F.lower(q) == F.lower(p)))


def sha256_text(x: Column) -> Column:
    """STR10."""
    return F.sha2(x, 256)


def canonical_locator(*parts: Column) -> Column:
    """STR11: percent-encoded parts between colons; `/ . : _ -` stay as they are."""
    keep = lambda p: F.replace(F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":"))
    return F.concat_ws(":", *[keep(p.cast("string")) for p in parts])


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """STR12, STR13: the name-based UUID (version 5), from the bits of a SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def related_uuid(kind: str, locator: Column) -> Column:
    """STR13: the UUID of a group of fragments."""
    return uuid5(F.concat(F.lit(kind + ":"), locator))


def display_id(prefix: str, document: Column, page: Column, record: Column) -> Column:
    """STR14: prefix, document and page, or the record where there is no document."""
    tail = F.when(page.isNotNull(), F.concat(F.lit("-P"), page.cast("string"))).otherwise("")
    return F.when(document.isNotNull(), F.concat(F.lit(prefix + "-D"), document.cast("string"), tail)).otherwise(F.concat(F.lit(prefix + "-R"), record.cast("string")))


def year_or_none(x: Column) -> Column:
    """STR15: the first year of the 20th or 21st century."""
    return F.nullif(F.regexp_extract(x, r"(19|20)\d{2}", 0), F.lit("")).cast("int")


def page_of_position(x: Column) -> Column:
    """STR16: pageIndex + 1 of a position in JSON."""
    return F.get_json_object(x, "$.pageIndex").cast("int") + 1


def make_snippet(x: Column, term: Column, size: int, before: int = 0) -> Column:
    """STR17 to STR19: white space compacted, centred on the term (or so many characters before it), ellipses where cut."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    at = F.position(F.lower(term), F.lower(flat))
    lead = F.lit(before) if before else F.floor((F.lit(size) - F.length(term)) / 2).cast("int")
    start = F.when(at > 0, F.greatest(F.lit(1), at - lead)).otherwise(1)
    cut = F.substring(flat, start, F.lit(size))
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + size - 1 < F.length(flat), "…").otherwise(""))


def fold_ascii(x: Column) -> Column:
    """Q1, STR20: lower case for A to Z only, as substring search compares."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_folded(x: Column, term: Column) -> Column:
    """FIL2, STR20: substring test without regard to ASCII case; signs such as % and _ mean themselves."""
    return F.coalesce(F.contains(fold_ascii(x), fold_ascii(term)), F.lit(False))


def open_url(path: Column, page: Column) -> Column:
    """STR21: where a page of a file opens; null without a path."""
    return F.when(path.isNull() | (path == ""), None).when(page.isNull(), F.concat(F.lit("file:"), path)).otherwise(F.concat(F.lit("file:"), path, F.lit("#page="), page.cast("string")))


#: Parts of a long CJK run that are tokens too: their lengths, the run's length from which, and how many at most.
CJK_PARTS, CJK_LONG, CJK_MOST = (4, 3, 2), 5, 40


def query_tokens(x: Column, rerank: bool = False) -> Column:
    """STR22: runs of two or more ASCII letters, digits, _ and -, and of CJK characters, each followed by the parts of a long CJK run.

    STR23 (rerank): of the text in lower case, and the whole of it where it has none.
    """
    x = F.lower(x) if rerank else x
    runs = F.filter(F.regexp_extract_all(x, F.lit(r"([A-Za-z0-9_\-]+|[\x{4e00}-\x{9fff}]{2,})"), 1), lambda t: F.length(t) >= 2)

    def parts(t: Column) -> Column:
        of = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))
        cut = [of(n) for n in CJK_PARTS]
        every = F.slice(F.array_distinct(F.flatten(F.array_compact(F.array(*cut)))), 1, CJK_MOST)
        return F.when(t.rlike(rf"^[\x{{4e00}}-\x{{9fff}}]{{{CJK_LONG},}}$"), F.concat(F.array(t), every)).otherwise(F.array(t))

    found = F.array_distinct(F.flatten(F.transform(runs, parts)))
    return F.when((F.size(found) == 0) & (F.trim(x) != ""), F.array(F.trim(x))).otherwise(found) if rerank else found


def hash_tokens(x: Column) -> Column:
    """STR24: lower-case words, single CJK characters, and their pairs."""
    word = F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9_]+)"), 1)
    one = F.regexp_extract_all(x, F.lit(r"([\x{4e00}-\x{9fff}])"), 1)
    two = F.when(F.size(one) > 1, F.zip_with(F.slice(one, F.lit(1), F.size(one) - 1), F.slice(one, F.lit(2), F.size(one) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    # A text whose bytes are its characters has no CJK ones to look for.
    return F.when(F.octet_length(x) == F.length(x), word).otherwise(F.concat(word, one, two))


def token_set(x: Column) -> Column:
    """STR25: distinct lower-case tokens of two or more letters and digits, CJK runs of two or more, and the pairs in runs of four or more."""
    low = F.lower(x)
    long = F.regexp_extract_all(low, F.lit(r"([\x{4e00}-\x{9fff}]{4,})"), 1)
    pairs = F.flatten(F.transform(long, lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"([a-z0-9]{2,}|[\x{4e00}-\x{9fff}]{2,})"), 1), pairs))


def char_ngrams(x: Column, n: int = 3) -> Column:
    """Distinct runs of n characters of the text without white space."""
    flat = F.regexp_replace(F.lower(x), r"\s+", "")
    return F.array_distinct(F.when(F.length(flat) >= n, F.transform(F.sequence(F.lit(1), F.length(flat) - n + 1), lambda i: F.substring(flat, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def overlap(a: Column, b: Column) -> Column:
    """STR27: shared items over the smaller set; 0 where either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def char_ngram_overlap(a: Column, b: Column, n: int = 3) -> Column:
    """STR26."""
    return overlap(char_ngrams(a, n), char_ngrams(b, n))


def normalize_match_text(x: Column) -> Column:
    """STR28: no soft hyphens, curly quotes and dashes as plain ones, white space as one space, lower case."""
    x = F.translate(x, "‘’“”" + DASHES + "­", "''\"\"" + "-" * len(DASHES))
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def normalize_quote(x: Column) -> Column:
    """STR29: words broken over lines are joined, `[12, 3]` citations go, white space is one space, lower case."""
    x = F.regexp_replace(x, r"-\s*\n\s*", "")
    x = F.regexp_replace(x, r"\[\d+(\s*,\s*\d+)*\]", "")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def normalize_fingerprint(x: Column) -> Column:
    """STR30: ASCII letters, digits and CJK characters of the lower-case text, anything else between them as one space."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def selected_text_hash(x: Column) -> Column:
    """STR31."""
    return F.concat(F.lit("sha256:"), F.sha2(F.trim(F.regexp_replace(x, r"\s+", " ")), 256))


def intersection_fraction(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """STR32: the shared area of two rectangles (x0, y0, x1, y1) over the first one's; 0 where that has none."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def numbered_path(parts: Column) -> Column:
    """STR33: of a heading path, the parts whose section number begins the last part's, and the last part."""
    number = lambda p: F.regexp_extract(p, r"^(\d+(\.\d+)*)", 1)
    last = F.element_at(parts, -1)
    inside = lambda p: (number(p) != "") & F.startswith(F.concat(number(last), F.lit(".")), F.concat(number(p), F.lit(".")))
    return F.when((F.size(parts) == 0) | (number(last) == ""), parts).otherwise(F.filter(parts, lambda p, i: inside(p) | (i == F.size(parts) - 1)))


def is_front_matter(x: Column) -> Column:
    """STR34: does a section heading name a part before the body?"""
    return F.lower(F.trim(x)).rlike(r"^(abstract|contents|preface|foreword|acknowledg(e)?ments|copyright)\b")


def is_metadata(x: Column) -> Column:
    """STR35: a text that begins with one of the prefixes, or holds three of the marks."""
    low = F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))

    def told(low: Column) -> Column:
        marks = sum((F.contains(low, F.lit(m)).cast("int") for m in METADATA_MARKERS), F.lit(0))
        return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in METADATA_PREFIXES]) | (marks >= 3)

    # A filter works an expression out wherever it stands: as an element it is worked out once, not for each prefix and mark.
    return F.exists(F.array(low), told)


def locator_contract(x: Column, page: Column, path: Column, metadata: Column | None = None) -> Column:
    """STR36: can a passage be found on a page? metadata_non_locatable, no_page, no_text, pdf_missing or page_level_only, the first that holds.

    A page of 0 and an empty path are none; whether a text is metadata may be told beforehand.
    """
    told = is_metadata(F.coalesce(x, F.lit(""))) if metadata is None else F.coalesce(metadata, F.lit(False))
    return (
        F.when(told, "metadata_non_locatable").when(F.coalesce(page, F.lit(0)) == 0, "no_page").when(F.coalesce(x, F.lit("")).rlike(r"(?U)^\s*$"), "no_text")
        .when(F.coalesce(path, F.lit("")) == "", "pdf_missing").otherwise("page_level_only")
    )


def chunk_tokens(x: Column) -> Column:
    """STR37: tokens of two or more characters, without citations and numbers of one to three digits."""
    bare = F.regexp_replace(F.lower(x), r"\[\d+(,\s*\d+)*\]", " ")
    return F.filter(F.regexp_extract_all(bare, F.lit(r"([\p{L}\p{N}]+)"), 1), lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d{1,3}$"))


def hygiene(x: Column) -> Column:
    """STR39: strong (a marker of mock data), weak (`test` or `demo` as a word), false_positive (only inside words) or none."""
    low = F.lower(x)
    strong = low.rlike(r"(?<![\p{L}\p{N}])(mock data|dummy|lorem ipsum|placeholder)(?![\p{L}\p{N}])")
    weak = low.rlike(r"(?<![\p{L}\p{N}])(test|demo|mock)(?![\p{L}\p{N}])")
    return F.when(strong, "strong").when(weak, "weak").when(low.rlike("test|demo|mock"), "false_positive").otherwise("none")


# What marks a record of a test, in its title, its kinds and its paths.
TEST_TITLES, TEST_TITLE_PREFIXES, TEST_KINDS, TEST_PATHS = ("mock", "test minimal"), ("test ",), ("mock", "fixture", "test_seed"), ("fixture", "mock", "test_minimal")


def is_test_record(title: Column, kinds: Sequence[Column] = (), paths: Sequence[Column] = ()) -> Column:
    """STR40: a title that holds a marker or begins with one, a kind that is one, or a path that holds one; nulls are empty."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    by_title = some([F.contains(plain(title), F.lit(m)) for m in TEST_TITLES]) | some([F.startswith(plain(title), F.lit(m)) for m in TEST_TITLE_PREFIXES])
    return by_title | some([plain(k).isin(*TEST_KINDS) for k in kinds]) | some([F.contains(F.replace(plain(x), F.lit("\\"), F.lit("/")), F.lit(m)) for x in paths for m in TEST_PATHS])


def normalize_annotation(x: Column) -> Column:
    """STR41."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def object_key(x: Column) -> Column:
    """STR42."""
    return F.lower(F.trim(x))


def citation(kind: str, document: Column, title: Column, page: Column) -> Column:
    """STR43: `[kind:document] title, p. page`; the page is left out where there is none."""
    return F.concat_ws(", ", F.concat_ws(" ", F.concat(F.lit(f"[{kind}:"), document.cast("string"), F.lit("]")), title), F.concat(F.lit("p. "), page.cast("string")))
