"""Texts to nodes, chunks and blocks, and what a page's text is worth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def chunks(df: DataFrame, text: str = "text", size: int = 500, overlap: int = 50, whole: int = 700) -> DataFrame:
    """ING2, ING3: texts of at most `whole` characters are one chunk, longer ones windows of `size` that overlap.

    Adds chunk_index, start, end, chunk_text (trimmed), overlap_before and overlap_after; blank windows are dropped and
    take no index. Null and empty texts have no chunks.
    """
    step = size - overlap
    # A text is cut into pieces of a step once; a window is some of them, so that no text is walked through for each window.
    more = -(-overlap // step)
    long = df.withColumn("_n", F.length(text)).where("_n > 0").withColumn("_long", C("_n") > whole)
    cut = F.regexp_extract_all(C(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    long = long.withColumn("_pieces", F.when(C("_long"), cut).otherwise(F.array(text)))
    last = F.greatest(F.lit(0), F.ceil((C("_n") - size) / step)).cast("int")
    places = F.sequence(F.lit(0), F.when(C("_long"), last).otherwise(0))
    joined = lambda k, n: F.array_join(F.slice("_pieces", k + 1, n), "")

    def window(k: Column) -> Column:
        ahead = joined(k, F.lit(1 + 2 * more))
        shown = F.when(C("_long"), F.left(ahead, F.lit(size))).otherwise(ahead)
        before = F.when(k > 0, F.right(F.array_join(F.slice("_pieces", F.greatest(F.lit(0), k - more) + 1, F.least(F.lit(more), k)), ""), F.lit(overlap))).otherwise("")
        after = F.when(C("_long"), F.substring(ahead, size + 1, overlap)).otherwise("")
        return F.struct((k * step).alias("start"), F.trim(shown).alias("chunk_text"), before.alias("overlap_before"), after.alias("overlap_after"))

    windows = F.filter(F.transform(places, window), lambda w: w["chunk_text"] != "")
    out = long.select(*df.columns, "_n", "_long", F.posexplode(windows).alias("chunk_index", "_w"))
    end = F.least(C("_n"), C("_w.start") + F.when(C("_long"), size).otherwise(C("_n")))
    return out.select(*df.columns, "chunk_index", "_w.start", end.alias("end"), "_w.chunk_text", "_w.overlap_before", "_w.overlap_after")


def markdown_nodes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """ING1: a node for each heading of levels 1 to 3: order, level, title, path of its ancestors, page, body.

    Text before the first heading is left out. A `<!-- PDF_PAGE: n -->` line inside a node starts a continuation with
    the same title and path; pages stay until the next marker.
    """
    lines = df.where(C(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.regexp_extract("line", r"^\s*<!--\s*PDF_PAGE:\s*(\d+)\s*-->\s*$", 1)
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,3})\s+\S", 1))).withColumn("page", F.when(mark != "", mark.cast("int")))
    lines = lines.withColumn("heading", F.when(C("level") > 0, F.trim(F.regexp_replace("line", r"^#{1,3}\s+", ""))))
    lines = lines.withColumn("page_now", F.last("page", True).over(w)).withColumn("title", F.last("heading", True).over(w)).where(C("title").isNotNull())
    for k in (1, 2, 3):
        # A title of a level holds until a heading of that level or a higher one.
        lines = lines.withColumn(f"h{k}", F.last(F.when(C("level").between(1, k), F.struct(F.when(C("level") == k, C("heading")).alias("t"))), True).over(w)["t"])
    lines = lines.withColumn("node", F.sum(((C("level") > 0) | C("page").isNotNull()).cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((C("level") == 0) & C("page").isNull(), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    nodes = lines.groupBy(key, "node").agg(
        F.first("title").alias("title"), F.array_join(F.array_compact(F.array(F.first("h1"), F.first("h2"), F.first("h3"))), " / ").alias("path"), F.min("page_now").alias("page"), F.max("level").alias("level"), F.trim(body).alias("body")
    )
    return nodes.withColumn("continuation", C("level") == 0)


def blocks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """ING4: heading lines (six levels), list items, and runs of other lines up to a blank one: kind, line_start, line_end, block."""
    lines = df.where(C(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    kind = F.when(C("line").rlike(r"^#{1,6}\s+\S"), "heading").when(C("line").rlike(r"^\s*([-*+]|\d+[.)])\s+\S"), "list_item").when(F.trim("line") == "", None).otherwise("paragraph")
    w = Window.partitionBy(key).orderBy("at")
    lines = lines.withColumn("kind", kind)
    new = ~((C("kind") == "paragraph") & C("kind").eqNullSafe(F.lag("kind").over(w)))
    lines = lines.withColumn("block", F.sum(new.cast("int")).over(w)).where(C("kind").isNotNull())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(key, "block", "kind").agg((F.min("at") + 1).alias("line_start"), (F.max("at") + 1).alias("line_end"), joined.alias("text"))


def paragraphs(text: Column) -> Column:
    """ING5: trimmed parts between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), lambda p: F.trim(p)), lambda p: p != "")


def line_role(text: Column, y: Column, height: Column) -> Column:
    """ING6: page_number, header, footer, heading, formula or body, by place on the page and form."""
    return (
        F.when(F.trim(text).rlike(r"^\d{1,4}$") & ((y < 0.08 * height) | (y > 0.92 * height)), "page_number")
        .when(y < 0.06 * height, "header").when(y > 0.94 * height, "footer")
        .when(text.rlike(r"^\d+(\.\d+)*\s+\p{Lu}"), "heading").when(text.rlike(r"[=∑∫√]"), "formula").otherwise("body")
    )


# Forms of page numbers, running heads, captions and marks of formulas.
PAGE_NUMBER = r"^(\d{1,4}|[ivxlcdmIVXLCDM]{1,8})$"
RUNNING_HEAD = r"(?i)第\s*\d+\s*章|chapter\s+\d+|单源最短路径|最短路径"
CAPTION = r"(?i)^(图|表)\s*\d+([-－]\d+)?(?![\w])|^fig(ure)?\.?\s*\d+"
MATH_MARK = r"([\\\\δ∞∈≤≥=+\-*/_^()]|<math)"


def layout_role(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """ING7: unknown (blank), page_number, header, footer, figure_caption, formula or body, by a line's box on its page and its form.

    A page without a size counts as large as the box; null numbers count as 0, null texts as blank.
    """
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    x0, y0, x1, y1 = zero(x0), zero(y0), F.coalesce(x1.cast("double"), zero(x0)), F.coalesce(y1.cast("double"), zero(y0))
    side = lambda given, end: F.when(zero(given) > 0, zero(given)).otherwise(F.greatest(end, F.lit(1.0)))
    width, height = side(width, x1), side(height, y1)
    top, bottom, middle = y0 / height, y1 / height, (x0 + x1) / 2 / width
    shown = ocr_text(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(shown, r"\s+", "")
    marks = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(MATH_MARK))
    return (
        F.when(bare == "", "unknown")
        .when(bare.rlike(PAGE_NUMBER) & ((top <= 0.12) | (bottom >= 0.9)) & middle.between(0.35, 1.05), "page_number")
        .when((top <= 0.08) & shown.rlike(RUNNING_HEAD) & (F.length(bare) <= 28), "header")
        .when((bottom >= 0.94) & (y0 >= F.greatest(F.lit(250.0), height * 0.75)) & (F.length(bare) <= 40), "footer")
        .when(shown.rlike(CAPTION), "figure_caption")
        .when((marks >= 6) & (F.regexp_count(shown, F.lit(r"[\x{4e00}-\x{9fff}]")) <= 4), "formula")
        .otherwise("body")
    )


def grouped_lines(df: DataFrame, key: str, order: str, page: str, role: str, text: str, target: int = 700) -> DataFrame:
    """ING8, ING9: lines to units: a new one at a page's end, a heading, a formula, or when the target length is passed.

    The running length starts anew with each unit, so it is an ordered fold over a document's lines; a document is a
    bounded group.
    """
    seq = F.array_sort(F.collect_list(F.struct(C(order).alias("at"), C(page).alias("page"), C(role).alias("role"), F.length(text).alias("n"))))
    start = F.struct(F.lit(0).alias("unit"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("page"), F.array().cast("array<struct<at:bigint,unit:int>>").alias("out"))

    def step(s, x):
        new = (s["page"].isNotNull() & (s["page"] != x["page"])) | x["role"].isin("heading", "formula") | ((s["n"] > 0) & (s["n"] + x["n"] > target))
        unit = s["unit"] + (new & s["page"].isNotNull()).cast("int")
        return F.struct(unit.alias("unit"), F.when(new, x["n"]).otherwise(s["n"] + x["n"]).alias("n"), x["page"].cast("long").alias("page"), F.concat(s["out"], F.array(F.struct(x["at"].cast("bigint").alias("at"), unit.alias("unit")))).alias("out"))

    folded = df.groupBy(key).agg(F.aggregate(seq, start, step)["out"].alias("out")).select(key, F.explode("out").alias("u"))
    lines = df.join(folded.select(key, C("u.at").alias(order), C("u.unit").alias("unit")), [key, order])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(C(order), C(text)))), lambda x: x[text]), " ")
    return lines.groupBy(key, "unit").agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.min(order).alias("line_start"), F.max(order).alias("line_end"), F.count(F.lit(1)).alias("n"), joined_lines(joined).alias("text"))


def joined_lines(x: Column) -> Column:
    """ING10: no space after a CJK character before another one, nor before punctuation."""
    return F.regexp_replace(F.regexp_replace(x, r"(?<=[\x{4e00}-\x{9fff}]) (?=[\x{4e00}-\x{9fff}])", ""), r" (?=[,.;:!?，。；：！？])", "")


def ocr_text(x: Column) -> Column:
    """ING11: tags dropped (sub and sup keep their content), common entities and LaTeX letters read, CJK spaces removed."""
    x = F.regexp_replace(x, r"</?(sub|sup|b|i|u|math)[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), ("\\alpha", "α"), ("\\beta", "β"), ("\\times", "×"), ("\\leq", "≤"), ("\\geq", "≥")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return F.trim(joined_lines(x))


# A share's most points, its points for a full share, the least share that is a reason, and how a reason is written.
QUALITY_TERMS = {
    "empty": (55.0, 65.0, 0.4, "high_empty_page_ratio:%.3f"),
    "replacement": (25.0, 2500.0, 0.002, "unicode_replacement_ratio:%.4f"),
    "unprintable": (20.0, 2000.0, 0.002, "nonprintable_character_ratio:%.4f"),
    "single": (18.0, 80.0, 0.08, "single_character_line_ratio:%.3f"),
    "short": (12.0, 25.0, 0.25, "very_short_line_ratio:%.3f"),
    "spaced": (12.0, 3.0, 0.5, "abnormal_spacing:%.3f"),
    "repeated": (18.0, 45.0, 0.2, "repeated_header_footer_ratio:%.3f"),
    "broken": (20.0, 50.0, 0.08, "split_word_ratio:%.3f"),
}
FEW_CHARACTERS, FEW_POINTS = 120.0, 35.0


def text_quality(df: DataFrame, group: str, page: str, text: str = "text") -> DataFrame:
    """ING12: score (0 to 100, to one digit), hard_failure and reasons of each document, from its pages.

    Points go for pages without text, few characters a page, odd characters, short and repeated lines, runs of spaces, and
    words in single letters; each has its most. A null page is empty. Pages are summed up before the shuffle.
    """
    raw = F.coalesce(C(text), F.lit(""))
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(raw, r"\r\n?|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    sized = df.select(
        group, F.length(bare).alias("bare"), F.length(raw).alias("chars"), lines.alias("lines"), F.regexp_count(raw, F.lit("\ufffd")).alias("odd"),
        (F.regexp_count(raw, F.lit(r"[\p{C}\p{Z}]")) - F.regexp_count(raw, F.lit(r"[ \n\r\t]"))).alias("hidden"), F.regexp_count(raw, F.lit(" {3,}")).alias("spaces"),
        F.regexp_count(raw, F.lit(r"\b[A-Za-z]\s+(?:[A-Za-z]\s+){3,}[A-Za-z]\b")).alias("split"),
    )
    short = lambda n: F.sum(F.size(F.filter("lines", lambda x: F.length(x) <= n)))
    sums = sized.groupBy(group).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(C("bare") > 0).alias("full"), F.sum("bare").alias("bare"), (F.sum("chars") + F.count(F.lit(1)) - 1).alias("chars"), F.sum(F.size("lines")).alias("lines"),
        short(1).alias("one"), short(3).alias("three"), F.sum("odd").alias("odd"), F.sum("hidden").alias("hidden"), F.sum("spaces").alias("spaces"), F.sum("split").alias("split"),
    )
    again = repeated_line_ratio(df.select(group, page, raw.alias(text)), group, page, text)
    per = lambda c, of: C(c) / F.greatest(C(of), F.lit(1))
    shares = {
        "empty": 1 - per("full", "pages"), "replacement": per("odd", "chars"), "unprintable": per("hidden", "chars"), "single": per("one", "lines"), "short": per("three", "lines"),
        "spaced": per("spaces", "lines"), "repeated": F.when(C("pages") > 1, F.coalesce("ratio", F.lit(0.0))).otherwise(0.0), "broken": per("split", "lines"),
    }
    rows = sums.join(again, group, "left").select(group, "full", per("bare", "pages").alias("mean"), *[x.alias(name) for name, x in shares.items()])
    few = F.greatest(F.lit(0.0), FEW_CHARACTERS - C("mean")) / FEW_CHARACTERS * FEW_POINTS
    lost = reduce(lambda x, y: x + y, [F.least(F.lit(most), C(name) * points) for name, (most, points, _, _) in QUALITY_TERMS.items()], few)
    told = [F.when(C(name) >= least, F.format_string(form, C(name))) for name, (_, _, least, form) in QUALITY_TERMS.items()]
    told.insert(1, F.when(C("mean") < FEW_CHARACTERS, F.format_string("low_characters_per_page:%.1f", "mean")))
    reasons = F.array_compact(F.array(*told))
    return rows.select(
        group, F.round(F.greatest(F.lit(0.0), 100.0 - lost), 1).alias("score"), ((C("full") == 0) | (C("empty") >= 0.8)).alias("hard_failure"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).otherwise("native_text_layer_quality_acceptable").alias("reasons"),
    )


def repeated_line_ratio(df: DataFrame, group: str, page: str, text: str) -> DataFrame:
    """ING13: of a document's lines of four or more characters (digits as #), the share that stand on half its pages or more."""
    lines = df.select(group, page, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\d+", "#")))).alias("line")).where(F.length("line") >= 4)
    pages = df.groupBy(group).agg(F.count_distinct(page).alias("pages"))
    df_ = lines.groupBy(group, "line").agg(F.count(F.lit(1)).alias("n")).join(pages, group)
    often = C("n") >= F.greatest(F.lit(2), F.floor(C("pages") / 2))
    return df_.groupBy(group).agg(F.round(F.sum(F.when(often, C("n")).otherwise(0)) / F.sum("n"), 6).alias("ratio"))


def marked_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """ING14: the text between page markers, with their numbers; text before the first marker is left out."""
    number = F.regexp_extract_all(text, F.lit(r"<!--\s*PDF_PAGE:\s*(\d+)\s*-->"), 1)
    part = F.split(text, r"<!--\s*PDF_PAGE:\s*\d+\s*-->")
    both = F.arrays_zip(number.alias("page"), F.slice(part, F.lit(2), F.size(part)).alias("body"))
    return df.where(C(text).isNotNull()).select(key, F.explode(both).alias("p")).select(key, C("p.page").cast("int").alias("page"), F.trim(C("p.body")).alias("body"))


def sample_indexes(pages: Column, most: int = 12) -> Column:
    """ING15: evenly spaced page indexes, first and last among them, rounded half to even."""
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (pages - 1) / (most - 1), 0).cast("int")))
    return F.when(pages <= 0, F.array().cast("array<int>")).when(pages <= most, F.sequence(F.lit(0), pages.cast("int") - 1)).otherwise(spread)


def plan_fingerprint(*parts: Column) -> Column:
    """ING17."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


# Kinds of items in a library, and what marks a thesis.
ITEM_TYPES = {"book": "book", "bookSection": "book", "thesis": "thesis", "report": "report", "journalArticle": "paper", "conferencePaper": "paper", "preprint": "paper"}
THESIS = r"(?i)\b(thesis|dissertation)\b|学位论文|硕士|博士"


def document_class(item_type: Column, isbn: Column, book_title: Column, title: Column, pages: Column, paper_like: Column, book_outline: Column, chapters: Column) -> Column:
    """ING19: document_type, object_import_mode, confidence and requires_user_confirmation of a file; null or empty metadata is unknown.

    The type comes from the library's kind of item, signs of a book, a thesis in the title, or pages; the mode and the confidence from type, pages and outline.
    """
    given = lambda c: c.isNotNull() & (c != "")
    typed, book = given(item_type), given(isbn) | given(book_title)
    thesis = F.coalesce(title.rlike(THESIS), F.lit(False))
    paper = (pages <= 60) | paper_like
    listed = reduce(lambda w, kv: w.when(F.trim(item_type) == kv[0], kv[1]), ITEM_TYPES.items(), F.when(F.lit(False), ""))
    kind = F.when(typed, F.coalesce(listed, F.lit("other"))).when(book, "book").when(thesis, "thesis").when(paper, "paper").otherwise("other")
    sure = F.when(typed, F.when(listed.isNotNull(), "high").otherwise("medium")).when(book | thesis | paper, "medium").otherwise("low")
    long, middle = pages >= 120, pages.between(61, 119)
    chaptered = (typed & kind.isin("book", "thesis", "report")) | (middle & book_outline) | long
    confidence = F.when(middle, F.when(book_outline, "medium").otherwise("low")).when(long, F.when((sure == "high") | book_outline, "high").otherwise("medium")).otherwise(sure)
    small = paper_like & (pages <= 60)
    mode = F.when(chapters >= 5, "chaptered").when(small, "full_document").when(chaptered, "chaptered").otherwise("full_document")
    ask = F.when(pages <= 60, sure == "low").otherwise(True)
    return F.struct(kind.alias("document_type"), mode.alias("object_import_mode"), F.when(chapters >= 5, "high").otherwise(confidence).alias("confidence"), ask.alias("requires_user_confirmation"))


def fragments(df: DataFrame, kind: str, key: Sequence[str], text: str, order: Sequence[Column], scope: str, title: str) -> DataFrame:
    """ING20, SRC3 to SRC8: rows of any source as fragments: id, display id, type, title, ordinal, text, language, hash.

    The ordinal counts all rows of a scope before blank texts are dropped, so it may have gaps.
    """
    from ..functions import text as T

    locator = T.canonical_locator(F.lit(kind), *[C(k) for k in key])
    out = df.withColumn("source_order", F.row_number().over(Window.partitionBy(scope).orderBy(*order)) - 1).where(C(text).isNotNull() & (F.trim(text) != ""))
    return out.select(
        T.uuid5(locator).alias("fragment_id"), locator.alias("locator"), F.lit(kind).alias("source_type"), C(scope).cast("long").alias("document_id"), C(title).cast("string").alias("title"),
        C("source_order").cast("long").alias("source_order"), T.normalize_text(C(text)).alias("text"), T.infer_language(C(text)).alias("language"), F.sha2(T.normalize_text(C(text)), 256).alias("content_hash"),
    )


def registry(parts: Sequence[DataFrame], source_types: Sequence[str] = (), document_ids: Sequence[int] = ()) -> DataFrame:
    """SRC9: all sources in one table, restricted to types and documents where asked."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if source_types:
        out = out.where(C("source_type").isin(list(source_types)))
    return out.where(C("document_id").isin(list(document_ids))) if document_ids else out


def upsert_counts(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """SNK7: created, updated, unchanged and removed rows of a natural key."""
    b = before.select(*keys, C(value).alias("_b"), F.lit(1).alias("_in"))
    both = b.join(after.select(*keys, C(value).alias("_a"), F.lit(1).alias("_out")), list(keys), "full")
    one = lambda c, n: F.count_if(c).alias(n)
    same = C("_a").eqNullSafe(C("_b"))
    return both.agg(one(C("_in").isNull(), "created"), one(C("_in").isNotNull() & C("_out").isNotNull() & ~same, "updated"), one(C("_in").isNotNull() & C("_out").isNotNull() & same, "unchanged"), one(C("_out").isNull(), "removed"))


def replaced(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK3, SNK4, STM6: the index with all rows of the new rows' keys replaced by these."""
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
