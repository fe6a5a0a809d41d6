"""EVD1: whole sentences around a chunk, put together from the chunk, what it shares with its neighbours, and these.

Chunks of a document meet their neighbours by a window over (document, section run); everything else are expressions on a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col

# Ends of sentences, clauses that lean on what stands before, notes and captions they may follow, equations and
# what leads to them, page headers, page numbers and footers, and how much text there may be.
END = r"[.!?。！？][\"'’”)]*(?=\s|$)"
LEANING = r"(?:where|which|and|whose|with|for which)\b"
NOTE = r"(?i)\bGenerated by\b[^.!?]*?\.ipynb\.$"
CAPTION = r"(?i)\b(?:Figure|Table)\s+\d+(?:\.\d+)?\s*[:.]"
LABEL = r"\(\d+\.\d+\)"
CUE = r"(?:Using\s+Equation\b|This\s+gives\b|The\s+posterior\s+predictive\b|The\s+predictive\s+distribution\b)"
HEADER, NUMBER = r"^\d+(?:\.\d+)+\.\s+.+\*\s*$", r"^\d{1,4}$"
BOOK, AUTHOR = r"(?i)[“\"][^”\"]+[”\"]\.\s*Online version\.", r"(?i)^Author:\s+.+(?:license|copyright|©|\(C\))"
MOST, CONTEXT, NEIGHBOURS = 2400, 400, 8


def clean(x: Column) -> Column:
    """White space as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def left_trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+", "")


def right_trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def head(x: Column, n: Column) -> Column:
    return F.substring(x, F.lit(1), n)


def rest(x: Column, n: Column) -> Column:
    """x without its first n characters."""
    return F.substring(x, n + 1, F.length(x))


def first_end(x: Column) -> Column:
    """Characters up to the end of the first sentence; 0 where none ends."""
    return F.length(F.regexp_extract(x, f"(?Us)^.*?{END}", 0))


def last_end(x: Column) -> Column:
    """Characters up to the last end of a sentence; 0 where none ends."""
    return F.length(F.regexp_extract(x, f"(?Us)^.*{END}", 0))


def end_before_last(x: Column) -> Column:
    """Characters up to the end of the last sentence but one; 0 where fewer than two end."""
    return F.length(F.regexp_extract(x, f"(?Us)^(.*{END}).*{END}", 1))


def joined(a: Column, b: Column) -> Column:
    """Two texts with a space between them, unless there is one or either is empty."""
    near = (a == "") | (b == "") | a.rlike(r"(?U)\s$") | b.rlike(r"(?U)^\s")
    return F.when(near, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def last_place(x: Column, part: Column) -> Column:
    """Characters before the last occurrence of part; -1 for none."""
    at = F.instr(F.reverse(x), F.reverse(part))
    return F.when(at == 0, -1).otherwise(F.length(x) - at + 1 - F.length(part))


def limited(x: Column, most: int = MOST) -> Column:
    """At most so many characters: up to the last sentence that ends there, else cut."""
    start = F.substring(x, 1, most)
    return F.when(F.length(x) <= most, x).when(last_end(start) > 0, head(start, last_end(start))).otherwise(right_trimmed(start))


def without_boilerplate(x: Column) -> Column:
    """Without page headers, a page number that follows one, author lines and book footers; blank lines stay."""
    lines = F.split(x, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    bare = lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    header = lambda line: bare(line).rlike("(?U)" + HEADER)

    def after_header(all_lines: Column, i: Column) -> Column:
        before = F.filter(F.slice(all_lines, 1, i), lambda line: bare(line) != "")
        return (F.size(before) > 0) & header(F.element_at(before, -1))

    places = F.transform(lines, lambda line, i: F.struct(line.alias("line"), (bare(line).rlike(NUMBER) & after_header(lines, i)).alias("numbered")))
    kept = F.filter(places, lambda p: ~(header(p["line"]) | p["numbered"] | bare(p["line"]).rlike("(?U)" + AUTHOR)))
    cut = F.transform(kept, lambda p: F.when(p["line"].rlike("(?U)" + BOOK), right_trimmed(F.regexp_replace(p["line"], f"(?Us){BOOK}.*$", ""))).otherwise(p["line"]))
    whole = F.array_join(F.filter(F.zip_with(cut, kept, lambda c, p: F.when((c != "") | ~p["line"].rlike("(?U)" + BOOK), c)), lambda c: c.isNotNull()), "\n")
    return F.when(x.rlike(f"(?Umi)^\\s*\\d+(\\.\\d+)+\\.\\s|^\\s*Author:|Online version"), whole).otherwise(F.array_join(lines, "\n"))


def equation(x: Column) -> Column:
    """The last labelled equation of a text with the words that lead to it: from a cue, else from its sentence; null for none."""
    text = clean(without_boilerplate(x))
    before = F.regexp_extract(text, f"(?s)^.*{LABEL}", 0)
    cued = F.length(F.regexp_extract(before, rf"(?Usi)^(?:|.*[.!?]\s+)(?={CUE})", 0))
    has_cue = before.rlike(rf"(?Ui)(?:^|[.!?]\s+){CUE}")
    to_sign = F.regexp_extract(before, "(?s)^(.*)=", 1)
    found = F.trim(rest(before, F.when(has_cue, cued).otherwise(last_end(to_sign))))
    return F.when((before != "") & F.contains(before, F.lit("=")) & ~found.rlike("(?U)" + CAPTION) & (found != ""), found)


def leaning_at(x: Column) -> Column:
    """Characters before the first clause that leans on something missing: at the very start, or after a note or a caption; null for none."""
    starts = F.regexp_extract_all(x, F.lit(rf"(?U)(?s)(?=([.!?]\s+{LEANING}))"), 1)
    # Places of these: what stands before the k-th one has k - 1 of them.
    pieces = F.split(x, rf"(?U)(?<=[.!?])(?=\s+{LEANING})")
    ends = F.transform(F.sequence(F.lit(1), F.size(starts)), lambda k: F.array_join(F.slice(pieces, 1, k), ""))

    def wants(prefix: Column) -> Column:
        return prefix.rlike("(?U)" + NOTE) | rest(prefix, end_before_last(prefix)).rlike("(?U)" + CAPTION)

    first = F.element_at(F.filter(ends, wants), 1)
    inner = F.when((F.size(starts) > 0) & (F.size(F.filter(ends, wants)) > 0), F.length(first) + F.length(F.regexp_extract(rest(x, F.length(first)), r"(?U)^\s+", 0)))
    return F.when(x.rlike("(?Ui)^" + LEANING), 0).when(F.size(starts) > 0, inner)


def coherent(chunks: DataFrame, document: str = "document_id", order: str = "chunk_index") -> DataFrame:
    """EVD1: chunks with evidence, page_first, page_last, context_before and context_after.

    chunks: document, order, chapter_id, heading_path, chunk_text, overlap_before, overlap_after, pdf_page_start, pdf_page_end.
    Neighbours are of the same unbroken run of a chapter (of a heading, where there is none; one without a heading goes with
    the chunk before it). The text begins with the whole sentence that the overlap before is a part of, loses page headers and
    footers, a leaning clause (or gets the equation that it is about, from up to eight chunks before) and an unfinished sentence,
    and goes on through the overlap after and the next chunk to the end of a sentence. Pages are those of all chunks used. Null
    texts are empty; equal places of a document are ordered at will.
    """
    by_place = Window.partitionBy(document).orderBy(order)
    section = F.coalesce(F.concat(F.lit("c"), C("chapter_id").cast("string")), F.concat(F.lit("h"), F.last(F.when(clean(C("heading_path")) != "", clean(C("heading_path"))), True).over(by_place)), F.lit(""))
    rows = chunks.withColumn("_section", section).withColumn("_new", (~C("_section").eqNullSafe(F.lag("_section").over(by_place))).cast("int")).withColumn("_run", F.sum("_new").over(by_place))
    run = Window.partitionBy(document, "_run").orderBy(order)
    text = lambda c: F.coalesce(C(c), F.lit(""))
    here = F.struct(text("chunk_text").alias("text"), C("pdf_page_start").alias("first"), C("pdf_page_end").alias("last"))
    labelled = F.when(C("chunk_text").rlike(LABEL), F.struct(equation(C("chunk_text")).alias("text"), C("pdf_page_start").alias("first"), C("pdf_page_end").alias("last")))
    rows = rows.withColumns({"_eq": F.when(labelled["text"].isNotNull(), labelled), "_previous": F.lag(here).over(run), "_next": F.lead(here).over(run)})
    rows = rows.withColumn("_eq", F.last("_eq", True).over(run.rowsBetween(-NEIGHBOURS, -1)))

    # Each step reads columns of the one before it, so that no expression is repeated inside another.
    prefix, before = text("overlap_before"), F.coalesce(C("_previous.text"), F.lit(""))
    rows = rows.withColumn("_at", F.when(C("_previous").isNull() | (prefix == ""), -1).otherwise(last_place(before, prefix)))
    whole = left_trimmed(F.substring(before, last_end(head(before, C("_at"))) + 1, C("_at") + F.length(prefix) - last_end(head(before, C("_at")))))
    rows = rows.withColumn("_t", clean(without_boilerplate(F.concat(F.when(C("_at") < 0, prefix).otherwise(whole), text("chunk_text")))))
    rows = rows.withColumn("_lean", leaning_at(C("_t")))
    tail = rest(C("_t"), C("_lean"))
    loose = F.when(first_end(tail) == 0, right_trimmed(head(C("_t"), C("_lean")))).otherwise(joined(right_trimmed(head(C("_t"), C("_lean"))), left_trimmed(rest(tail, first_end(tail)))))
    repaired = F.when(C("_lean").isNull(), C("_t")).when(C("_eq").isNotNull(), joined(C("_eq.text"), tail)).otherwise(loose)
    rows = rows.withColumn("_t", repaired)
    unfinished = C("_t").rlike(r"^\p{Ll}") & (first_end(C("_t")) > 0)
    rows = rows.withColumn("_t", F.when(unfinished, left_trimmed(rest(C("_t"), first_end(C("_t"))))).otherwise(C("_t")))
    rows = rows.withColumn("_least", F.length("_t")).withColumn("_t", joined(C("_t"), text("overlap_after")))
    # A sentence that ends with the text so far ends it: the end may stand before what is added.
    ended = first_end(rest(C("_t"), C("_least"))) > 0
    suffix, after = F.trim(text("overlap_after")), C("_next.text")
    at = F.instr(after, suffix)
    beyond = F.when((suffix != "") & (at > 0), rest(after, at - 1 + F.length(suffix))).otherwise(after)
    rows = rows.withColumn("_more", F.when(ended | C("_next").isNull(), "").otherwise(beyond)).withColumn("_from", F.length("_t"))
    rows = rows.withColumn("_t", joined(C("_t"), C("_more"))).withColumn("_end", first_end(rest(C("_t"), C("_least"))))
    rows = rows.withColumn("_used", F.when(C("_end") > 0, C("_least") + C("_end")).otherwise(F.length("_t")))
    left_over = left_trimmed(rest(C("_more"), F.greatest(C("_used") - C("_from"), F.lit(0))))
    following = F.when(first_end(left_over) > 0, head(left_over, first_end(left_over))).otherwise(F.substring(left_over, 1, CONTEXT))
    told = F.when((prefix != "") & (C("_at") >= 0), head(before, C("_at"))).otherwise(before)
    preceding = F.when(end_before_last(told) > 0, rest(head(told, last_end(told)), end_before_last(told))).otherwise(F.reverse(F.substring(F.reverse(told), 1, CONTEXT)))
    some = lambda x: F.when(clean(x) != "", clean(x))
    ends = [(F.lit(True), C("pdf_page_start"), C("pdf_page_end")), ((prefix != "") & C("_previous").isNotNull(), C("_previous.first"), C("_previous.last")),
            (C("_more") != "", C("_next.first"), C("_next.last")), (C("_lean").isNotNull() & C("_eq").isNotNull(), C("_eq.first"), C("_eq.last"))]
    pages = F.array_compact(F.array(*[F.when(used, page) for used, *both in ends for page in both]))
    evidence = limited(clean(right_trimmed(head(C("_t"), C("_used")))))
    return rows.select(
        *chunks.columns, F.when(evidence != "", evidence).otherwise(limited(clean(C("chunk_text")))).alias("evidence"), F.array_min(pages).alias("page_first"), F.array_max(pages).alias("page_last"),
        some(preceding).alias("context_before"), some(following).alias("context_after"),
    )
