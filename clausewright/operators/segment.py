"""Documents to sections and clauses, codes to sections, tables to rows.

Matches are exploded and placed by running sums over a document, so long
documents cost time in proportion and stay within one window partition each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import naming
from clausewright.functions.text import ascii_only, joined, let, splitlines, strip, word_count
from clausewright.sources.staging import stage

_LINES = "(?dmU)"
_LINES_ANY_CASE = "(?dimU)"
#: Section headings (the number is group 1) and their labels.
SECTIONS = [
    (r"^[ \t]*SECTION[-:\s]+(\d+|[IVXLCDM]+)\b[^\n]*", "Section"),
    (r"^[ \t]*ANNEXURE\s*[-–:]?\s*([IVXLCDM]+|\d+)\b[^\n]*", "Annexure"),
    (r"^[ \t]*APPENDIX\s*[-–:]?\s*([A-Z]|\d+|[IVXLCDM]+)\b[^\n]*", "Appendix"),
    (r"^[ \t]*CHAPTER\s+(\d+|[IVXLCDM]+)\b[^\n]*", "Chapter"),
    (r"^[ \t]*PART[-:\s]+([A-Z]|\d+)\b[^\n]*", "Part"),
    (r"^[ \t]*SCHEDULE\s*[-–:]?\s*([A-Z]|\d+|[IVXLCDM]+)\b[^\n]*", "Schedule"),
]
#: Clause numbers (group 1) at the start of a line.
CLAUSES = [
    _LINES_ANY_CASE + r"^[ \t]*Clause\s+(\d+(?:\.\d+)*[A-Z]?(?:\s*\([a-zivx]+\))?)",
    _LINES + r"^[ \t]*(\d+(?:\.\d+)+[A-Z]?(?:\s*\([a-zivx]+\))?)\s+",
    _LINES + r"^[ \t]*(\d+[A-Z]\.?)\s+[A-Z]",
    _LINES + r"^[ \t]*(\d+\.)\s+[A-Za-z]",
    _LINES + r"^[ \t]*\(([a-zA-Z]|[ivxIVX]+)\)\s+",
    _LINES + r"^[ \t]*([A-Z])\.\s+[A-Z]",
]
#: Numbered headings of a code, and lines that only carry page numbers.
CODE_HEADING = _LINES + r"^[ \t]*(\d+(?:\.\d+){0,5})(?:\s+|$)"
PAGE_LINE = r"(?iU)^(Page\s+\d+\s+of\s+\d+|Page\s+\d+|\d+\s*/\s*\d+|\d+)$"


def strip_page_lines(text: Column) -> Column:
    """Without the lines that only number pages."""
    return F.array_join(F.filter(splitlines(text), lambda line: ~strip(line).rlike(PAGE_LINE)), "\n")


#: Characters from which a page's text counts as a layer of its own.
MIN_CHARS = 30


def has_text_layer(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= MIN_CHARS


def choose_text(layer: Column, tesseract: Column, vision: Column) -> Column:
    """``struct<text, ocr_was_used>``: the text layer if long enough, else the first non-blank OCR that is."""
    ocr = F.coalesce(F.nullif(strip(tesseract), F.lit("")), F.nullif(strip(vision), F.lit("")))
    use = ~has_text_layer(layer) & has_text_layer(ocr)
    return F.struct(F.when(use, ocr).otherwise(F.coalesce(layer, F.lit(""))).alias("text"), use.alias("ocr_was_used"))


def page_starts(pages: DataFrame) -> DataFrame:
    """Adds ``start``: the offset of each page in its concatenated document."""
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int"))


def concat_pages(pages: DataFrame) -> DataFrame:
    """``(doc_id, tender_id, text, starts, ocr)``: each page ends with a newline."""
    rows = page_starts(pages)
    page = F.array_sort(F.collect_list(F.struct("page_number", "start", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ocr_was_used", F.lit(False)).alias("ocr"))))
    docs = rows.groupBy("doc_id", "tender_id").agg(page.alias("p"))
    return docs.select("doc_id", "tender_id", F.concat_ws("", F.transform("p", lambda x: F.concat(x["text"], F.lit("\n")))).alias("text"), F.col("p.start").alias("starts"), F.col("p.ocr").alias("ocr"))


def page_of(offset: Column, starts: Column) -> Column:
    """One-based page that holds an offset."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= offset)), F.lit(1))


def _shaped(k: int):
    return lambda h, i: F.struct(F.lit(k).alias("pattern"), i.alias("hit"), h["raw"].alias("raw"), h["number"].alias("number"), h["gap"].alias("gap"))


def _found(text: Column, k: int, p: str) -> Column:
    """Matches of a pattern with the lengths of the stretches before them; null without one, which most texts have of most patterns."""
    def with_gaps(raw: Column) -> Column:
        gaps = F.transform(F.split(text, p, -1), lambda s: F.length(s))
        zipped = F.arrays_zip(raw.alias("raw"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("number"), F.slice(gaps, F.lit(1), F.size(raw)).alias("gap"))
        return F.when(F.size(raw) > 0, F.transform(zipped, _shaped(k)))

    return let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), with_gaps)


def hits(rows: DataFrame, keys: list[str], patterns: list[str]) -> DataFrame:
    """``keys, pattern, hit, start, raw, number`` of every match of each pattern in ``text``."""
    text = F.col("text")
    of = lambda ps: joined(*[_found(text, k, p) for k, p in enumerate(ps)])
    # plain classes match the same in ASCII texts
    found = F.when(ascii_only(text), of([p.replace("U)", ")", 1) for p in patterns])).otherwise(of(patterns))
    exploded = rows.select(*keys, F.explode(found).alias("h")).select(*keys, "h.*")
    so_far = Window.partitionBy(*keys, "pattern").orderBy("hit")
    return exploded.withColumn("start", (F.sum(F.col("gap") + F.length("raw")).over(so_far) - F.length("raw")).cast("int")).drop("gap")


def sections(docs: DataFrame) -> DataFrame:
    """``(doc_id, section, label, start, end)``; what stands before the first
    heading is front matter, and a document without headings is one section."""
    found = hits(docs, ["doc_id"], [_LINES_ANY_CASE + p for p, _ in SECTIONS])
    names = F.array(*[F.lit(label) for _, label in SECTIONS])
    label = F.concat(names[F.col("pattern")], F.lit(" "), "number")
    order = Window.partitionBy("doc_id").orderBy("start", "pattern", "hit")
    marked = found.select("doc_id", label.alias("label"), "start", F.row_number().over(order).alias("section"))
    size = docs.select("doc_id", F.length("text").alias("size"))
    first = size.join(marked.filter("section = 1").select("doc_id", F.col("start").alias("first")), "doc_id", "left")
    opening = first.filter("first is null or first > 0").select("doc_id", F.when(F.col("first").isNull(), "(unsectioned)").otherwise("Front Matter").alias("label"), F.lit(0).alias("start"), F.lit(0).alias("section"))
    after = Window.partitionBy("doc_id").orderBy("section")
    return marked.unionByName(opening).join(size, "doc_id").select("doc_id", "section", "label", "start", F.lead("start").over(after).alias("next"), "size").select("doc_id", "section", "label", "start", F.coalesce("next", "size").alias("end"))


def _slices(bounds: DataFrame, least: int) -> DataFrame:
    body = strip(F.substring(F.col("text"), F.col("from") + 1, F.col("to") - F.col("from")))
    return bounds.withColumn("body", body).filter(F.length("body") >= least)


#: Pages of a run, on average at most twice as many.
RUN = 64
#: What a page may end with if a heading or clause number goes on behind its end: the beginnings of SECTIONS and CLAUSES up to white space.
_GOES_ON = (
    r"(?dimU)\A\s*\z|^[ \t]*(?:(?:SECTION|PART)[-:\s]*|(?:ANNEXURE|APPENDIX|SCHEDULE)\s*[-–:]?\s*|CHAPTER\s*|Clause(?:\s+\d+(?:\.\d+)*[A-Z]?)?(?:\s*\([a-zivx]+\))?\s*"
    r"|\d+(?:\.\d+)+[A-Z]?(?:\s*\([a-zivx]+\))?\s*|\d+[A-Z]\.?\s*|\d+\.\s*|\((?:[a-zA-Z]|[ivxIVX]+)\)\s*|[A-Z]\.\s*)\z"
)


def page_runs(pages: DataFrame) -> DataFrame:
    """``(doc, run, text, starts, ocr, pages_before)``: neighbouring pages that are searched together. A run ends behind the first page of a
    block of RUN page numbers that ends in the middle of nothing, so no heading or number lies across two runs; a
    document (``doc``: its id and tender) has any number of runs and is never one row."""
    text = F.coalesce("text", F.lit(""))
    marked = pages.select(F.struct("doc_id", "tender_id").alias("doc"), "page_number", text.alias("text"), F.coalesce("ocr_was_used", F.lit(False)).alias("ocr"), F.floor(F.col("page_number") / RUN).alias("block"), (~text.rlike(_GOES_ON)).alias("whole"))
    earlier = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each block
    cuts = marked.groupBy("doc", "block").agg(F.min(F.when(F.col("whole"), F.col("page_number"))).alias("cut"))
    cuts = cuts.withColumn("before", F.last(F.when(F.col("cut").isNotNull(), F.col("block")), ignorenulls=True).over(earlier))
    run = F.when(F.col("page_number") > F.col("cut"), F.col("block")).otherwise(F.coalesce("before", F.lit(-1)))
    placed = marked.join(cuts, ["doc", "block"]).select("doc", run.alias("run"), F.struct("page_number", "text", "ocr").alias("page"))
    held = placed.groupBy("doc", "run").agg(F.array_sort(F.collect_list("page")).alias("p"))
    sizes = F.transform("p", lambda x: F.length(x["text"]) + 1)
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)), lambda acc: F.slice(acc, 1, F.size(acc) - 1))
    before = Window.partitionBy("doc").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    joined = F.concat_ws("", F.transform("p", lambda x: F.concat(x["text"], F.lit("\n"))))
    return held.select("doc", "run", joined.alias("text"), starts.alias("starts"), F.col("p.ocr").alias("ocr"), F.coalesce(F.sum(F.size("p")).over(before), F.lit(0)).alias("pages_before"))


def clauses(pages: DataFrame, min_chars: int = 30) -> DataFrame:
    """Clauses of every document in order; ids count the clauses that are long enough.

    Runs of pages are searched on their own. What they carry on from those before (pages, the open section's heading, the
    open clause, clauses so far) is summed up over rows that hold a run's figures alone. A clause that
    goes over several runs is put together from its pieces.
    """
    runs = stage(page_runs(pages), "segment-runs")
    key = ["doc", "run"]
    found = hits(runs.select(*key, "text"), key, [_LINES_ANY_CASE + p for p, _ in SECTIONS])
    names = F.array(*[F.lit(label) for _, label in SECTIONS])
    inside = Window.partitionBy(*key).orderBy("start", "pattern", "hit")
    marked = found.select(*key, F.concat(names[F.col("pattern")], F.lit(" "), "number").alias("label"), "start", F.row_number().over(inside).alias("section"))
    marked = stage(marked, "segment-headings")  # read three times, as are the numbers below; without texts
    size = runs.select(*key, F.length("text").alias("size"))
    firsts = size.join(marked.filter("section = 1").select(*key, F.col("start").alias("first")), key, "left")
    opening = firsts.filter("first is null or first > 0").select(*key, F.lit(None).cast("string").alias("label"), F.lit(0).alias("start"), F.lit(0).alias("section"))
    after = Window.partitionBy(*key).orderBy("section")
    spans = marked.unionByName(opening).join(size, key).withColumn("end", F.coalesce(F.lead("start").over(after), F.col("size")))
    parts = spans.join(runs, key).select(*key, "section", "label", F.col("start").alias("base"), F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "starts", "ocr", "pages_before")
    parts = stage(parts, "segment-parts")
    part = [*key, "section"]
    numbers = hits(parts.select(*part, "text"), part, CLAUSES)
    longest = Window.partitionBy(*part, "start").orderBy(F.length("raw").desc(), "pattern")
    numbered = numbers.withColumn("__n", F.row_number().over(longest)).filter("__n = 1").select(*part, F.col("start").alias("from"), strip(F.col("number")).alias("clause_number"))
    numbered = stage(numbered, "segment-numbers")
    # what precedes the first number, or all of a part without numbers
    heads = parts.select(*part).join(numbered.groupBy(*part).agg(F.min("from").alias("first")), part, "left").filter("first is null or first > 0").select(*part, F.lit(0).alias("from"), F.lit(None).cast("string").alias("clause_number"), F.lit(True).alias("head"))
    following = Window.partitionBy(*part).orderBy("from")
    bounds = numbered.withColumn("head", F.lit(False)).unionByName(heads).withColumn("to", F.lead("from").over(following))
    # what a run hands on: its last heading, its last clause begun; a head without heading goes on with what is open
    begun = bounds.filter("not head or section > 0").groupBy(*key).agg(F.max(F.struct("run", "section", "from")).alias("last"))
    headed = marked.groupBy(*key).agg(F.max_by("label", F.struct("section")).alias("heading"))
    earlier = Window.partitionBy("doc").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc")
    first = F.struct(F.first("run").over(Window.partitionBy("doc").orderBy("run")).alias("run"), F.lit(0).alias("section"), F.lit(0).alias("from"))
    front = F.when(F.max(F.col("heading").isNotNull()).over(whole), "Front Matter").otherwise("(unsectioned)")
    carried = size.join(begun, key, "left").join(headed, key, "left")
    carried = carried.select(*key, F.coalesce(F.last("last", ignorenulls=True).over(earlier), first).alias("open"), F.coalesce(F.last("heading", ignorenulls=True).over(earlier), front).alias("open_label"))
    at = F.when(F.col("head") & (F.col("section") == 0), F.col("open")).otherwise(F.struct("run", "section", "from"))
    start = page_of(F.col("base") + F.col("from"), F.col("starts"))
    until = F.coalesce("to", F.length("text"))
    pieces = bounds.join(parts, part).join(carried, key).select(
        "doc", at.alias("at"), "run", "from", (start + F.col("pages_before")).cast("int").alias("page"), (page_of(F.col("base") + until - 1, F.col("starts")) + F.col("pages_before")).cast("int").alias("page_end"),
        F.coalesce("label", "open_label").alias("label"), "clause_number", F.coalesce(F.try_element_at("ocr", start), F.lit(False)).alias("ocr"), F.substring(F.col("text"), F.col("from") + 1, until - F.col("from")).alias("text"),
    )
    opens = ("page", "label", "clause_number", "ocr")
    joined = pieces.groupBy("doc", "at").agg(*[F.min_by(F.struct(F.col(c)), F.struct("run", "from"))[c].alias(c) for c in opens], F.max("page_end").alias("page_end"), F.array_sort(F.collect_list(F.struct("run", "from", "text"))).alias("pieces"))
    rows = joined.withColumn("body", strip(F.concat_ws("", F.col("pieces.text")))).filter(F.length("body") >= min_chars).drop("pieces")
    kept = stage(rows, "segment-clauses")
    counts = kept.groupBy("doc", F.col("at.run").alias("run")).count().withColumn("clauses_before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("doc", "at.run").orderBy("at")) - 1
    out = kept.withColumn("place", place).withColumn("run", F.col("at.run")).join(counts, ["doc", "run"])
    index = (F.col("place") + F.col("clauses_before")).cast("int")
    return out.select(
        F.concat("doc.doc_id", F.lit("::"), F.lpad(index.cast("string"), 5, "0")).alias("clause_id"), "doc.doc_id", "doc.tender_id", "page", "page_end", F.array("label").alias("section_path"), "clause_number", F.col("body").alias("text"),
        F.length("body").alias("char_count"), word_count(F.col("body")).alias("word_count"), F.lit(False).alias("table_origin"), F.col("ocr").alias("ocr_was_used"), F.lit("").alias("notes"), index.alias("ord"),
    )


def hard_split(text: Column, most: int = 4000) -> Column:
    """Paragraphs packed to at most ``most`` characters; a longer paragraph stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def pack(acc: Column, p: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(p) + 2 > most) & (acc["now"] != "")
        joined = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(strip(acc["now"])))).otherwise(acc["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("now"))

    return F.aggregate(F.split(text, r"(?U)\n\s*\n", -1), start, pack, lambda a: F.when(strip(a["now"]) == "", a["done"]).otherwise(F.concat(a["done"], F.array(strip(a["now"])))))


def code_sections(pages: DataFrame, min_chars: int = 100, max_chars: int = 4000) -> DataFrame:
    """Chunks of codes; a page's ``doc_id`` is its source file's name."""
    docs = concat_pages(pages).withColumn("meta", naming.code_of_file(F.col("doc_id")))
    found = hits(docs.select("doc_id", "text"), ["doc_id"], [CODE_HEADING])
    after = Window.partitionBy("doc_id").orderBy("start")
    bounds = found.select("doc_id", F.col("number").alias("section"), F.col("start").alias("from"), F.lead("start").over(after).alias("to"))
    whole = docs.select("doc_id").join(found.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("0").alias("section"), F.lit(0).alias("from"), F.lit(None).cast("int").alias("to"))
    rows = bounds.unionByName(whole).join(docs, "doc_id").withColumn("to", F.coalesce("to", F.length("text")))
    kept = _slices(rows, min_chars)
    pieces = F.when((F.length("body") > max_chars) & (F.col("section") != "0"), hard_split(F.col("body"), max_chars)).otherwise(F.array("body"))
    cut = kept.select("doc_id", "section", "from", "meta", "starts", F.posexplode(pieces).alias("piece", "text")).filter(F.length("text") >= min_chars)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("from", "piece")) - 1
    path = F.when(F.col("section") == "0", F.array("meta.code_title")).otherwise(naming.breadcrumb(F.col("meta.code_title"), F.col("section")))
    return cut.select(
        naming.chunk_id(F.col("meta.code_id"), F.col("section"), index).alias("chunk_id"), "meta.code_id", "meta.code_title", "meta.version_year", "section", path.alias("section_path"),
        page_of(F.col("from"), F.col("starts")).alias("page"), "text", F.length("text").alias("char_count"), F.col("doc_id").alias("source_file"), index.alias("ord"),
    )


def linearise(header: Column, row: Column) -> Column:
    """``h: v; h: v``: blank cells are skipped, unnamed columns numbered."""
    cell = lambda cells, i: F.btrim(F.coalesce(F.try_element_at(cells, i), F.lit("")))

    def said(i: Column) -> Column:
        name = F.coalesce(F.nullif(cell(header, i), F.lit("")), F.concat(F.lit("Col"), i.cast("string")))
        return F.when(cell(row, i) != "", F.concat(name, F.lit(": "), cell(row, i)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.size(header), F.size(row))), said), "; ")


def table_clauses(tables: DataFrame, first_index: DataFrame | None = None, min_chars: int = 30) -> DataFrame:
    """Body rows of ``(doc_id, tender_id, page, table_index, rows)`` as clauses, numbered after the document's clauses."""
    clean = F.filter(F.transform("rows", lambda r: F.transform(r, lambda c: F.replace(F.btrim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")))), lambda r: F.exists(r, lambda c: c != ""))
    rows = tables.withColumn("rows", clean).filter(F.size("rows") > 1)
    body = rows.select("doc_id", "tender_id", "page", "table_index", F.col("rows")[0].alias("header"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("r", "cells"))
    said = body.withColumn("text", linearise(F.col("header"), F.col("cells"))).filter(F.length("text") >= min_chars)
    begin = F.lit(0)
    if first_index is not None:
        said, begin = said.join(first_index, "doc_id", "left"), F.coalesce("first_index", F.lit(0))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "table_index", "r")) - 1 + begin
    return said.select(
        F.format_string("%s::table_%03d_%02d_r%05d", "doc_id", "page", "table_index", index.cast("int")).alias("clause_id"), "doc_id", "tender_id", "page", F.col("page").alias("page_end"),
        F.array(F.format_string("Table p%d#%d", "page", F.col("table_index") + 1)).alias("section_path"), F.lit(None).cast("string").alias("clause_number"), "text", F.length("text").alias("char_count"),
        word_count(F.col("text")).alias("word_count"), F.lit(True).alias("table_origin"), F.lit(False).alias("ocr_was_used"), F.lit("linearised table row").alias("notes"), index.cast("int").alias("ord"),
    )


def document_rollup(pages: DataFrame) -> DataFrame:
    """Pages, characters and OCR pages of each document."""
    size = F.length(F.coalesce("text", F.lit("")))
    return pages.groupBy("doc_id", "tender_id").agg(F.count("*").alias("pages"), F.sum(size).alias("total_chars"), F.array_sort(F.collect_list(F.when(F.col("ocr_was_used"), F.col("page_number")))).alias("ocr_pages"))
