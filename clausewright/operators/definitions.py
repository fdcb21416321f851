"""Defined terms: extraction, cleaning, first-wins dedupe and fallback candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.text import ascii_only, in_definitions, joined

_EDGE = " .,:;\"'`“”‘’"
#: Term and definition are groups 1 and 2; the body ends before the first stop.
PATTERNS = [
    r"(?isU)(?:^|[\s\.;])(?:[\"'`“‘]|the\s+(?:expression|term|word)\s+)?([A-Z][A-Za-z\-\s/]{1,80}?)(?:[\"'”’])?\s+(?:shall\s+mean|means|refers\s+to|is\s+defined\s+as|is\s+meant\s+to\s+(?:include|mean))\s+(.+?)(?=[.;]|$)",
    r"(?isU)\(\s*([A-Za-z][A-Za-z\-\s/]{1,80}?)\s*\)\s+(?:shall\s+mean|means)\s+(.+?)(?=[.;]|$)",
]
#: In ASCII texts nothing but these characters stands between a match's first character and its verb, so no match begins before the last other one ahead of the first verb.
_CUT = r"(?is)(?:^|[^A-Za-z\-\s/\"'`])[A-Za-z\-\s/\"'`]*\s(?:shall\s+mean|means|refers\s+to|is\s+(?:defined|meant))\s.*"


def clean_body(body: Column) -> Column:
    return F.btrim(F.btrim(F.regexp_replace(body, r"(?U)\s+", " ")), F.lit(_EDGE))


def clean_term(term: Column) -> Column:
    return F.btrim(F.regexp_replace(clean_body(term), r"(?i)^(?:the|a|an)\s+", ""))


def _usable(d: Column) -> Column:
    term, body = d["canonical_form"], d["definition_text"]
    return (term != "") & (F.length(body) >= 10) & (F.length(term) <= 80) & (F.length(term) - F.length(F.replace(term, F.lit(" "), F.lit(""))) <= 6)


def _parted(p: str):
    return lambda h: F.struct(clean_term(F.regexp_extract(h, p, 1)).alias("canonical_form"), clean_body(F.regexp_extract(h, p, 2)).alias("definition_text"))


def sought(text: Column) -> Column:
    """``array<struct<canonical_form, definition_text>>`` of a text's usable definitions, in order of pattern and place; costly, so only for texts that are :func:`announced`."""
    found = []
    for p in PATTERNS:
        # one search; a match starts and ends alike on its own, but for white space at its end, which is trimmed
        bracketed = p.startswith(r"(?isU)\(")
        matches = F.regexp_extract_all(text if bracketed else F.when(ascii_only(text), F.regexp_extract(text, _CUT, 0)).otherwise(text), F.lit(p), F.lit(0))
        matches = F.when(text.contains("("), matches) if bracketed else matches
        found.append(F.transform(matches, _parted(p)))
    return F.filter(joined(*found), _usable)


def announced(text: Column) -> Column:
    """Whether a definition's words stand in the text. Plain searches first, for letters that have no other form, so that lower case is all they need."""
    low = F.lower(text)
    return (low.contains("mean") | low.contains("refer") | low.contains("def")) & text.rlike(r"(?iU)\b(?:mean|means|refers\s+to|is\s+defined\s+as)\b")


def candidates(clauses: DataFrame) -> DataFrame:
    """Usable definitions, in order of clause (``ord``), pattern and place (``hit``)."""
    rows = clauses.filter(announced(F.col("text"))).select("clause_id", "doc_id", "tender_id", "ord", F.posexplode(sought(F.col("text"))).alias("hit", "d"))
    return rows.select("clause_id", "doc_id", "tender_id", "ord", "hit", "d.*")


def first(rows: DataFrame) -> DataFrame:
    """The first definition of a term (whatever its case) in a document."""
    key = Window.partitionBy("doc_id", F.lower("canonical_form")).orderBy("pass", "ord", "hit")
    return rows.withColumn("__n", F.row_number().over(key)).filter("__n = 1").drop("__n")


def extract(clauses: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Definitions; ``replies`` (clause_id, canonical_form, definition_text) of a
    provider fill in for clauses without a match of their own."""
    rows = candidates(clauses).select("*", F.lit(1).alias("pass"), F.lit("regex").alias("extraction_method"), F.lit(0.85).alias("confidence"))
    if replies is not None:
        place = Window.partitionBy("clause_id").orderBy("canonical_form", "definition_text")
        told = replies.join(clauses.select("clause_id", "doc_id", "tender_id", "ord"), "clause_id").withColumn("hit", F.row_number().over(place))
        rows = rows.unionByName(told.select("clause_id", "doc_id", "tender_id", "ord", "hit", "canonical_form", "definition_text", F.lit(2).alias("pass"), F.lit("llm").alias("extraction_method"), F.lit(0.7).alias("confidence")))
    return first(rows).select("canonical_form", "definition_text", F.col("clause_id").alias("defined_in_clause"), "doc_id", "tender_id", "extraction_method", "confidence")


def fallback_candidates(clauses: DataFrame, found: DataFrame, sections_only: bool = True) -> DataFrame:
    """Clauses of definitions sections in which no definition was found."""
    rows = clauses.filter(in_definitions(F.col("section_path"), F.col("text"))) if sections_only else clauses
    return rows.join(found.select(F.col("defined_in_clause").alias("clause_id")), "clause_id", "left_anti")
