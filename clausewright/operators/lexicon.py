"""Vagueness lexicon: markers, flags and their summary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.text import IGNORE_CASE, extracted, folded, guarded, joined, let

#: The markers of each category.
LEXICON = {
    "subjectivity": [r"\breasonable\b", r"\breasonably\b", r"\badequate\b", r"\badequately\b", r"\bsuitable\b", r"\bappropriate\b", r"\bappropriately\b", r"\bsufficient\b", r"\bsufficiently\b", r"\bsatisfactory\b", r"\bproper\b", r"\bproperly\b"],
    "effort_pledges": [r"\bbest\s+effort(?:s)?\b", r"\breasonable\s+effort(?:s)?\b", r"\ball\s+reasonable\s+steps?\b", r"\bgood\s+faith\b", r"\bdue\s+diligence\b"],
    "delegated_authority": [r"\bas\s+(?:directed|required|requested|approved)\b", r"\bsubject\s+to\s+(?:the\s+)?approval\b", r"\bin\s+(?:the\s+)?opinion\s+of\b", r"\bat\s+(?:the\s+)?discretion\s+of\b", r"\bacceptable\s+to\s+(?:the\s+)?\w+"],
    "approximation": [r"\bapproximate(?:ly)?\b", r"\bnearly\b", r"\baround\b", r"\bcirca\b", r"\b(?:approximately\s+)?\d+\s*(?:%|percent)\s+(?:or\s+(?:more|less)|\+/-|±)\b"],
    "feasibility_dodge": [r"\bwherever\s+feasible\b", r"\bif\s+feasible\b", r"\bas\s+far\s+as\s+practicable\b", r"\bto\s+the\s+extent\s+practicable\b", r"\bas\s+(?:may\s+be\s+)?required\b"],
    "underspecified_quantifier": [r"\bsome\b", r"\bany\s+(?:relevant|appropriate)\b", r"\bvarious\b", r"\bcertain\b", r"\bother\s+(?:relevant\s+)?(?:standards?|codes?|materials?)\b"],
}


def needle(pattern: str) -> tuple[str, ...]:
    """The longest word that every match of a marker's pattern holds."""
    fixed = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??|\\[a-z][+*]?|[a-z]\?", " ", pattern)
    words = re.findall("[a-z]+", fixed)
    return (max(words, key=len),) if words else ()


def markers(text: Column) -> Column:
    """``array<struct<category, marker>>`` in order of category, marker and place."""
    named = lambda c: lambda m: F.struct(F.lit(c).alias("category"), m.alias("marker"))
    return let(folded(text), lambda low: joined(*[guarded(low, needle(p), F.transform(extracted(text, IGNORE_CASE + p), named(c))) for c, patterns in LEXICON.items() for p in patterns]))


def flags(clauses: DataFrame) -> DataFrame:
    """A row for each clause, in the shape of candidate flags."""
    found = clauses.withColumn("__m", F.coalesce(markers(F.col("text")), F.array().cast("array<struct<category: string, marker: string>>")))
    categories = F.array_sort(F.array_distinct(F.transform("__m", lambda m: m["category"])))
    n = F.size("__m")
    return found.select(
        F.concat("doc_id", F.lit("::lex::"), "clause_id").alias("flag_id"), "clause_id", "doc_id", "tender_id", "page", F.col("text").alias("clause_text"), "section_path", "clause_number",
        (n > 0).alias("flagged"), F.when(n > 0, F.concat(F.lit("lexicon:"), F.array_join(categories, "|"))).otherwise("").alias("flag_reason"),
        n.alias("marker_count"), categories.alias("marker_categories"), F.transform("__m", lambda m: m["marker"]).alias("matched_markers"),
    )


def is_flagged(text: Column, min_markers: int = 1) -> Column:
    return F.size(markers(text)) >= min_markers


def summary(flagged: DataFrame, min_markers: int = 1) -> DataFrame:
    """One row: clauses, flagged clauses and their share. ``min_markers`` counts here alone; rows are flagged from one marker."""
    hit = F.count_if(F.col("marker_count") >= min_markers)
    return flagged.agg(F.count("*").alias("clauses"), hit.alias("flagged"), F.bround(hit / F.greatest(F.count("*"), F.lit(1)), 4).alias("flag_rate"))


def by_category(flagged: DataFrame) -> DataFrame:
    """Clauses in which each category has a marker."""
    # exploding the bare column would have Spark ask for its size below, and so look for all markers twice
    return flagged.select(F.explode(F.array_distinct("marker_categories")).alias("category")).groupBy("category").agg(F.count("*").alias("clauses"))
