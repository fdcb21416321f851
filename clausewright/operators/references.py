"""Cross-references, their resolution inside a document, and the reference graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.text import IGNORE_CASE, collapse, extracted, folded, group_of, guarded, joined, let, strip

#: Patterns with the group of the label (0: the match itself), and their kinds.
PATTERNS = [
    (r"\b(?:Sub-?\s*Clause|Clause)\s+(\d+(?:\.\d+)+[A-Za-z]?)\b", 1, "clause"),
    (r"\bSection\s+(\d+(?:\.\d+)*)\b", 1, "section"),
    (r"\bAnnex(?:ure)?\s*[-:]?\s*([IVXLCDM]+|[A-Z]|\d+)\b", 1, "annex"),
    (r"\bAppendix\s*[-:]?\s*([A-Z]|[IVXLCDM]+|\d+)\b", 1, "appendix"),
    (r"\bSchedule\s*[-:]?\s*([A-Z]|[IVXLCDM]+|\d+)\b", 1, "schedule"),
    (r"\bDrawing(?:\s+No\.?)?\s*[-:]?\s*([A-Z0-9\-\.]+)\b", 1, "drawing"),
    (r"\bIS\s*(\d+(?:\.\d+)?(?:\s*:\s*\d{4})?(?:\s*Part\s*\d+)?)", 1, "standard"),
    (r"\bIRC\s*[-:]?\s*(SP[-\s]*\d+|\d+)", 1, "standard"),
    (r"\bMoRTH(?:\s+\d+\.\d+)?", 0, "standard"),
    (r"\bCPWD\s+(\d{4}|GS|Specifications?|Works?\s+Manual)?", 1, "standard"),
    (r"\bNBC\s*(\d{4})?", 1, "standard"),
]
#: Of each pattern, the word that every match holds.
NEEDLES = ("clause", "section", "annex", "appendix", "schedule", "drawing", "is", "irc", "morth", "cpwd", "nbc")


def _label(kind: str, label: Column, raw: Column) -> Column:
    shown = collapse(F.coalesce(F.nullif(strip(label), F.lit("")), raw))
    return F.when(raw != "", raw).otherwise(shown) if kind == "standard" else F.concat(F.lit(kind.capitalize() + " "), shown)


def _shaped(pattern: str, group: int, kind: str):
    label = lambda h: group_of(h, IGNORE_CASE + pattern, group)
    return lambda h: F.struct(F.lit(kind).alias("target_kind"), _label(kind, label(h), strip(h)).alias("target_label"), strip(h).alias("raw_text"))


#: For ASCII texts in lower case; all but the first begin with their word.
_LOW = [re.compile(p.lower(), re.A) for p, *_ in PATTERNS]
_ASCII_SPACES = " \t\n\x0b\x0c\r"


def _beginning(pattern: re.Pattern[str], word: str, low: str) -> Iterator[re.Match[str]]:
    """What ``finditer`` has of a pattern that begins with this word."""
    at = low.find(word)
    while at >= 0:
        m = pattern.match(low, at)
        if m:
            yield m
        at = low.find(word, m.end() if m else at + 1)


def found_in(text: str) -> list[tuple[str, str]]:
    """Kinds and labels of an ASCII text's references, as :func:`sought` has them."""
    out: list[tuple[str, str]] = []
    low = text.lower()
    for pattern, (_, group, kind), word in zip(_LOW, PATTERNS, NEEDLES, strict=True):
        if word not in low:
            continue
        for m in pattern.finditer(low) if word == "clause" else _beginning(pattern, word, low):
            if kind == "standard":
                out.append((kind, text[m.start() : m.end()].strip(_ASCII_SPACES)))
            else:  # no label holds white space
                out.append((kind, f"{kind.capitalize()} {text[m.start(group) : m.end(group)]}"))
    return out


def sought(text: Column, low: Column) -> Column:
    """``array<struct<target_kind, target_label, raw_text>>`` of every reference of a text; ``low`` is the folded text."""
    return joined(*[guarded(low, (word,), F.transform(extracted(text, IGNORE_CASE + p), _shaped(p, group, kind))) for (p, group, kind), word in zip(PATTERNS, NEEDLES, strict=True)])


def extract(clauses: DataFrame, placed: bool = False) -> DataFrame:
    """Every reference of every clause, overlapping ones too; ``ord`` keeps their order in the clause. ``placed`` adds the clause's ``doc_id``."""
    text = F.col("text")
    rows = clauses.select("clause_id", *(["doc_id"] if placed else []), F.posexplode(let(folded(text), lambda low: sought(text, low))).alias("ord", "r"))
    return rows.select(F.col("clause_id").alias("from_clause"), "ord", "r.*", F.lit(0.9).alias("confidence"), *(["doc_id"] if placed else []))


def clause_number(label: Column) -> Column:
    """The number in a clause reference's label; labels differ where their numbers do."""
    return strip(F.replace(label, F.lit("Clause "), F.lit("")))


def resolve(references: DataFrame, clauses: DataFrame) -> DataFrame:
    """Adds ``target_id`` and ``resolved``: clause references point to the last
    clause of that number in their own document. References without ``doc_id`` get it from their clause first."""
    own = clauses.select(F.col("clause_id").alias("from_clause"), "doc_id")
    last = clauses.filter("clause_number <> ''").groupBy("doc_id", F.col("clause_number").alias("__n")).agg(F.max_by("clause_id", "ord").alias("target_id"))
    number = F.when(F.col("target_kind") == "clause", clause_number(F.col("target_label")))
    placed = (references if "doc_id" in references.columns else references.join(own, "from_clause", "left")).withColumn("__n", number)
    return placed.join(last, ["doc_id", "__n"], "left").drop("__n").withColumn("resolved", F.col("target_id").isNotNull())


def edges(resolved: DataFrame) -> DataFrame:
    """One edge for each pair of nodes; the attributes of its last reference win."""
    external = F.concat(F.lit("external::"), "target_kind", F.lit("::"), "target_label")
    rows = resolved.select(F.col("from_clause").alias("source"), F.coalesce("target_id", external).alias("target"), F.struct(F.col("target_kind").alias("kind"), F.col("target_label").alias("label")).alias("e"), "ord")
    return rows.groupBy("source", "target").agg(F.max_by("e", "ord").alias("e")).select("source", "target", "e.*")


def nodes(resolved: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clause nodes and a node for each unresolved target."""
    own = clauses.select(F.col("clause_id").alias("id"), F.lit("clause").alias("kind"), "doc_id", F.coalesce("clause_number", F.lit("")).alias("clause_number"), F.array_join("section_path", " > ").alias("section"), F.lit(False).alias("external"), F.lit(None).cast("string").alias("label"))
    out = resolved.filter("not resolved").select("target_kind", "target_label").distinct()
    none = F.lit(None).cast("string")
    return own.unionByName(out.select(F.concat(F.lit("external::"), "target_kind", F.lit("::"), "target_label").alias("id"), F.col("target_kind").alias("kind"), none.alias("doc_id"), none.alias("clause_number"), none.alias("section"), F.lit(True).alias("external"), F.col("target_label").alias("label")))
