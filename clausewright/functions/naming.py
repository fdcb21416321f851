"""Identifiers and what file names tell: roles, sequences, codes, collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first hint contained in a file's stem gives its role.
ROLE_HINTS = [
    ("corrigendum", "corrigendum"), ("corr_", "corrigendum"), ("addendum", "corrigendum"), ("addenda", "corrigendum"), ("amend", "corrigendum"),
    ("nit", "nit"), ("notice_inviting", "nit"), ("invitation", "nit"),
    ("gcc", "gcc"), ("general_conditions", "gcc"),
    ("scc", "scc"), ("special_conditions", "scc"), ("particular_conditions", "scc"), ("additional_conditions", "scc"),
    ("specifications", "specs"), ("technical_specs", "specs"), ("specs", "specs"),
    ("boq", "boq"), ("bill_of_quantities", "boq"), ("schedule_of_rates", "boq"), ("schedule_of_quantities", "boq"),
    ("drawings", "drawings"), ("drawing_list", "drawings"),
    ("annex", "annex"), ("appendix", "annex"), ("schedule", "annex"),
    ("tender", "tender_v1"),
]


def stem(filename: Column) -> Column:
    """File name without folders and without its last suffix."""
    name = F.element_at(F.split(filename, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def role(filename: Column) -> Column:
    s = F.translate(F.lower(stem(filename)), "- ", "__")
    out = F.lit("other")
    for hint, name in reversed(ROLE_HINTS):
        out = F.when(s.contains(hint), name).otherwise(out)
    return out


def sequence(filename: Column) -> Column:
    """The last run of digits of the stem, else zero."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(stem(filename), F.lit(r"\d+"), F.lit(0)), F.lit(-1)).try_cast("int"), F.lit(0))


def short_id(clause_id: Column) -> Column:
    return F.when(F.instr(clause_id, "::") > 0, F.substring_index(clause_id, "::", -1)).otherwise(F.substring(clause_id, 1, 12))


def flag_id(doc_id: Column, clause_id: Column) -> Column:
    return F.concat(doc_id, F.lit("::flag::"), short_id(clause_id))


def collection(name: Column, prefix: str = "tender_", most: int = 63) -> Column:
    """A name that vector stores accept."""
    safe = F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_"), F.lit("_.-"))
    return F.substring(F.concat(F.lit(prefix), F.when(safe == "", "tender").otherwise(safe)), 1, most)


def code_id(code: Column, version: Column) -> Column:
    """``code[:version]`` with white space collapsed."""
    return F.concat_ws(":", F.regexp_replace(F.btrim(code), r"(?U)\s+", " "), F.when(version != "", version))


def chunk_id(code: Column, section: Column, index: Column) -> Column:
    return F.concat(F.translate(code, " :()", "__"), F.lit("::s::"), section, F.lit("::"), F.lpad(index.cast("string"), 4, "0"))


def breadcrumb(title: Column, section: Column) -> Column:
    parts = F.split(section, r"\.")
    return F.concat(F.array(title), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")))


_STANDARD = r"(?i)^IS_(\d+)(?:_part(\d+))?_(\d{4})_(.+)$"
_WORKS = r"(?i)^CPWD_(.+?)(?:_(\d{4}))?(?:_(Vol\d+))?(?:_(.+))?$"


def code_of_file(filename: Column) -> Column:
    """``struct<code_id, code_title, version_year, family, is_part>`` from a file name."""
    s = stem(filename)
    part = lambda p, g: F.nullif(F.regexp_extract(s, p, g), F.lit(""))
    spaced = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))
    num, sub, year, title = (part(_STANDARD, g) for g in range(1, 5))
    name, edition, vol, rest = (part(_WORKS, g) for g in range(1, 5))
    row = lambda i, t, y, f, p: F.struct(i.alias("code_id"), t.alias("code_title"), y.cast("int").alias("version_year"), F.lit(f).alias("family"), p.cast("int").alias("is_part"))
    none = F.lit(None).cast("string")
    standard = row(F.concat(F.lit("IS "), num, F.coalesce(F.concat(F.lit(" (Part "), sub, F.lit(")")), F.lit("")), F.lit(":"), year), spaced(title), year, "IS", sub)
    works = row(F.concat(F.lit("CPWD "), spaced(name), F.coalesce(F.concat(F.lit(":"), edition), F.lit("")), F.coalesce(F.concat(F.lit(" "), vol), F.lit(""))), F.btrim(F.concat_ws(" ", F.nullif(spaced(name), F.lit("")), F.nullif(spaced(rest), F.lit("")))), edition, "CPWD", none)
    return F.when(s.rlike(_STANDARD), standard).when(s.rlike(_WORKS), works).otherwise(row(s, spaced(s), none, "OTHER", none))
