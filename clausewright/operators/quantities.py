"""Quantities: value and unit patterns in order of priority, without overlaps."""

from __future__ import annotations

import re
from functools import reduce
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.text import IGNORE_CASE, UNICODE, strip

#: Patterns with value and unit groups (0: none), and their kinds.
PATTERNS = [
    (IGNORE_CASE + r"(?:Rs\.?|INR|₹)\s*([\d,]+(?:\.\d+)?)\s*(lakhs?|crores?|lakh|crore)?", 2, "money"),
    (IGNORE_CASE + r"([\d,]+(?:\.\d+)?)\s*(lakhs?|crores?|cr|lacs?)\b", 2, "money"),
    (IGNORE_CASE + r"USD\s*([\d,]+(?:\.\d+)?)\s*(million|m|billion|bn)?", 2, "money"),
    (IGNORE_CASE + r"(?:±|\+/-|\+\s*-)\s*([\d.]+)\s*(mm|cm|m|%|degC|deg\s*C|kg)?", 2, "tolerance"),
    (IGNORE_CASE + r"([\d.]+)\s*(?:%|per\s*cent\b|percent\b)", 0, "percentage"),
    (IGNORE_CASE + r"\b([\d.]+)\s*(days?|wks?|weeks?|mos?|months?|yrs?|years?|hours?|hrs?|minutes?|mins?)\b", 2, "duration"),
    (IGNORE_CASE + r"\b([\d.]+)\s*(mm|cm|m|ft|inch(?:es)?|in)\b", 2, "dimension"),
    (IGNORE_CASE + r"\b([\d]+)\s*(?:times?\s+)?(?:per|/)\s*(day|week|month|year)\b", 2, "frequency"),
    (UNICODE + r"\b([\d]+)\s*:\s*([\d]+)\b", 2, "ratio"),
]
#: Of each pattern, words one of which is in every match.
NEEDLES = [("rs", "inr", "₹"), ("lakh", "crore", "cr", "lac"), ("usd",), ("±", "+"), ("%", "cent"), ("day", "wk", "week", "mo", "yr", "year", "hour", "hr", "min"), ("m", "ft", "in"), ("per", "/"), (":",)]
#: Labels that a quantity can refer to.
REFERENTS = ["defect_liability_period", "completion_period", "mobilisation_advance_pct", "mobilisation_advance_amount", "performance_security_pct", "liquidated_damages_pct", "liquidated_damages_cap", "earnest_money_deposit_amount", "tender_fee_amount", "contract_value_estimate", "validity_of_bid", "advance_payment_pct", "retention_money_pct", "price_adjustment_threshold", "concrete_grade", "steel_grade", "cube_test_frequency", "compaction_density_pct", "slump_value_mm", "tolerance_mm", "minimum_thickness_mm", "maximum_settlement_mm", "noise_limit_db", "particulate_matter_limit", "cement_quantity_per_cum", "boq_item_quantity", "completion_milestone_pct", "warranty_period", "notice_period", "interest_rate_pct", "vat_or_gst_rate_pct", "manpower_count", "tender_processing_fee", "minimum_turnover_amount"]


def folded_unit(unit: Column) -> Column:
    return F.lower(strip(F.coalesce(unit, F.lit(""))))


def normalise(value: Column, unit: Column, kind: Column, strict: bool = False) -> Column:
    """``struct<value_norm, unit_norm>`` of a :func:`folded_unit`. A million USD counts 84 lakh here, and
    bare dollars as rupees; ``strict`` converts both by 84 rupees a dollar."""
    u = unit
    pick = lambda *cases, other: reduce(lambda acc, c: F.when(c[0], c[1]).otherwise(acc), reversed(cases), other)
    starts = lambda *p: reduce(lambda a, b: a | b, [u.startswith(x) for x in p])
    days = pick((starts("hour") | u.isin("hr", "hrs"), value / 24), (starts("min"), value / (24 * 60)), (starts("day"), value), (starts("wk", "week"), value * 7), (starts("mo"), value * 30), (starts("yr", "year"), value * 365), other=value)
    dollars = 840.0 if strict else 84.0
    lakhs = pick((u.contains("crore") | starts("cr"), value * 100), (u.contains("lakh") | starts("lac"), value), (u.contains("million") | (u == "m"), value * dollars), (u.contains("billion") | (u == "bn"), value * dollars * 1000), other=value / 100_000)
    length = pick((u == "mm", value), (u == "cm", value * 10), (u == "m", value * 1000), (u == "ft", value * 304.8), (starts("inch") | (u == "in"), value * 25.4), other=value)
    daily = pick((u == "day", value), (u == "week", value / 7), (u == "month", value / 30), (u == "year", value / 365), other=value)
    number = pick((kind == "duration", days), (kind == "money", lakhs), (kind == "dimension", length), (kind == "frequency", daily), other=value)
    named = pick((kind == "duration", F.lit("days")), (kind == "money", F.lit("inr_lakhs")), (kind == "dimension", F.lit("mm")), (kind == "percentage", F.lit("pct")), (kind == "tolerance", F.when(u == "", "tolerance").otherwise(u)), (kind == "frequency", F.lit("per_day")), other=F.when(u == "", "raw").otherwise(u))
    return F.struct(number.alias("value_norm"), named.alias("unit_norm"))


#: Characters shown on either side of a quantity; what Unicode has as white space.
REACH = 80
_WHITE = re.compile(r"[^\S\x1c-\x1f]+")
_FOUND = "array<struct<raw: string, kind: string, a: string, b: string, around: string>>"
_BARE = [p.replace(IGNORE_CASE, "").replace(UNICODE, "") for p, *_ in PATTERNS]
#: For any text, and for ASCII texts in lower case, which need no folding.
_ANY, _LOW = [re.compile(p, re.I) for p in _BARE], [re.compile(p.lower(), re.A) for p in _BARE]
#: In ASCII texts, patterns that begin with a number are tried only where one stands before the first letters of what they have behind it.
_AFTER = {"la": (1,), "cr": (1,), "%": (4,), "pe": (4, 7), "da": (5,), "wk": (5,), "we": (5,), "mo": (5,), "mi": (5,), "yr": (5,), "ye": (5,), "ho": (5,), "hr": (5,), "mm": (6,), "m": (6,), "cm": (6,), "ft": (6,), "in": (6,), "ti": (7,), "/": (7,), ":": (8,)}
_RUN = re.compile(r"([0-9.,]++)\s*+([lcpdwmyhfit][a-z]?|[%/:])", re.A)
_TRIED = {begins: [(place, _LOW[place].match) for place in places] for begins, places in _AFTER.items()}
_SOUGHT = [(place, NEEDLES[place], _LOW[place].finditer) for place in (0, 2, 3)]
_VALUE = re.compile(r"[0-9]+\.?[0-9]*|\.[0-9]+")


def is_number(value: str) -> bool:
    """Whether :func:`number` has a value for a match's first group."""
    return value.isascii() and (value.isdigit() or _VALUE.fullmatch(value.replace(",", "")) is not None)


def _in_ascii(low: str) -> list[tuple[int, re.Match[str]]]:
    """What ``finditer`` has of all patterns, by place: a number's end is the end of its whole run, as no unit begins with a character of numbers."""
    hits: list[tuple[int, re.Match[str]]] = []
    for place, words, matches in _SOUGHT:
        for w in words:
            if w in low:
                hits += [(place, m) for m in matches(low)]
                break
    reached: dict[int, int] = {}
    for run in _RUN.finditer(low):
        begin, end = run.span(1)
        for place, match in _TRIED.get(run[2], ()):
            at = reached.get(place, 0)
            at = at if at > begin else begin
            while at < end:
                m = match(low, at)
                if m:
                    hits.append((place, m))
                    reached[place] = m.end()
                    break
                at += 1
    hits.sort(key=itemgetter(0))
    return hits


def spans_in(text: str) -> list[tuple[int, int, int, re.Match[str]]]:
    """Start, end, place of the pattern and match of what stays of all patterns' matches, in order of pattern and place.
    Earlier matches reserve their span, even those that turn out not to be numbers."""
    kept: list[tuple[int, int, int, re.Match[str]]] = []
    for place, m in _in_ascii(text.lower()) if text.isascii() else [(place, m) for place, p in enumerate(_ANY) for m in p.finditer(text)]:
        start, end = m.span()
        for k in kept:
            if start < k[1] and k[0] < end:
                break
        else:
            kept.append((start, end, place, m))
    return kept


def found_in(text: str) -> list[tuple[int, int, str, str, str, str, str]]:
    """Start, end, match, kind, value, unit and surroundings of a text's spans."""
    out = []
    printable = text.isascii() and text.isprintable()
    for start, end, place, m in spans_in(text):
        _, unit, kind = PATTERNS[place]
        near = text[start - REACH if start > REACH else 0 : end + REACH]
        near = " ".join(near.split()) if printable else _WHITE.sub(" ", near).strip(" ")
        named = text[m.start(unit) : m.end(unit)] if unit and m[unit] else ""
        out.append((start, end, text[start:end], kind, text[m.start(1) : m.end(1)], named, near))
    return out


def _found(column: pa.Array) -> pa.Array:
    names = ("raw", "kind", "a", "b", "around")
    held: tuple[list[str], ...] = tuple([] for _ in names)  # columns, so that no row outlives its text
    add, ends = tuple(c.append for c in held), [0]
    for text in column.to_pylist():
        for _, _, *told in found_in(text or ""):
            for put, value in zip(add, told):
                put(value)
        ends.append(len(held[0]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in held], names))


def number(value: Column) -> Column:
    """A value as a double, null if it is none; a match without one is no quantity."""
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def identified(clause_id: Column, ord: Column) -> Column:
    """The id of a clause's quantity: the clause's, and six characters that tell its place."""
    return F.concat(clause_id, F.lit("::q"), F.lpad(ord.cast("string"), 3, "0"))


def clause_of(quantity_id: Column) -> Column:
    """The clause that an id of :func:`identified` names."""
    return F.left(quantity_id, F.length(quantity_id) - 6)


def extract(clauses: DataFrame, strict: bool = False) -> DataFrame:
    """Quantities of every clause; narrow, as all is decided within the clause: a small function finds the spans, the rest are expressions."""

    def measured(h: Column) -> Column:
        a, b = number(h["a"]), number(h["b"])
        ratio = h["kind"] == "ratio"
        value = F.when(ratio, F.when(b != 0, a / b).otherwise(a)).otherwise(a)
        return F.struct(*[h[f].alias(f) for f in ("raw", "kind", "around")], value.alias("value"), F.when(ratio, "ratio").otherwise(h["b"]).alias("unit"))

    kept = F.filter(F.transform("__found", measured), lambda q: q["value"].isNotNull())
    rows = clauses.select("clause_id", "doc_id", "tender_id", "page", "text", F.arrow_udf(_found, _FOUND)("text").alias("__found"))
    rows = rows.select("clause_id", "doc_id", "tender_id", "page", F.posexplode(kept).alias("ord", "q"))
    rows = rows.withColumn("folded", folded_unit(F.col("q.unit")))  # once, for all the cases that look at it
    norm = normalise(F.col("q.value"), F.col("folded"), F.col("q.kind"), strict)
    return rows.select(
        identified(F.col("clause_id"), F.col("ord")).alias("quantity_id"), "clause_id", "doc_id", "tender_id", strip(F.col("q.raw")).alias("raw_text"),
        F.col("q.around").alias("surrounding_text"), "q.kind", "q.value", "q.unit", norm["value_norm"].alias("value_norm"), norm["unit_norm"].alias("unit_norm"),
        F.lit("UNCLASSIFIED").alias("referent"), F.lit(0.0).alias("referent_confidence"), F.lit("none").alias("referent_method"), "page",
    )


def classify(quantities: DataFrame, replies: DataFrame) -> DataFrame:
    """Referents from a provider's ``(quantity_id, referent, confidence)``; replies to unknown ids are dropped."""
    r = replies.select("quantity_id", F.replace(F.lower(F.btrim(F.coalesce(F.nullif("referent", F.lit("")), F.lit("UNCLASSIFIED")))), F.lit(" "), F.lit("_")).alias("__r"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("__c"))
    told = F.col("__r").isNotNull()
    joined = quantities.join(r, "quantity_id", "left")
    for name, value in (("referent", F.col("__r")), ("referent_confidence", F.col("__c")), ("referent_method", F.lit("llm"))):
        joined = joined.withColumn(name, F.when(told, value).otherwise(F.col(name)))
    return joined.drop("__r", "__c")
