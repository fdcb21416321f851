"""Citations of codes: parsing, dedupe, registry and ranked verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import naming
from clausewright.functions.text import ascii_only, extracted, folded, group_of, let

_SECTION = r"(?:\s*(?:Section|Sec\.?|Clause|Cl\.?|§|\(Cl\.?\s*)\s*(\d+(?:\.\d+){0,5})\)?)?"
#: Number, part, year and section; title, year, volume and section.
STANDARD = r"(?iU)\bIS[\s–—-]+(\d+)(?:\s*\(?Part\s*(\d+)\)?)?(?:\s*[:–—-]\s*(\d{4}))?" + _SECTION
WORKS = r"(?U)\bCPWD[\s–—-]+((?!(?:Section|Sec|Clause|Cl|Vol)\b)[A-Z][A-Za-z]+(?:\s+(?!(?:Section|Sec|Clause|Cl|Vol)\b)[A-Z][A-Za-z]+)*)(?:\s*[:–—-]\s*(\d{4}))?(?:\s*Vol\.?\s*(\d+))?" + _SECTION


def parse(text: Column) -> Column:
    """``array<struct<code, version, section, raw_text>>``: standards, then works, each in order."""
    none = F.array().cast("array<struct<code: string, version: string, section: string, raw_text: string>>")
    some = lambda c: F.nullif(c, F.lit(""))
    row = lambda code, version, h: F.struct(code.alias("code"), some(version).alias("version"), some(h["g4"]).alias("section"), h["g0"].alias("raw_text"))
    # a standard's match looks at nothing outside, so its groups are those of the match alone; what follows works may decide
    named = F.transform(extracted(text, STANDARD), lambda raw: F.struct(raw.alias("g0"), *[group_of(raw, STANDARD, g).alias(f"g{g}") for g in range(1, 5)]))
    standards = F.transform(named, lambda h: row(F.concat(F.lit("IS "), h["g1"], F.coalesce(F.concat(F.lit(" (Part "), some(h["g2"]), F.lit(")")), F.lit(""))), h["g3"], h))
    groups = F.arrays_zip(*[extracted(text, WORKS, g).alias(f"g{g}") for g in range(5)])
    works = F.transform(groups, lambda h: row(F.concat(F.lit("CPWD "), h["g1"], F.coalesce(F.concat(F.lit(" Vol"), some(h["g3"])), F.lit(""))), h["g2"], h))
    some_is = ~ascii_only(text) | folded(text).contains("is")
    return F.concat(F.when(some_is, standards).otherwise(F.when(text.isNotNull(), none)), F.when(text.contains("CPWD"), works).otherwise(F.when(text.isNotNull(), none)))


def extract(texts: DataFrame, id_col: str = "id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """``(id, ord, code, version, section, raw_text)``: the first of each code, version and section. ``unique``: no
    id has two texts, so each text is decided on its own and nothing is shuffled."""
    if unique:
        key = lambda c: F.struct(c["code"], F.coalesce(c["version"], F.lit("")), F.coalesce(c["section"], F.lit("")))
        first = lambda found: F.filter(F.transform(found, lambda c, i: F.struct(i.alias("ord"), c.alias("c"))), lambda p: F.array_position(F.transform(found, key), key(p["c"])) == p["ord"] + 1)
        rows = texts.select(F.col(id_col).alias("id"), F.explode(let(parse(F.col(text_col)), first)).alias("p"))
        return rows.select("id", "p.ord", "p.c.*")
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(parse(F.col(text_col))).alias("ord", "c")).select("id", "ord", "c.*")
    return dedupe(rows)


def dedupe(citations: DataFrame) -> DataFrame:
    key = Window.partitionBy("id", "code", F.coalesce("version", F.lit("")), F.coalesce("section", F.lit(""))).orderBy("ord")
    return citations.withColumn("__n", F.row_number().over(key)).filter("__n = 1").drop("__n")


def registry(chunks: DataFrame) -> DataFrame:
    """``(code_id, section, chunk_id, ord)``: the first chunk of each code and section."""
    key = Window.partitionBy("code_id", "section").orderBy("source_file", "ord")
    first = chunks.withColumn("__n", F.row_number().over(key)).filter("__n = 1")
    return first.select("code_id", "section", "chunk_id", F.struct("source_file", "ord").alias("ord"))


def verify(citations: DataFrame, entries: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``resolved`` and ``resolved_chunk_id``.

    With a section, each of ``code:version`` and ``code`` is tried exactly, then
    for a subsection, then in any version. That last step takes codes that only
    start alike; ``strict`` asks for the same code. Without a section any
    chunk of the code will do. Each step is an equi-join on a derived key: a
    code's prefixes are few, so registry rows are exploded by them once.
    """
    c = citations.select("*", naming.code_id(F.col("code"), F.col("version")).alias("full"), F.struct("code", F.coalesce("version", F.lit("")).alias("version"), F.coalesce("section", F.lit("")).alias("section")).alias("__c"))
    r = entries.select("code_id", "section", "chunk_id", F.col("ord").alias("place"))
    attempt = F.posexplode(F.array("full", F.regexp_replace(F.btrim("code"), r"\s+", " "))).alias("attempt", "key")
    # each different citation is looked up once, however many texts have it
    tries = c.select("__c", "section", "code", "version", "full").distinct().select("__c", F.col("section").alias("wanted"), "code", "version", attempt).withColumn("key", F.when(F.col("attempt") == 0, F.col("key")).otherwise(F.col("code")))
    with_section, without = tries.filter("wanted is not null"), tries.filter("wanted is null")
    out = lambda df, rank: df.select("__c", (F.col("attempt") * 10 + rank).alias("rank"), "place", "chunk_id")
    exact = out(with_section.join(r.withColumnRenamed("code_id", "key").withColumn("wanted", F.col("section")).drop("section"), ["key", "wanted"]), 0)
    # a registry section under each of its ancestors
    parts = F.split("section", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    under = r.filter(F.instr("section", ".") > 0).select(F.col("code_id").alias("key"), F.explode(above).alias("wanted"), "chunk_id", "place")
    prefix = out(with_section.join(under, ["key", "wanted"]), 1)
    base = F.element_at(F.split("key", ":"), 1)
    bare = with_section.withColumn("base", base)
    loose = r.withColumnRenamed("section", "wanted")
    if strict:
        relaxed = bare.join(loose.withColumn("base", F.element_at(F.split("code_id", ":"), 1)), ["base", "wanted"])
    else:
        starts = F.transform(F.sequence(F.lit(1), F.length("code_id")), lambda n: F.substring("code_id", F.lit(1), n))
        relaxed = bare.join(loose.select("wanted", "chunk_id", "place", F.explode(starts).alias("base")), ["base", "wanted"])
    any_chunk = r.groupBy(F.col("code_id").alias("key")).agg(F.min_by("chunk_id", "place").alias("chunk_id"), F.min("place").alias("place"))
    of_code = out(without.join(any_chunk, "key"), 0)
    unversioned = any_chunk.filter(F.instr("key", ":") > 0).withColumn("key", F.substring_index("key", ":", 1)).groupBy("key").agg(F.min_by("chunk_id", "place").alias("chunk_id"), F.min("place").alias("place"))
    any_version = out(without.filter("version is null and attempt = 1").join(unversioned, "key"), 1)
    found = exact.unionByName(prefix).unionByName(out(relaxed, 2)).unionByName(of_code).unionByName(any_version)
    best = found.groupBy("__c").agg(F.min_by("chunk_id", F.struct("rank", "place")).alias("resolved_chunk_id"))
    return c.join(best, "__c", "left").drop("__c", "full").withColumn("resolved", F.col("resolved_chunk_id").isNotNull())


def counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("id").agg(F.count_if("resolved").alias("resolved_count"), F.count_if(~F.col("resolved")).alias("unresolved_count"))
