"""Prompts, assembled by expressions; batches are numbered so that a call holds a bounded number of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.rules import UNKNOWN
from clausewright.functions.text import truncate


def commitment_prompt(text: Column) -> Column:
    return F.concat(F.lit("Clause:\n"), F.btrim(text), F.lit(f"\n\nList each obligation with quantity, method and standard as the clause states them, or {UNKNOWN}; a standard that the contract itself defines is CONTRACT_DEFINED. Add at most 4 questions about what is missing."))


def batched(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``batch``: groups of ``size`` rows on average, by hash, so no global order is needed."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)))


def batch_prompt(rows: DataFrame, key: str, text_col: str, head: str, limit: int) -> DataFrame:
    """``(batch, ids, prompt)``: items in order of their ids, texts cut at ``limit``."""
    item = F.struct(F.col(key).alias("id"), F.concat(F.lit("["), F.col(key), F.lit("] "), truncate(F.regexp_replace(text_col, "\n", " "), limit)).alias("line"))
    held = rows.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return held.select("batch", F.col("items.id").alias("ids"), F.concat(F.lit(head + "\n"), F.array_join("items.line", "\n")).alias("prompt"))


def hits_block(hits: DataFrame, limit: int = 500) -> DataFrame:
    """``(flag_id, n_hits, block)``: retrieved clauses as prompt lines, in order of rank."""
    where = F.format_string("  [%2d] %s  page %s  clause %s  routes=%s  rrf=%.4f", "rank", "clause_id", F.coalesce(F.col("metadata.page").cast("string"), F.lit("?")), F.coalesce(F.nullif("metadata.clause_number", F.lit("")), F.lit("-")), F.array_join("sources", "+"), "rrf_score")
    text = truncate(F.btrim(F.regexp_replace("text", "\n", " ")), limit, " ...")
    line = F.struct("rank", F.concat(where, F.lit("\n       "), text).alias("line"))
    return hits.groupBy("flag_id").agg(F.count("*").cast("int").alias("n_hits"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda h: h["line"]), "\n").alias("block"))


def with_evidence(flags: DataFrame, hits: DataFrame) -> DataFrame:
    """``flags`` with ``n_hits`` and ``block`` of what was retrieved for each."""
    found = flags.join(hits_block(hits), "flag_id", "left")
    return found.withColumn("block", F.coalesce("block", F.lit("  (no clauses retrieved)"))).withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
