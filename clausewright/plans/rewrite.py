"""The rewrite loop: at most three rounds over all open flags at once.

A round asks for a rewrite of every flag that is still open, checks citations
(G1), asks for the commitments of the new text (G2, no more unknown fields than
before) and compares the meaning (G3, cosine). A flag that fails carries the reasons
into its next request; later checks wait until earlier ones pass, but on the last
attempt all are made. A round's replies and rows are written to the shared folder, so
a model is asked once, whatever executors are lost, and plans stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import rules
from clausewright.operators import citations, stages
from clausewright.plans import operations
from clausewright.plans.pipeline import Providers
from clausewright.sources.staging import stage

THRESHOLD, MAX_ATTEMPTS = 0.6, 3


def _citations(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """``(flag_id, cited, resolved_count, unresolved_count, unresolved)`` of the text's and the reply's citations."""
    told = F.transform(F.coalesce("is_code_citations", F.array().cast("array<struct<code: string, version: string, section: string>>")), lambda c: F.struct(c["code"].alias("code"), F.nullif(c["version"], F.lit("")).alias("version"), F.nullif(c["section"], F.lit("")).alias("section"), F.concat(c["code"], F.coalesce(F.concat(F.lit(":"), F.nullif(c["version"], F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(" §"), F.nullif(c["section"], F.lit(""))), F.lit(""))).alias("raw_text")))
    every = rows.select(F.col("flag_id").alias("id"), F.posexplode(F.concat(citations.parse(F.col("rewrite_text")), told)).alias("ord", "c")).select("id", "ord", "c.*")
    checked = citations.verify(citations.dedupe(every), registry)
    one = F.struct("ord", "code", "version", "section", "raw_text", "resolved", "resolved_chunk_id")
    name = F.format_string("%s %s §%s", "code", F.coalesce("version", F.lit("")), F.coalesce("section", F.lit("?")))
    return checked.groupBy(F.col("id").alias("flag_id")).agg(F.array_sort(F.collect_list(one)).alias("cited"), F.count_if("resolved").alias("resolved_count"), F.count_if(~F.col("resolved")).alias("unresolved_count"), F.array_sort(F.collect_list(F.when(~F.col("resolved"), name))).alias("unresolved"))


def _reasons(last: Column) -> Column:
    """Why an attempt goes no further, for the next request."""
    g1 = F.when(~F.col("g1"), F.format_string("G1: %d citations are not among the code sections (%s), %d are; cite given sections only.", "unresolved_count", F.array_join("unresolved", "; "), "resolved_count"))
    g2 = F.when(F.col("recheck_error").isNotNull(), F.concat(F.lit("G2: the check of the new text failed: "), F.col("recheck_error"))).when(~F.col("g2"), F.format_string("G2: %d fields are %s where the original had %d: %s", "rewrite_cd_count", F.lit(rules.UNKNOWN), "original_cd_count", "recheck_reason"))
    g3 = F.when(~F.col("g3"), F.format_string("G3: cosine %.3f is below %.2f; keep more of the original wording.", "intent_cosine", F.lit(THRESHOLD)))
    # an earlier failure ends an attempt that is not the last
    first = F.coalesce(F.when(g1.isNotNull(), F.array(g1)), F.when(g2.isNotNull(), F.array(g2)), F.when(g3.isNotNull(), F.array(g3)), F.array().cast("array<string>"))
    return F.when(last, F.filter(F.array(g1, g2, g3), lambda r: r.isNotNull())).otherwise(first)


def _attempt(open_flags: DataFrame, attempt: int, given: Providers, chunks: DataFrame, registry: DataFrame, vectors: DataFrame | None, most: int, threshold: float) -> DataFrame:
    asked = operations.rewrite_prompt(open_flags, chunks, F.col("failures"))
    told = given.rewrites(asked, operations.RETRY_TEMPERATURE if attempt > 1 else None)
    told = told.select("flag_id", "rewrite_text", "explanation", "is_code_citations", "error")
    told = stage(told, "rewrite-replies")
    written = told.filter("error is null")
    cited = _citations(written, registry)
    rows = open_flags.join(told, "flag_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("rewrite_text").isNull(), "no reply"))).join(cited, "flag_id", "left")
    none = F.lit(0)
    rows = rows.withColumn("resolved_count", F.coalesce("resolved_count", none)).withColumn("unresolved_count", F.coalesce("unresolved_count", none)).withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>")))
    rows = rows.withColumn("attempt", F.lit(attempt)).withColumn("may_go_on", F.col("error").isNull() & ((F.lit(attempt == most)) | ((F.col("resolved_count") > 0) & (F.col("unresolved_count") == 0))))
    rows = stage(rows, "rewrite-cited")
    # only texts that got so far are checked again
    again = given.commitments(rows.filter("may_go_on").select(F.col("flag_id").alias("clause_id"), F.col("rewrite_text").alias("text"))).select(F.col("clause_id").alias("flag_id"), rules.normalise_commitments(F.col("commitments")).alias("rewrite_commitments"))
    rows = rows.join(again, "flag_id", "left")
    if vectors is None:
        rows = rows.withColumn("vector", F.lit(None).cast("array<double>")).withColumn("rewrite_vector", F.lit(None).cast("array<double>"))
    else:
        new = given.embed(rows.filter("may_go_on").select("flag_id", F.col("rewrite_text").alias("text"))).select("flag_id", F.col("vector").alias("rewrite_vector"))
        rows = rows.join(vectors, "flag_id", "left").join(new, "flag_id", "left")
    checked = stages.guardrails(rows, threshold)
    failed = F.when(F.col("may_go_on") & F.col("rewrite_commitments").isNull(), "no reply")
    checked = checked.withColumn("recheck_error", failed).withColumn("recheck_reason", rules.evaluate_flag(F.col("rewrite_commitments"))["reason"])
    # a check that was not reached is neither passed nor failed
    reached = F.col("may_go_on") & F.col("recheck_error").isNull()
    checked = checked.withColumn("g2", F.when(F.col("may_go_on"), reached & F.col("g2"))).withColumn("g3", F.when(reached, F.col("g3"))).withColumn("intent_cosine", F.when(reached, F.col("intent_cosine")).otherwise(0.0))
    checked = checked.withColumn("passed", F.col("error").isNull() & F.col("g1") & F.coalesce("g2", F.lit(False)) & F.coalesce("g3", F.lit(True)))
    why = F.when(F.col("error").isNull() & ~F.col("passed"), _reasons(F.lit(attempt == most))).otherwise(F.array().cast("array<string>"))
    return stage(checked.withColumn("failures", F.concat("failures", why)).drop("vector", "rewrite_vector", "may_go_on", "recheck_reason"), "rewrite-attempt")


def loop(candidates: DataFrame, flags: DataFrame, given: Providers, chunks: DataFrame, registry: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, threshold: float = THRESHOLD, compare: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(rewrites, attempts)``: the attempt that ends each flag with its status, and all attempts.

    ``chunks``: (flag_id, chunks) retrieved code sections; ``registry`` as of
    :func:`citations.registry`; without ``compare`` G3 is skipped.
    """
    if given.rewrites is None:
        raise ValueError("no provider of rewrites")
    now = candidates.select("flag_id", "clause_id", "doc_id", "tender_id", "clause_text", "section_path").join(flags.select("flag_id", "commitments"), "flag_id")
    now = stage(now.withColumn("failures", F.array().cast("array<string>")), "rewrite-open")
    vectors = stage(given.embed(now.select("flag_id", F.col("clause_text").alias("text"))).select("flag_id", "vector"), "rewrite-vectors") if compare else None
    columns, every = now.columns, None
    for attempt in range(1, max_attempts + 1):
        made = _attempt(now, attempt, given, chunks, registry, vectors, max_attempts, threshold)
        every = made if every is None else every.unionByName(made)
        now = made.filter("not passed and error is null").select(*columns)
        if attempt < max_attempts and now.isEmpty():
            break
    reason = F.when(F.col("status") == "ACCEPTED", "").when(F.col("error").isNotNull(), F.concat(F.lit("model call failed: "), F.col("error"))).otherwise(F.coalesce(F.element_at("failures", -1), F.lit("")))
    return stages.rewrite_status(every, max_attempts).withColumn("rejection_reason", reason), every
