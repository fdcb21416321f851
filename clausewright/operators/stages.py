"""The stages between providers: eligibility, joins, decisions, audit rows, summaries.

Providers' replies are tables; a failed call is a row that is missing or carries an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import naming, rules
from clausewright.operators import ordinal

VERDICTS = ("REAL", "APPARENT", "WEAK")
CRITIQUES = ("CONFIRMED", "REJECTED", "WEAK")
TIERS = ("high", "medium", "low", "n/a")
STATUSES = ("ACCEPTED", "PASSED_GUARDRAILS_FAILED", "RETRY_LIMIT_REACHED", "ERROR", "REJECTED")


# Stage 1


def eligible(clauses: DataFrame, skip_tables: bool = True, min_chars: int = 40, most: int | None = None) -> DataFrame:
    """Clauses worth asking about; ``most`` keeps the first in document order (before any obligation filter)."""
    rows = clauses.filter(~(F.lit(skip_tables) & F.coalesce("table_origin", F.lit(False))) & (F.col("char_count") >= min_chars))
    return rows if most is None else ordinal.first_rows(rows, most, "doc_id", "ord")


def eligibility_figures(skip_tables: bool = True, min_chars: int = 40) -> list[Column]:
    table = F.lit(skip_tables) & F.coalesce("table_origin", F.lit(False))
    tiny = F.col("char_count") < min_chars
    return [F.count(F.lit(1)).alias("clauses_loaded"), F.count_if(table).alias("skipped_tables"), F.count_if(~table & tiny).alias("skipped_tiny"), F.count_if(~table & ~tiny).alias("eligible")]


def eligibility_counts(clauses: DataFrame, skip_tables: bool = True, min_chars: int = 40) -> DataFrame:
    return clauses.agg(*eligibility_figures(skip_tables, min_chars))


def obligations(rows: DataFrame, checks: DataFrame | None) -> DataFrame:
    """Adds ``is_obligation`` and ``rationale``; what the filter did not answer counts as an obligation."""
    if checks is None:
        return rows.select("*", F.lit(True).alias("is_obligation"), F.lit("filter skipped").alias("rationale"))
    told = checks.select("clause_id", F.col("is_obligation").alias("__o"), F.col("rationale").alias("__r"))
    return rows.join(told, "clause_id", "left").select(*[rows[c] for c in rows.columns], F.coalesce("__o", F.lit(True)).alias("is_obligation"), F.col("__r").alias("rationale"))


#: What flags tell of their clause, and confirmations of their flag; columns that the rows lack are left out.
_OF_CLAUSE = ("clause_id", "doc_id", "tender_id", "page", "clause_text", "section_path", "clause_number")


def candidate_flags(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """A row for every eligible clause: the rule's decision for those with a reply
    (clause_id, commitments), an unflagged audit row for all others, failed calls among them."""
    answer = replies.select("clause_id", rules.normalise_commitments(F.col("commitments")).alias("commitments"))
    # decided beside the reply, so that figures move a few flags to the clauses and no commitments
    rule = rules.evaluate_flag(F.col("commitments"))
    answer = answer.select("*", F.col("commitments").isNotNull().alias("__told"), rule["flagged"].alias("__flagged"), rule["reason"].alias("__reason"))
    rows = asked.drop("commitments").withColumnsRenamed({"text": "clause_text"}).join(answer, "clause_id", "left")
    scored = F.col("is_obligation") & F.coalesce("__told", F.lit(False))
    return rows.select(
        naming.flag_id(F.col("doc_id"), F.col("clause_id")).alias("flag_id"), *[c for c in _OF_CLAUSE if c in rows.columns],
        F.when(scored, F.col("commitments")).alias("commitments"), F.when(scored, F.col("__flagged")).otherwise(False).alias("flagged"), F.when(scored, F.col("__reason")).otherwise("not an obligation").alias("flag_reason"),
        scored.alias("is_obligation"), F.when(~scored, F.coalesce(F.nullif("rationale", F.lit("")), F.lit("obligation filter said no"))).alias("skipped_reason"), "ord",
    )


def stage1_figures() -> list[Column]:
    return [F.count(F.lit(1)).alias("records"), F.count_if("is_obligation").alias("bct_calls"), F.count_if("flagged").alias("flagged"), F.count_if(F.expr("is_obligation and not flagged")).alias("not_flagged"), F.count_if(F.expr("not is_obligation")).alias("non_obligation_records")]


def stage1_summary(flags: DataFrame) -> DataFrame:
    return flags.agg(*stage1_figures())


# Stage 2


def verdicts(flags: DataFrame, replies: DataFrame) -> DataFrame:
    """Verdicts of flagged clauses. An unknown verdict is REAL, and so is a failed call, whose error keeps it out of Stage 3."""
    told = replies.select("flag_id", F.col("verdict").alias("__v"), "resolving_clause_id", "rationale", "confidence", F.col("error").alias("__e"))
    rows = flags.filter("flagged").join(told, "flag_id", "left")
    error = F.when(F.col("__v").isNull(), F.coalesce("__e", F.lit("no reply"))).otherwise(F.col("__e"))
    return rows.select("flag_id", "clause_id", rules.coerce(F.col("__v"), VERDICTS, "REAL").alias("verdict"), "resolving_clause_id", F.coalesce("rationale", F.lit("")).alias("rationale"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), error.alias("error"), "ord")


def verdict_figures() -> list[Column]:
    return [F.count(F.lit(1)).alias("flags"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS], F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors")]


def verdict_counts(found: DataFrame) -> DataFrame:
    return found.agg(*verdict_figures())


def real(found: DataFrame) -> DataFrame:
    return found.filter("verdict = 'REAL' and coalesce(error, '') = ''")


# Stage 3


def confirmed(found: DataFrame, flags: DataFrame, critiques: DataFrame, severities: DataFrame) -> DataFrame:
    """One row a verdict whose flag exists: only REAL ones take a critique, only CONFIRMED ones a severity."""
    c = critiques.select("flag_id", rules.coerce(F.col("verdict"), CRITIQUES, "CONFIRMED").alias("__c"), F.col("refutation").alias("__f"), F.col("resolving_clause_id").alias("__r"))
    s = severities.select("flag_id", F.struct("commercial_exposure", "dispute_likelihood", "reviewer_cost", "rationale").alias("__s"))
    v = found.select("flag_id", F.col("verdict").alias("stage2_verdict"), F.col("rationale").alias("stage2_rationale"), "resolving_clause_id", F.coalesce("error", F.lit("")).alias("__error"))
    rows = v.join(flags.drop("error"), "flag_id").join(c, "flag_id", "left").join(s, "flag_id", "left")
    went_on = (F.col("stage2_verdict") == "REAL") & (F.col("__error") == "")
    critique = F.when(went_on, F.col("__c"))
    rated = F.when(critique == "CONFIRMED", F.col("__s"))
    composite = F.coalesce(rules.composite_severity(rated["commercial_exposure"], rated["dispute_likelihood"]), F.lit(0))
    return rows.select(
        "flag_id", *[c for c in _OF_CLAUSE if c in flags.columns], "stage2_verdict", "stage2_rationale", F.when(went_on, F.coalesce(F.nullif("__r", F.lit("")), "resolving_clause_id")).otherwise(F.col("resolving_clause_id")).alias("resolving_clause_id"),
        critique.alias("critique_verdict"), F.coalesce(F.when(went_on, F.col("__f")), F.lit("")).alias("critique_refutation"), rated.alias("severity"), composite.cast("int").alias("composite_severity"),
        F.when(rated.isNotNull(), rules.severity_tier(composite)).otherwise("n/a").alias("severity_tier"), "ord",
    )


def stage3_figures() -> list[Column]:
    asked = F.count("critique_verdict")
    counts = [F.count_if(F.col("critique_verdict") == v).alias(v.lower()) for v in CRITIQUES]
    tiers = [F.count_if((F.col("critique_verdict") == "CONFIRMED") & (F.col("severity_tier") == t)).alias(f"tier_{t.replace('/', '')}") for t in TIERS]
    rate = F.bround(F.count_if(F.col("critique_verdict") == "REJECTED") / F.greatest(asked, F.lit(1)), 3)
    return [asked.alias("critiqued"), *counts, *tiers, rate.alias("rejection_rate")]


def stage3_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*stage3_figures())


# Stage 4


def rewrite_candidates(rows: DataFrame, flags: DataFrame, tier: str | None = None, most: int | None = None) -> DataFrame:
    """Confirmed flags (of one tier) whose flag exists, the first ``most`` of them."""
    kept = rows.filter("critique_verdict = 'CONFIRMED'").join(flags.select("flag_id"), "flag_id", "left_semi")
    kept = kept if tier is None else kept.filter(F.col("severity_tier") == tier)
    return kept if most is None else ordinal.first_rows(kept, most, "ord")


def guardrails(attempts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Adds g1 to g3 and ``passed``.

    ``attempts``: (flag_id, attempt, resolved_count, unresolved_count,
    commitments, rewrite_commitments, vector, rewrite_vector); null vectors skip g3.
    """
    before, after = rules.unknown_count(F.col("commitments")), rules.unknown_count(F.col("rewrite_commitments"))
    close = rules.cosine(F.col("vector"), F.col("rewrite_vector"))
    rows = attempts.select("*", ((F.col("resolved_count") > 0) & (F.col("unresolved_count") == 0)).alias("g1"), before.alias("original_cd_count"), after.alias("rewrite_cd_count"), close.alias("__cos"))
    rows = rows.withColumn("g2", F.col("rewrite_cd_count") <= F.col("original_cd_count")).withColumn("g3", F.col("__cos") >= threshold).withColumn("intent_cosine", F.coalesce(F.bround("__cos", 4), F.lit(0.0))).drop("__cos")
    return rows.withColumn("passed", F.col("g1") & F.col("g2") & F.coalesce("g3", F.lit(True)))


def rewrite_status(checked: DataFrame, max_attempts: int = 3) -> DataFrame:
    """The row that ends each flag's attempts, and its status.

    The first passed attempt is accepted; an attempt whose model call failed
    (``error``) ends as ERROR; a failed re-check on the last attempt counts as a reached limit.
    """
    rows = checked if "error" in checked.columns else checked.withColumn("error", F.lit(None).cast("string"))
    ends = F.col("passed") | (F.coalesce("error", F.lit("")) != "")
    order = Window.partitionBy("flag_id").orderBy((~F.coalesce(ends, F.lit(False))).cast("int"), F.when(ends, F.col("attempt")).otherwise(-F.col("attempt")))
    last = rows.filter(F.col("attempt") <= max_attempts).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    status = F.when(F.coalesce("error", F.lit("")) != "", "ERROR").when(F.col("passed"), "ACCEPTED").when(F.col("attempt") >= max_attempts, "RETRY_LIMIT_REACHED").otherwise("PASSED_GUARDRAILS_FAILED")
    return last.withColumn("status", status).withColumnRenamed("attempt", "attempts")


def status_counts(rewrites: DataFrame) -> DataFrame:
    """One row a status, absent ones with zero; passes of g3 count only where it was tested."""
    known = rewrites.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    found = rewrites.groupBy("status").agg(F.count("*").alias("rewrites"), F.count_if("g1").alias("g1_passed"), F.count_if("g2").alias("g2_passed"), F.count_if("g3").alias("g3_passed"))
    return known.join(found, "status", "left").fillna(0)


# Formats


def findings(commitments: Column, questions: int = 4) -> Column:
    """What a bidder could not determine, as prompt lines."""
    asked = lambda c: F.transform(F.slice(F.coalesce(c["missing_info"], F.array().cast("array<string>")), 1, questions), lambda q: F.concat(F.lit("    bidder_q: "), q))
    missing = lambda c: F.filter(F.array(F.when(F.size(rules.gaps(c)) > 0, F.concat(F.lit("    missing: "), F.array_join(rules.gaps(c), ", ")))), lambda x: x.isNotNull())
    return F.array_join(F.flatten(F.transform(commitments, lambda c, i: F.concat(F.array(F.format_string("  Commitment %d: %s", i + 1, c["obligation"])), missing(c), asked(c)))), "\n")


def context_block(chunks: Column, limit: int = 600) -> Column:
    """Retrieved code sections, ``array<struct<code_id, section, page, text>>``, as prompt lines."""
    def said(c: Column, i: Column) -> Column:
        text = F.btrim(F.replace(c["text"], F.lit("\n"), F.lit(" ")))
        short = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" ..."))).otherwise(text)
        return F.concat(F.format_string("  [%d] %s  Section %s  (page %d)\n      ", i + 1, c["code_id"], c["section"], c["page"]), short)

    return F.array_join(F.transform(chunks, said), "\n")


# Joins around documents and runs


def validate_manifest(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """``(filename, issue)``: missing, size_mismatch (where the manifest tells a size), sha_mismatch, extra."""
    m = manifest.select("filename", F.col("file_size_bytes").alias("m_size"), F.col("sha256").alias("m_sha"), F.lit(True).alias("in_manifest"))
    d = disk.select("filename", F.col("file_size_bytes").alias("d_size"), F.col("sha256").alias("d_sha"), F.lit(True).alias("on_disk"))
    rows = m.join(d, "filename", "full_outer")
    both = F.col("in_manifest").isNotNull() & F.col("on_disk").isNotNull()
    issues = F.array(
        F.when(F.col("on_disk").isNull(), "missing"), F.when(F.col("in_manifest").isNull(), "extra"),
        F.when(both & (F.col("m_size") > 0) & (F.col("m_size") != F.col("d_size")), "size_mismatch"), F.when(both & (F.coalesce("m_sha", F.lit("")) != "") & (F.col("m_sha") != F.col("d_sha")), "sha_mismatch"),
    )
    return rows.select("filename", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("tender_id").agg(F.count("*").alias("num_documents"), F.count_if(F.col("role") == "corrigendum").alias("num_corrigenda"))


def report_rows(flags: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """Flags with the last verdict and the last confirmation of each."""
    last = lambda df, *cols: df.groupBy("flag_id").agg(*[F.max_by(c, "ord").alias(c) for c in cols])
    return flags.join(last(found, "verdict", "error"), "flag_id", "left").join(last(rows, "critique_verdict", "composite_severity", "severity_tier"), "flag_id", "left")


def questions(flags: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct questions of confirmed flags, the most severe first; a repeated one keeps its first place."""
    # a flag without a question has no row below
    curious = flags.select("flag_id", "clause_id", "section_path", "commitments").filter(F.exists("commitments", lambda c: F.size(c["missing_info"]) > 0))
    asked = rows.filter("critique_verdict = 'CONFIRMED'").select("flag_id", "composite_severity", "severity_tier", F.col("ord").alias("place")).join(curious, "flag_id")
    each = asked.select("*", F.posexplode("commitments").alias("c_ord", "c")).select("*", F.posexplode("c.missing_info").alias("q_ord", "question"))
    rank = F.struct(-F.col("composite_severity"), "place", "c_ord", "q_ord")
    first = each.withColumn("rank", rank).groupBy(F.lower(F.btrim("question")).alias("key")).agg(F.min_by(F.struct("clause_id", "section_path", "question", "composite_severity", "severity_tier"), "rank").alias("q"), F.min("rank").alias("rank"))
    return first.orderBy("rank").select("q.*")


def telemetry(calls: DataFrame, *per: str) -> DataFrame:
    """Calls, hits and misses of the cache, tokens and cost, of each value of ``per``; a hit costs nothing in ``billed_usd``."""
    return calls.groupBy(*per).agg(F.count("*").alias("api_calls"), F.count_if("cached").alias("cache_hits"), F.count_if(~F.col("cached")).alias("cache_misses"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"), F.sum(F.when(~F.col("cached"), F.col("cost_usd")).otherwise(0.0)).alias("billed_usd"))


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A repeatable sample of n rows, by hash of the key."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")).cast("binary")), key).limit(n)


def in_scope(clauses: DataFrame, doc_id: str, first: int, last: int) -> DataFrame:
    """Clauses of a document, whatever its case, on a range of pages."""
    return clauses.filter((F.lower(F.btrim("doc_id")) == doc_id.strip().lower()) & F.col("page").between(first, last))
