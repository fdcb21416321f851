"""Summaries over the tables of stages: one row each, composed into a run's rollup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.operators import metrics, ordinal


def _one_row(tables: list[DataFrame]) -> DataFrame:
    """The columns of several one-row frames side by side, joined on a constant."""
    keyed = [t.withColumn("__one", F.lit(1)) for t in tables]
    return reduce(lambda a, b: a.join(F.broadcast(b), "__one"), keyed).drop("__one")


def parse_summary(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and OCR pages, clauses and those of tables."""
    ocr = F.coalesce("ocr_was_used", F.lit(False))
    return _one_row([
        pages.agg(F.countDistinct("doc_id").alias("documents_parsed"), F.count_if(ocr).alias("ocr_pages_total")),
        clauses.agg(F.count("*").alias("total_clauses"), F.count_if(F.coalesce("table_origin", F.lit(False))).alias("table_clauses")),
    ])


def extract_summary(clauses: DataFrame, definitions: DataFrame | None = None, quantities: DataFrame | None = None, references: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Counts of what extractors found, from their tables; an extractor that was off leaves its columns out. A run
    that writes these tables has the same from :func:`extraction.tables`, without reading them."""
    rows = [clauses.agg(F.count("*").alias("clauses_loaded"))]
    if definitions is not None:
        rows.append(definitions.agg(F.count("*").alias("definitions_extracted")))
    if quantities is not None:
        rows.append(quantities.agg(F.count("*").alias("quantities_extracted"), F.count_if(F.col("referent_method") == "llm").alias("quantities_referent_classified")))
    if references is not None:
        rows.append(references.agg(F.count("*").alias("references_extracted"), F.count_if("resolved").alias("references_resolved_internal")))
    rows += [t.agg(F.count("*").alias(f"graph_{n}")) for n, t in (("nodes", nodes), ("edges", edges)) if t is not None]
    return _one_row(rows)


#: Columns of a run's rollup: stage, column of its summary, and name in the rollup.
ROLLUP = [("parse", "total_clauses", "parse_clauses"), ("parse", "table_clauses", "parse_table_clauses"), ("extract", "definitions_extracted", "extract_definitions"), ("extract", "quantities_extracted", "extract_quantities"), ("extract", "references_extracted", "extract_references"), ("score", "eligible", "score_eligible"), ("score", "flagged", "score_flagged"), ("critique", "real", "critique_real"), ("critique", "apparent", "critique_apparent"), ("critique", "weak", "critique_weak"), ("confirm", "confirmed", "confirm_confirmed"), ("confirm", "rejected", "confirm_rejected"), ("confirm", "weak", "confirm_weak")]


def pipeline_rollup(summaries: dict[str, DataFrame]) -> DataFrame:
    """One row of a run's main figures; stages that did not run, and figures they lack, are null."""
    held = {stage: df for stage, df in summaries.items() if any(stage == s and c in df.columns for s, c, _ in ROLLUP)}
    rows = [df.select(*[F.col(c).alias(name) for s, c, name in ROLLUP if s == stage and c in df.columns]) for stage, df in held.items()]
    wide = _one_row(rows)
    return wide.select(*[F.col(name) if name in wide.columns else F.lit(None).cast("bigint").alias(name) for _, _, name in ROLLUP])


def rollup_figures(figures: dict[str, dict]) -> dict[str, int | None]:
    """The same of figures that were counted while the stages were written, by stage."""
    return {name: figures.get(stage, {}).get(c) for stage, c, name in ROLLUP}


def status_rollup(rewrites: DataFrame) -> DataFrame:
    """Accepted rewrites with their mean attempts (two places) and mean cosine (three)."""
    ok = F.col("status") == "ACCEPTED"
    return rewrites.agg(F.count_if(ok).alias("accepted"), F.bround(F.avg(F.when(ok, F.col("attempts"))), 2).alias("avg_attempts"), F.bround(F.avg(F.when(ok, F.coalesce("intent_cosine", F.lit(0.0)))), 3).alias("avg_intent_cosine"))


def most_common(rows: DataFrame, col: str, top: int | None = None, flagged_only: bool = False) -> DataFrame:
    """Values by their number of rows, ties in order of the value; the ``top`` of them."""
    kept = rows.filter("flagged") if flagged_only else rows
    counted = kept.groupBy(F.coalesce(F.col(col), F.lit("?")).alias(col)).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), col)
    return counted if top is None else counted.limit(top)


def scope_totals(clauses: DataFrame, flags: DataFrame, verdicts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Totals of the clauses in scope: flags, verdicts by kind and confirmations, of these clauses alone."""
    inside = clauses.select("clause_id").distinct()
    mine = lambda df: df.join(inside, "clause_id", "left_semi")
    kinds = [F.count_if(F.col("verdict") == v).alias(f"verdict_{v.lower()}") for v in ("REAL", "APPARENT", "WEAK")]
    return _one_row([
        clauses.agg(F.count("*").alias("clauses")), mine(flags).agg(F.count_if("flagged").alias("flagged"), F.count_if("is_obligation").alias("obligations")),
        mine(verdicts).agg(*kinds), mine(confirmed).agg(F.count_if(F.col("critique_verdict") == "CONFIRMED").alias("confirmed")),
    ])


def tender_metrics(universe: DataFrame, truth: DataFrame | None, flags: DataFrame, lexicon: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``(measure, name, value)``: sizes, agreement of flags and lexicon, and with a ground truth
    precision, recall, F1 and accuracy; those of confirmations only if there are any.

    All are frames of ``clause_id``.
    """
    rows = lambda measure, df, names: df.select(F.lit(measure).alias("measure"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("v")).select("measure", "v.*")
    sets = {"bct_pipeline": flags, "lexicon_baseline": lexicon, "bct_confirmed": confirmed}
    counted = _one_row([df.select("clause_id").distinct().agg(F.count("*").alias(n)) for n, df in (("universe_size", universe), *sets.items())])
    out = rows("counts", counted, ["universe_size", *sets])
    agreed = metrics.agreement(universe, flags, lexicon)
    out = out.unionByName(rows("agreement", agreed, agreed.columns))
    if truth is not None:
        rungs = None
        for name, df in sets.items():
            one = df.select(F.lit(name).alias("rung"), "clause_id")
            rungs = one if rungs is None else rungs.unionByName(one)
        scored = metrics.confusion(universe, truth, rungs, tuple(sets))
        some = scored.join(F.broadcast(counted.select("bct_confirmed")), F.lit(True)).filter("rung <> 'bct_confirmed' or bct_confirmed > 0")
        names = [c for c in scored.columns if c != "rung"]
        out = out.unionByName(some.select(F.col("rung").alias("measure"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("v")).select("measure", "v.*"))
    return out


def inspect(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the wanted values: words whatever their case, booleans as they are; None asks for nothing."""
    for col, value in wanted.items():
        if value is None:
            continue
        held: Column = F.col(col)
        rows = rows.filter(F.coalesce(held, F.lit(False)) == value if isinstance(value, bool) else F.lower(held) == str(value).lower())
    return rows


def corrigenda(manifest: DataFrame) -> DataFrame:
    """Corrigenda in order of their tender, sequence and name, with their ``place`` in it from 1."""
    return ordinal.with_ordinal(manifest.filter("role = 'corrigendum'"), "tender_id", F.col("sequence").asc_nulls_last(), "filename", name="place").orderBy("place")


def document_named(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """The manifest's first document of each name."""
    first = manifest.groupBy("filename").agg(F.min_by(F.struct(*manifest.columns), F.struct("tender_id", "sequence")).alias("d"))
    return names.select("filename").distinct().join(first, "filename").select("d.*")


def last_runs(runs: DataFrame, most: int = 10, per: str | None = None) -> DataFrame:
    """The latest runs, the newest first; with ``per`` the latest of each value of that column."""
    order = F.struct("started_at", "run_id")
    if per is None:
        return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(most)
    return runs.groupBy(per).agg(F.count("*").alias("runs"), F.sum("cost_inr").alias("cost_inr"), F.max_by("run_id", order).alias("latest"))
