"""The whole run over lazy frames: pages to clauses, flags, verdicts, confirmations, rewrites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import rules
from clausewright.operators import citations, lexicon, retrieve, segment, stages
from clausewright.plans import extraction, prompts, providers
from clausewright.sources.observed import observed
from clausewright.sources.staging import stage


@dataclass
class Providers:
    """What models answer; every field can be a recorded table's provider."""

    obligations: providers.Provider = providers.stub_obligations
    commitments: providers.Provider = providers.stub_commitments
    embed: providers.Provider = field(default_factory=providers.stub_embedding)
    #: Of flags with ``block``, what was retrieved for them; critiques see the verdict's ``rationale`` as well.
    verdicts: providers.Provider | None = None
    critiques: providers.Provider | None = None
    severities: providers.Provider | None = None
    #: Of ``(flag_id, prompt)`` rows and a temperature, or None for the usual one.
    rewrites: Callable[[DataFrame, float | None], DataFrame] | None = None


@dataclass(frozen=True)
class Options:
    """Toggles and limits; a stage that is off leaves its tables out, and later stages are skipped."""

    tables: bool = True
    extract_definitions: bool = True
    extract_quantities: bool = True
    extract_references: bool = True
    skip_obligation_filter: bool = False
    top_k_route: int = 8
    top_k_fused: int = 8
    max_clauses: int | None = None
    rewrite: bool = True
    top_k_codes: int = 5
    max_rewrites: int | None = None


def code_context(flags: DataFrame, codes: DataFrame, embed: providers.Provider, k: int = 5) -> DataFrame:
    """``(flag_id, chunks)``: the code sections nearest to each flag's clause, the best first."""
    asked = embed(flags.select("flag_id", F.col("clause_text").alias("text"))).select(F.col("flag_id").alias("query_id"), "vector")
    found = retrieve.nearest(asked, embed(codes.select("chunk_id", "text")).select(F.col("chunk_id").alias("id"), "vector"), k)
    row = F.struct("rank", F.struct("code_id", "section", "page", "text").alias("chunk"))
    held = found.join(codes.select(F.col("chunk_id").alias("id"), "code_id", "section", "page", "text"), "id").groupBy(F.col("query_id").alias("flag_id"))
    return held.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["chunk"]).alias("chunks"))


def run(pages: DataFrame, table_rows: DataFrame | None = None, given: Providers | None = None, options: Options | None = None, codes: DataFrame | None = None, figures: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Tables by name. ``codes``: chunks of the code library, for rewrites. ``figures`` is filled with what
    was counted while the tables were written, by stage: the input of :func:`rollups.rollup_figures`.

    Tables that later ones read, the models' replies among them, are written to the shared
    folder as the run reaches them: a model is asked once, a lost executor costs no
    call, and no plan holds more than one stage. The others are lazy.
    """
    given, options = given or Providers(), options or Options()
    figures = {} if figures is None else figures

    def keep(name: str, rows: DataFrame, at: str, *asked: Column) -> DataFrame:
        held, figures[at] = observed(rows, name, *asked)
        return held

    out: dict[str, DataFrame] = {"clauses": segment.clauses(pages)}
    if options.tables and table_rows is not None:
        first = out["clauses"].groupBy("doc_id").agg(F.count("*").cast("int").alias("first_index"))
        out["clauses"] = out["clauses"].unionByName(segment.table_clauses(table_rows, first))
    origin = F.count_if(F.coalesce("table_origin", F.lit(False))).alias("table_clauses")
    clauses = out["clauses"] = keep("clauses", out["clauses"], "parse", F.count(F.lit(1)).alias("total_clauses"), origin, *stages.eligibility_figures())
    out["lexicon_flags"] = lexicon.flags(clauses)
    found, figures["extract"] = extraction.tables(clauses, with_definitions=options.extract_definitions, with_quantities=options.extract_quantities, with_references=options.extract_references)
    out |= found
    chosen = stages.eligible(clauses, most=options.max_clauses)
    asked = stage(stages.obligations(chosen, None if options.skip_obligation_filter else given.obligations(chosen)), "asked")
    out["candidate_flags"] = keep("candidate-flags", stages.candidate_flags(asked, given.commitments(asked.filter("is_obligation"))), "score", *stages.stage1_figures())
    figures["score"]["eligible"] = figures["parse"]["eligible"]
    flagged = out["candidate_flags"].filter("flagged")
    text = flagged.select("flag_id", retrieve.query_text(F.col("clause_text"), F.col("commitments")).alias("text"))
    routes = {"R1_dense": retrieve.dense(flagged, given.embed(text).select("flag_id", "vector"), given.embed(clauses.select("clause_id", "tender_id", "text")).select("clause_id", "tender_id", "vector"), options.top_k_route)}
    if "definitions" in out:
        routes["R2_defined_term"] = retrieve.shared_terms(flagged, clauses, out["definitions"], options.top_k_route)
    if "quantities" in out:
        routes["R3_referent"] = retrieve.shared_referents(flagged, out["quantities"], clauses, options.top_k_route)
    out["hybrid_hits"] = stage(retrieve.with_metadata(retrieve.fuse(routes, top=options.top_k_fused), clauses), "hits")
    if given.verdicts is None:
        return out
    evidence = stage(prompts.with_evidence(flagged, out["hybrid_hits"]), "evidence")
    out["verdicts"] = keep("verdicts", stages.verdicts(out["candidate_flags"], given.verdicts(evidence)), "critique", *stages.verdict_figures())
    if given.critiques is None or given.severities is None:
        return out
    real = evidence.join(stages.real(out["verdicts"]).select("flag_id", "rationale"), "flag_id")
    critiques = stage(given.critiques(real), "critiques")
    confirmed = evidence.join(critiques.filter(rules.coerce(F.col("verdict"), stages.CRITIQUES, "CONFIRMED") == "CONFIRMED").select("flag_id"), "flag_id", "left_semi")
    out["confirmed"] = keep("confirmed", stages.confirmed(out["verdicts"], out["candidate_flags"], critiques, given.severities(confirmed)), "confirm", *stages.stage3_figures())
    out["rewrite_candidates"] = stages.rewrite_candidates(out["confirmed"], out["candidate_flags"], most=options.max_rewrites)
    if options.rewrite and given.rewrites is not None and codes is not None:
        from clausewright.plans import rewrite

        registry = citations.registry(codes if "ord" in codes.columns else codes.withColumn("ord", F.col("chunk_id")))
        context = stage(code_context(out["rewrite_candidates"], codes, given.embed, options.top_k_codes), "code-context")
        out["rewrites"], out["rewrite_attempts"] = rewrite.loop(out["rewrite_candidates"], out["candidate_flags"], given, context, registry)
    return out
