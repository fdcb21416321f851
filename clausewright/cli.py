"""Command line over a tender's folder: ``clausewright GROUP ACTION --folder FOLDER``.

A folder holds ``manifest.json``, ``pages.parquet``, ``parsed/`` and ``runs/``. Models are recorded replies
(``--replies``, a folder with ``OPERATION.jsonl`` of key, reply and error) or the rule-based stand-ins.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators import citations, lexicon, metrics, retrieve, rollups, segment, stages
from clausewright.plans import extraction, operations, pipeline, prompts, providers, rewrite
from clausewright.session import session
from clausewright.sources import artefacts, pdf, report, sinks, synthetic
from clausewright.sources.observed import figures_of, observed, one_row
from clausewright.sources.staging import stage

#: Tables of a folder's ``parsed``: file and schema.
FILES = {"clauses": "clauses", "definitions": "definitions", "quantities": "quantities", "references": "references", "flags": "candidate_flags", "verdicts": "verdicts", "confirmed": "confirmed", "rewrites": "rewrites", "lexicon": "lexicon_flags"}
ACTIONS = {
    "acquire": ("list", "init", "drop", "validate", "synthesize"), "parse": ("run", "inspect"), "extract": ("run", "query", "summary"), "score": ("run", "inspect"), "critique": ("run", "inspect"), "confirm": ("run", "inspect"),
    "codes": ("build", "summary", "query", "verify"), "rewrite": ("run", "inspect"), "pipeline": ("run", "status", "history"), "report": ("html",), "eval": ("lexicon", "metrics", "compare", "ablation"), "verify": ("models",),
}


class Folder:
    """Tables of a tender's folder, read and written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: What was counted while tables were written, by name.
        self.figures: dict[str, dict] = {}

    def pages(self) -> DataFrame:
        """Decoded pages, or those of the folder's PDF files."""
        if artefacts.exists(self.spark, f"{self.path}/pages.parquet"):
            return self.spark.read.parquet(f"{self.path}/pages.parquet")
        return pdf.pages(self.files(), self.path.rsplit("/", 1)[-1])

    def files(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(self.path)

    def read(self, name: str, **options: object) -> DataFrame:
        """A table as the stages' operators have it."""
        rows = artefacts.jsonl(self.spark, f"{self.path}/parsed/{FILES[name]}.jsonl", FILES[name], **options)
        if name == "flags":
            rows = rows.withColumn("commitments", F.col("bct_output.commitments"))
        key = "clause_id" if name in ("clauses", "lexicon") else "flag_id"
        return rows.withColumn("ord", F.col(key)) if key in rows.columns else rows

    def write(self, name: str, rows: DataFrame, *figures: Column) -> DataFrame:
        """The table staged, as what is written may be read from the same folder; ``figures`` are counted as it is."""
        held, counted = observed(rows, f"cli-{name}", *figures)
        if "commitments" in held.columns and name == "flags":
            held = held.withColumn("bct_output", F.struct("commitments")).drop("commitments")
        where = f"{self.path}/parsed/{FILES[name]}.jsonl"
        _, written = figures_of(held.drop("ord"), lambda told: sinks.jsonl(told, where))
        self.figures[name] = counted | written
        return held

    def counted(self, name: str, *names: str) -> DataFrame:
        """Figures of a table as one row."""
        return one_row(self.spark, {n: self.figures[name][n] for n in names})

    def summary(self, name: str, row: DataFrame) -> None:
        sinks.summary(row, f"{self.path}/parsed/{name}_summary.json")
        row.show(truncate=False)


def models(spark: SparkSession, replies: str | None) -> pipeline.Providers:
    """Recorded replies, or stand-ins that take every flag for real and every rewrite for failed."""
    if replies:
        def model(sent: DataFrame) -> DataFrame:
            key = sent.columns[0]
            name = next(n for n, op in operations.OPERATIONS.items() if op.system == sent.select("system").first()[0]) if not sent.isEmpty() else "verdict"
            told = spark.read.schema(f"{key} string, reply string, error string").json(f"{replies}/{name}.jsonl")
            return told.join(sent.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")

        return operations.from_model(model, providers.stub_embedding())
    text = lambda *cols: [F.lit(v).cast(t).alias(c) for c, v, t in cols]
    return pipeline.Providers(
        verdicts=lambda rows: rows.select("flag_id", *text(("verdict", "REAL", "string"), ("resolving_clause_id", None, "string"), ("rationale", "stand-in", "string"), ("confidence", 0.5, "double"), ("error", None, "string"))),
        critiques=lambda rows: rows.select("flag_id", *text(("verdict", "CONFIRMED", "string"), ("refutation", "stand-in", "string"), ("resolving_clause_id", None, "string"))),
        severities=lambda rows: rows.select("flag_id", *text(("commercial_exposure", 3, "int"), ("dispute_likelihood", 3, "int"), ("reviewer_cost", 1, "int"), ("rationale", "stand-in", "string"))),
        rewrites=lambda rows, temperature: rows.select("flag_id", *text(("rewrite_text", None, "string"), ("explanation", None, "string"), ("is_code_citations", None, "array<struct<code: string, version: string, section: string>>"), ("error", "no model", "string"))),
    )


def _evidence(at: Folder, flags: DataFrame, given: pipeline.Providers, k: int) -> DataFrame:
    clauses = at.read("clauses")
    text = flags.select("flag_id", retrieve.query_text(F.col("clause_text"), F.col("commitments")).alias("text"))
    routes = {"R1_dense": retrieve.dense(flags, given.embed(text).select("flag_id", "vector"), given.embed(clauses.select("clause_id", "tender_id", "text")).select("clause_id", "tender_id", "vector"), k), "R2_defined_term": retrieve.shared_terms(flags, clauses, at.read("definitions", missing_ok=True), k), "R3_referent": retrieve.shared_referents(flags, at.read("quantities", missing_ok=True), clauses, k)}
    return stage(prompts.with_evidence(flags, retrieve.with_metadata(retrieve.fuse(routes, top=k), clauses)), "cli-evidence")


def parse(at: Folder, args: argparse.Namespace) -> None:
    if args.action == "inspect":
        rows = at.read("clauses")
        stages.sample(rows.filter("table_origin") if args.role == "table" else rows, args.n, "clause_id", args.seed).select("clause_id", "page", "text").show(args.n, truncate=120)
        return
    clauses = at.write("clauses", segment.clauses(at.pages()))
    sinks.jsonl(sinks.document_tree(at.pages()), f"{at.path}/parsed/document_tree.json")
    at.summary("parse", rollups.parse_summary(clauses, at.pages()))


def extract(at: Folder, args: argparse.Namespace) -> None:
    clauses = at.read("clauses")
    if args.action == "query":
        embed = providers.stub_embedding()
        asked = embed(at.spark.createDataFrame([("q", args.text)], "query_id string, text string")).select("query_id", "vector")
        retrieve.nearest(asked, embed(clauses.select(F.col("clause_id").alias("id"), "text")).select("id", "vector"), args.top_k).orderBy("rank").show(truncate=False)
    elif args.action == "summary":
        at.spark.read.json(f"{at.path}/parsed/extract_summary.json").show(truncate=False)
    else:
        held, figures = extraction.tables(clauses)
        for name in ("definitions", "quantities", "references"):
            at.write(name, held[name])
        at.summary("extract", one_row(at.spark, {"clauses_loaded": clauses.count()} | figures))


def score(at: Folder, args: argparse.Namespace) -> None:
    if args.action == "inspect":
        rows = rollups.inspect(at.read("flags"), flagged=args.flagged_only or None, is_obligation=args.obligations_only or None)
        stages.sample(rows, args.n, "flag_id", args.seed).select("flag_id", "flagged", "flag_reason", "clause_text").show(args.n, truncate=100)
        return
    given = models(at.spark, args.replies)
    chosen = stages.eligible(at.read("clauses"), skip_tables=not args.include_tables, most=args.max)
    asked = stage(stages.obligations(chosen, None if args.skip_filter else given.obligations(chosen)), "cli-asked")
    flags = at.write("flags", stages.candidate_flags(asked, given.commitments(asked.filter("is_obligation"))), *stages.stage1_figures())
    at.summary("stage1", at.counted("flags", *stages.stage1_summary(flags).columns))


def critique(at: Folder, args: argparse.Namespace) -> None:
    if args.action == "inspect":
        stages.sample(rollups.inspect(at.read("verdicts"), verdict=args.verdict), args.n, "flag_id", args.seed).select("flag_id", "verdict", "rationale", "error").show(args.n, truncate=100)
        return
    flags, given = at.read("flags"), models(at.spark, args.replies)
    flagged = flags.filter("flagged")
    flagged = flagged if args.max is None else flagged.orderBy("ord").limit(args.max)
    found = at.write("verdicts", stages.verdicts(flagged, given.verdicts(_evidence(at, flagged, given, args.top_k))), *stages.verdict_figures())
    at.summary("stage2", at.counted("verdicts", *stages.verdict_counts(found).columns))


def confirm(at: Folder, args: argparse.Namespace) -> None:
    if args.action == "inspect":
        rows = rollups.inspect(at.read("confirmed"), severity_tier=args.tier, critique_verdict="CONFIRMED" if args.confirmed_only else args.critique)
        stages.sample(rows, args.n, "flag_id", args.seed).select("flag_id", "critique_verdict", "severity_tier", "critique_refutation").show(args.n, truncate=100)
        return
    flags, found, given = at.read("flags"), at.read("verdicts"), models(at.spark, args.replies)
    real = stages.real(found)
    real = real if args.max is None else real.orderBy("ord").limit(args.max)
    evidence = _evidence(at, flags.join(real.select("flag_id"), "flag_id", "left_semi"), given, args.top_k).join(real.select("flag_id", "rationale"), "flag_id")
    said = stage(given.critiques(evidence), "cli-critiques")
    severe = evidence.join(said.filter("verdict = 'CONFIRMED'").select("flag_id"), "flag_id", "left_semi")
    rated = given.severities(severe.limit(0) if args.skip_severity else severe)
    at.summary("stage3", stages.stage3_summary(at.write("confirmed", stages.confirmed(found, flags, said, rated))))


def _codes(at: Folder) -> DataFrame:
    return artefacts.jsonl(at.spark, f"{at.path}/codes.jsonl", "iscode_chunks")


def codes(at: Folder, args: argparse.Namespace) -> None:
    embed, chunks = providers.stub_embedding(), _codes(at)
    if args.action == "build":
        where = f"{at.path}/code_vectors.parquet"
        new, registry = sinks.upsert_codes(chunks, at.spark.read.parquet(where) if artefacts.exists(at.spark, where) else None, embed)
        stage(new, "cli-codes").write.mode("append").parquet(where)
        sinks.registry_json(registry).coalesce(1).write.mode("overwrite").text(f"{at.path}/code_registry.json")
    elif args.action == "summary":
        chunks.groupBy("code_id").agg(F.count("*").alias("chunks"), F.countDistinct("section").alias("sections")).orderBy("code_id").show(truncate=False)
    elif args.action == "query":
        asked = embed(at.spark.createDataFrame([("q", args.text)], "query_id string, text string")).select("query_id", "vector")
        retrieve.nearest(asked, embed(chunks.select(F.col("chunk_id").alias("id"), "text")).select("id", "vector"), args.top_k).orderBy("rank").show(truncate=False)
    else:
        cited = citations.extract(at.spark.createDataFrame([("q", args.text)], "id string, text string"))
        citations.verify(cited, citations.registry(chunks.withColumn("ord", F.col("chunk_id")))).select("code", "version", "section", "resolved", "resolved_chunk_id").show(truncate=False)


def rewriting(at: Folder, args: argparse.Namespace) -> None:
    if args.action == "inspect":
        stages.sample(rollups.inspect(at.read("rewrites"), status="ACCEPTED" if args.accepted_only else args.status), args.n, "flag_id", args.seed).select("flag_id", "status", "rewrite_text").show(args.n, truncate=100)
        return
    flags, given, chunks = at.read("flags"), models(at.spark, args.replies), _codes(at)
    wanted = stages.rewrite_candidates(at.read("confirmed"), flags, tier=args.only_severity, most=args.max)
    context = stage(pipeline.code_context(wanted, chunks, given.embed, args.top_k), "cli-context")
    rows, _ = rewrite.loop(wanted, flags, given, context, citations.registry(chunks.withColumn("ord", F.col("chunk_id"))), max_attempts=args.max_attempts, threshold=args.intent_threshold)
    rows = at.write("rewrites", rows.select("flag_id", "clause_id", "tender_id", "doc_id", F.col("clause_text").alias("original_text"), "rewrite_text", F.col("explanation").alias("rewrite_explanation"), F.col("g1").alias("citation_integrity_passed"), F.col("g2").alias("reflag_check_passed"), F.col("g3").alias("intent_check_passed"), "original_cd_count", "rewrite_cd_count", "intent_cosine", "status", "rejection_reason", "attempts", "error"))
    at.summary("stage4", rollups.status_rollup(rows))


def whole(at: Folder, args: argparse.Namespace) -> None:
    if args.action == "status":
        names = {f"parsed/{f}.jsonl": f"{at.path}/parsed/{f}.jsonl" for f in FILES.values()}
        artefacts.status(at.spark, {"manifest.json": f"{at.path}/manifest.json", **names, "runs/_index.jsonl": f"{at.path}/runs/_index.jsonl"}).show(50, truncate=False)
    elif args.action == "history":
        rollups.last_runs(artefacts.runs(at.spark, f"{at.path}/runs/_index.jsonl"), args.limit).show(args.limit, truncate=False)
    else:
        run = sinks.start_run(at.path.rsplit("/", 1)[-1], "pipeline")
        steps = (("parse", parse), ("extract", extract), ("score", score), ("critique", critique), ("confirm", confirm), ("rewrite", rewriting))
        for name, step in steps:
            if name not in (args.skip or ()) and not (name == "rewrite" and not artefacts.exists(at.spark, f"{at.path}/codes.jsonl")):
                step(at, args)
        for f in FILES.values():
            if artefacts.exists(at.spark, f"{at.path}/parsed/{f}.jsonl"):
                name = next(n for n, file in FILES.items() if file == f)
                sinks.record(at.spark, run, f"{at.path}/parsed/{f}.jsonl", "outputs", at.figures.get(name))
        sinks.finish_run(at.spark, run, at.path)


def reporting(at: Folder, args: argparse.Namespace) -> None:
    rewrites = at.read("rewrites", missing_ok=True)
    html = report.render(at.path.rsplit("/", 1)[-1], at.read("flags"), at.read("verdicts", missing_ok=True), at.read("confirmed", missing_ok=True), artefacts.runs(at.spark, f"{at.path}/runs/_index.jsonl"), None, rewrites)
    at.spark.createDataFrame([(html,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at.path}/report.html")


def evaluate(at: Folder, args: argparse.Namespace) -> None:
    if args.action == "lexicon":
        flags = at.write("lexicon", lexicon.flags(at.read("clauses")))
        at.summary("baseline_lexicon", lexicon.summary(flags, args.min_markers))
        return
    ids = lambda f, p: artefacts.ids(at.spark, f"{at.path}/parsed/{FILES[f]}.jsonl", p)
    flagged = "coalesce(flagged, false)"
    lex, flags, real, sure = ids("lexicon", flagged), ids("flags", flagged), ids("verdicts", "verdict = 'REAL'"), ids("confirmed", "critique_verdict = 'CONFIRMED'")
    truth = artefacts.id_list(at.spark, args.truth) if args.truth else None
    universe = metrics.observed(ids("lexicon", None), ids("flags", None))
    if args.action == "metrics":
        rollups.tender_metrics(universe, truth, flags, lex, sure).orderBy("measure", "name").show(100, truncate=False)
    elif args.action == "compare":
        metrics.agreement(universe, flags, lex).show(truncate=False)
    else:
        rows = universe.selectExpr("'A0_no_filter' as rung", "clause_id")
        for name, df in zip(metrics.RUNGS[1:], (lex, flags, real, sure), strict=True):
            rows = rows.unionByName(df.selectExpr(f"'{name}' as rung", "clause_id"))
        metrics.format_table(metrics.confusion(metrics.observed(truth, universe), truth, rows, metrics.RUNGS).orderBy("rung")).show(truncate=False)


def acquire(at: Folder, args: argparse.Namespace) -> None:
    spark, where = at.spark, f"{at.path}/manifest.json"
    if args.action == "synthesize":
        synthetic.write(spark, at.path, at.path.rsplit("/", 1)[-1], args.overwrite)
    elif args.action == "list":
        artefacts.manifest(spark, f"{at.path}/*/manifest.json").transform(stages.manifest_counts).orderBy("tender_id").show(truncate=False)
    elif args.action in ("init", "drop"):
        name = at.path.rsplit("/", 1)[-1]
        found = artefacts.files(spark, at.path).select(F.lit(name).alias("tender_id"), "filename", "role", "sequence", "file_size_bytes", "sha256").join(pdf.checked(at.files()).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "page_count"), "filename", "left") if args.action == "drop" else spark.createDataFrame([(name, None)], "tender_id string, filename string")
        sinks.manifest(found, where, project_title=args.title, issuing_authority=args.authority, source_url=args.source_url)
    else:
        listed = artefacts.manifest(spark, where).filter("filename is not null")
        issues = stages.validate_manifest(listed, artefacts.files(spark, at.path))
        issues.show(100, truncate=False)
        if not issues.isEmpty():
            raise SystemExit(1)


def verify(at: Folder, args: argparse.Namespace) -> None:
    """One commitment call, twice, of which the second must be answered from the cache."""
    given = models(at.spark, args.replies)
    asked = at.spark.createDataFrame([("smoke", "The Contractor shall cure concrete for 7 days.")], "clause_id string, text string")
    told = given.commitments(asked)
    key = sinks.cache_key(F.lit("generate"), F.lit(operations.FAST), F.col("text"), F.lit("commitments"), F.lit(0.0), F.lit(""), F.lit(None))
    cache = asked.join(told, "clause_id").select(key.alias("cache_key"), F.to_json("commitments").alias("reply"))
    hits, open_ = sinks.cached(asked.select("*", key.alias("cache_key")), cache)
    print(f"replies {told.count()}, cache hits {hits.count()}, open {open_.count()}")


HANDLERS = {"acquire": acquire, "parse": parse, "extract": extract, "score": score, "critique": critique, "confirm": confirm, "codes": codes, "rewrite": rewriting, "pipeline": whole, "report": reporting, "eval": evaluate, "verify": verify}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clausewright")
    groups = p.add_subparsers(dest="group", required=True)
    for name, actions in ACTIONS.items():
        g = groups.add_parser(name)
        g.add_argument("action", choices=actions)
        g.add_argument("text", nargs="?", default="", help="of extract query, codes query and codes verify")
        g.add_argument("--folder", required=True, help="a tender's folder")
        for flag in ("replies", "truth", "verdict", "tier", "critique", "status", "only-severity"):
            g.add_argument(f"--{flag}")
        for flag in ("title", "authority", "source-url"):
            g.add_argument(f"--{flag}", default="")
        for flag, value in (("n", 10), ("seed", 42), ("top-k", 8), ("limit", 20), ("max-attempts", 3), ("min-markers", 1)):
            g.add_argument(f"--{flag}", type=int, default=value)
        g.add_argument("--max", type=int)
        g.add_argument("--intent-threshold", type=float, default=0.6)
        g.add_argument("--role", choices=("any", "table"), default="any")
        g.add_argument("--skip", action="append", choices=("parse", "extract", "score", "critique", "confirm", "rewrite"))
        for flag in ("include-tables", "skip-filter", "flagged-only", "obligations-only", "skip-severity", "confirmed-only", "accepted-only", "overwrite"):
            g.add_argument(f"--{flag}", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.group == "eval" and args.action == "ablation" and not args.truth:
        raise SystemExit("eval ablation needs --truth")
    HANDLERS[args.group](Folder(session(), args.folder), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
