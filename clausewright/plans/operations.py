"""Requests and replies of the model operations: prompts from tables, typed replies with an error column.

An operation turns rows into ``(key, system, prompt, model, temperature)``, a model
(any provider of ``(key, reply, error)``: a recorded table, a service behind
:func:`providers.calling`) answers with JSON, and the reply is checked against the
operation's schema: one that is no JSON, lacks a required field or has one out of range
gives a row with ``error`` alone, so later stages count it as a failed call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.rules import UNKNOWN
from clausewright.operators import definitions, stages
from clausewright.operators.quantities import REFERENTS
from clausewright.plans import prompts
from clausewright.plans.pipeline import Providers
from clausewright.schemas import COMMITMENTS

Model = Callable[[DataFrame], DataFrame]
#: Models by tier.
FAST, STRONG = "gemini-2.5-flash", "gemini-2.5-pro"


@dataclass(frozen=True)
class Operation:
    """``fields``: DDL of a reply, or of each of its ``items``; ``required``: a condition on them, null counting as false."""

    key: str
    fields: str
    required: str
    system: str
    model: str = FAST
    temperature: float = 0.0
    batch: int = 1


OPERATIONS = {
    "obligation": Operation("clause_id", "clause_id string, is_obligation boolean, rationale string", "clause_id <> '' and is_obligation is not null", "You tell contract clauses that oblige a party from those that do not.", batch=50),
    "commitments": Operation("clause_id", f"commitments {COMMITMENTS}", "forall(commitments, c -> c.obligation is not null)", "You list what a clause commits its parties to, and what a bidder cannot determine from it."),
    "verdict": Operation("flag_id", "verdict string, resolving_clause_id string, rationale string, confidence double", "verdict is not null and coalesce(confidence, 0) between 0 and 1", "You judge whether the rest of a tender resolves what a clause leaves open."),
    "critique": Operation("flag_id", "verdict string, refutation string, resolving_clause_id string", "verdict is not null", "You try to refute that a clause is ambiguous.", STRONG, 0.2),
    "severity": Operation("flag_id", "commercial_exposure int, dispute_likelihood int, reviewer_cost int, rationale string", "commercial_exposure between 1 and 5 and dispute_likelihood between 1 and 5 and reviewer_cost between 1 and 5", "You rate the risk of an ambiguous clause.", STRONG),
    "rewrite": Operation("flag_id", "rewrite_text string, explanation string, is_code_citations array<struct<code: string, version: string, section: string>>", "trim(rewrite_text) <> ''", "You rewrite a clause so that it can be priced, citing given code sections only.", STRONG, 0.25),
    "referent": Operation("quantity_id", "quantity_id string, referent string, confidence double", "quantity_id <> '' and coalesce(confidence, 0) between 0 and 1", f"You name what a quantity measures: one of {', '.join(REFERENTS)}, or UNCLASSIFIED.", batch=30),
    "definition": Operation("clause_id", "clause_id string, canonical_form string, definition_text string", "clause_id <> '' and canonical_form <> '' and definition_text <> ''", "You find the terms that a clause defines.", batch=10),
}
#: Temperature of a rewrite's later attempts.
RETRY_TEMPERATURE = 0.45


def _schema(op: Operation) -> str:
    fields = f"struct<{', '.join(f'{n}: {t}' for n, t in (f.split(' ', 1) for f in _split(op.fields)))}>"
    return f"items array<{fields}>, __broken string" if op.batch > 1 else f"{', '.join(_split(op.fields))}, __broken string"


def _split(ddl: str) -> list[str]:
    """Top-level fields of a DDL."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:k].strip())
            start = k + 1
    return out


def requests(name: str, rows: DataFrame, prompt: Column, temperature: float | None = None) -> DataFrame:
    """``(key, system, prompt, model, temperature)``, the key under the operation's own name."""
    op = OPERATIONS[name]
    key = "batch" if op.batch > 1 else op.key
    return rows.select(key, F.lit(op.system).alias("system"), prompt.alias("prompt"), F.lit(op.model).alias("model"), F.lit(op.temperature if temperature is None else temperature).alias("temperature"))


def typed(name: str, replies: DataFrame) -> DataFrame:
    """``(key, fields..., error)`` of ``(key, reply, error)``; the items of a batch are rows of their own.

    A batch that fails gives no items, and of a batch the items that do not hold are left out.
    """
    op = OPERATIONS[name]
    names = [f.split(" ", 1)[0] for f in _split(op.fields)]
    # a fence around the JSON is not part of it
    bare = F.regexp_replace(F.btrim("reply"), r"^```[a-z]*\s*|\s*```$", "")
    parsed = F.from_json(bare, _schema(op), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    read = replies.withColumn("__j", parsed)
    failed = F.coalesce(F.nullif("error", F.lit("")), F.when(F.col("reply").isNull(), "no reply").when(F.col("__j").isNull() | F.col("__j.__broken").isNotNull(), "reply is no valid JSON"))
    if op.batch > 1:
        items = read.filter(failed.isNull()).select(F.explode("__j.items").alias("__i")).select("__i.*")
        return items.filter(F.coalesce(F.expr(op.required), F.lit(False))).withColumn("error", F.lit(None).cast("string"))
    rows = read.select(op.key, *[F.col(f"__j.{n}").alias(n) for n in names], failed.alias("__failed"))
    error = F.coalesce("__failed", F.when(~F.coalesce(F.expr(op.required), F.lit(False)), "reply lacks a field or has one out of range"))
    rows = rows.withColumn("error", error)
    return rows.select(op.key, *[F.when(F.col("error").isNull(), F.col(n)).alias(n) for n in names], "error")


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _clause() -> list[Column]:
    section = F.coalesce(F.nullif(F.array_join("section_path", " > "), F.lit("")), F.lit("(none)"))
    return [F.concat(F.lit("Clause "), F.col("clause_id"), F.lit(", section "), section, F.lit(":")), F.btrim("clause_text"), F.lit("What cannot be determined:"), stages.findings(F.col("commitments"))]


def batches(name: str, rows: DataFrame, text_col: str, limit: int = 1200) -> DataFrame:
    """Requests of several rows each."""
    op = OPERATIONS[name]
    held = prompts.batch_prompt(prompts.batched(rows, op.key, op.batch), op.key, text_col, f"Answer with JSON {{\"items\": [{{{', '.join(f.split(' ', 1)[0] for f in _split(op.fields))}}}]}}, one for each line:", limit)
    return requests(name, held, F.col("prompt"))


def from_model(model: Model, embed: Callable | None = None) -> Providers:
    """The pipeline's providers from one model."""
    ask = lambda name, sent: typed(name, model(sent))

    def commitments(rows: DataFrame) -> DataFrame:
        got = ask("commitments", requests("commitments", rows, prompts.commitment_prompt(F.col("text"))))
        return got.filter("error is null").select("clause_id", "commitments")

    def severities(flags: DataFrame) -> DataFrame:
        return ask("severity", requests("severity", flags, _lines(*_clause(), "Rate commercial_exposure, dispute_likelihood and reviewer_cost, each 1 to 5, with a rationale, as JSON."))).filter("error is null")

    given = Providers(
        obligations=lambda rows: ask("obligation", batches("obligation", rows, "text")),
        commitments=commitments,
        verdicts=lambda flags: ask("verdict", requests("verdict", flags, _lines(*_clause(), F.format_string("Retrieved clauses (%d):", "n_hits"), F.col("block"), "Answer with JSON: verdict (REAL, APPARENT or WEAK), resolving_clause_id, rationale, confidence."))),
        critiques=lambda flags: ask("critique", requests("critique", flags, _lines(*_clause(), F.format_string("Retrieved clauses (%d):", "n_hits"), F.col("block"), F.concat(F.lit("First judgement: "), F.coalesce("rationale", F.lit(""))), "Answer with JSON: verdict (CONFIRMED, REJECTED or WEAK), refutation, resolving_clause_id."))),
        severities=severities,
        rewrites=lambda rows, temperature: ask("rewrite", requests("rewrite", rows, F.col("prompt"), temperature)),
    )
    if embed is not None:
        given.embed = embed
    return given


def referents(quantities: DataFrame, model: Model) -> DataFrame:
    """Replies for :func:`quantities.classify`."""
    text = F.concat(F.col("raw_text"), F.lit(" in: "), F.col("surrounding_text"))
    return typed("referent", model(batches("referent", quantities.withColumn("__text", text), "__text", 400)))


def defined_terms(clauses: DataFrame, found: DataFrame, model: Model) -> DataFrame:
    """Replies for :func:`definitions.extract`, of the clauses of definitions sections without a definition of their own."""
    return typed("definition", model(batches("definition", definitions.fallback_candidates(clauses, found), "text")))


def rewrite_prompt(flags: DataFrame, chunks: DataFrame, failures: Column | None = None) -> DataFrame:
    """``flags`` with ``prompt``: what a retry has to mend comes first, then the clause and the code sections."""
    held = flags.join(chunks, "flag_id", "left")
    sections = F.coalesce("chunks", F.array().cast("array<struct<code_id: string, section: string, page: int, text: string>>"))
    again = F.lit(None).cast("string") if failures is None else F.when(F.size(failures) > 0, F.concat(F.lit("The last attempt failed:\n"), F.array_join(F.transform(failures, lambda m: F.concat(F.lit("  - "), m)), "\n")))
    return held.withColumn("prompt", _lines(again, *_clause(), F.format_string("Code sections (%d):", F.size(sections)), stages.context_block(sections), f"Rewrite the clause so that nothing is {UNKNOWN}; cite only the sections above. Answer with JSON: rewrite_text, is_code_citations (code, version, section), explanation.")).drop("chunks")
