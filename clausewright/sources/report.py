"""The HTML report: every part is rendered by expressions row by row and gathered as one file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.rules import sentinel_class
from clausewright.functions.text import html_escape
from clausewright.operators.stages import questions, report_rows

_STYLE = "body{font-family:sans-serif;max-width:60em;margin:auto}.card{display:inline-block;padding:1em;margin:.3em;background:#eee}.flag{border:1px solid #ccc;margin:1em 0;padding:.6em}.meta{color:#666;margin-right:1em}.cannot{color:#b00}.contract{color:#06c}.high{color:#b00}.medium{color:#a60}.low{color:#666}"
#: Sections in their order: what their rows are, and their titles.
SECTIONS = [("confirmed", "Confirmed ambiguities, the most severe first"), ("rejected", "Refuted by the critique"), ("unreviewed", "Real ambiguities without a critique yet"), ("apparent", "Resolved elsewhere in the tender"), ("weak", "Borderline cases")]


def card(number: Column, label: str, css: str = "") -> Column:
    return F.concat(F.lit(f"<div class='card {css}'><b>"), number.cast("string"), F.lit(f"</b> {label}</div>"))


def cards(rows: DataFrame) -> DataFrame:
    """One row: the counts at the head of the report."""
    real = F.expr("flagged and verdict = 'REAL' and coalesce(error, '') = ''")
    return rows.agg(
        F.count("*").alias("clauses"), F.count_if("flagged").alias("flagged"), F.count_if(real).alias("real"), F.count_if(F.expr("flagged and verdict = 'APPARENT'")).alias("apparent"), F.count_if(F.expr("flagged and verdict = 'WEAK'")).alias("weak"),
        F.count_if(F.expr("critique_verdict = 'CONFIRMED'")).alias("confirmed"), F.count_if(F.expr("critique_verdict = 'REJECTED'")).alias("rejected"), F.count_if(F.expr("critique_verdict = 'CONFIRMED' and severity_tier = 'high'")).alias("high"),
        F.count_if(F.expr("critique_verdict = 'CONFIRMED' and severity_tier = 'medium'")).alias("medium"), F.count_if(F.expr("critique_verdict = 'CONFIRMED' and severity_tier = 'low'")).alias("low"),
    )


def _tag(name: str, css: str | Column, *inside: Column) -> Column:
    """An element whose class is constant or computed."""
    open_ = F.concat(F.lit(f"<{name} class='"), css if isinstance(css, Column) else F.lit(css), F.lit("'>"))
    return F.concat(open_, *inside, F.lit(f"</{name}>"))


def _maybe(held: Column, html: Column) -> Column:
    return F.when(F.coalesce(held, F.lit("")) != "", html).otherwise("")


def flag_html(rows: DataFrame) -> DataFrame:
    """``(flag_id, html)``: each flag with what is known of it: place, commitments and questions, verdict, critique, severity."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    said = lambda c: html_escape(have(c))
    field = lambda c, f: F.concat(F.lit(f"<li>{f}: "), _tag("span", sentinel_class(c[f]), html_escape(c[f])), F.lit("</li>"))
    asked = lambda c: F.coalesce(c["missing_info"], F.array().cast("array<string>"))
    listed = lambda c: F.when(F.size(asked(c)) > 0, F.concat(F.lit("<ul class='questions'>"), F.array_join(F.transform(asked(c), lambda q: F.concat(F.lit("<li>"), html_escape(q), F.lit("</li>"))), ""), F.lit("</ul>"))).otherwise("")
    each = F.transform("commitments", lambda c: F.concat(F.lit("<p>"), html_escape(c["obligation"]), F.lit("</p><ul>"), field(c, "quantity"), field(c, "method"), field(c, "standard"), F.lit("</ul>"), listed(c)))
    path = F.substring(F.array_join("section_path", " > "), 1, 80) if "section_path" in rows.columns else F.lit("")
    meta = _tag("div", "meta", F.concat_ws(" &middot; ", _maybe(have("verdict"), _tag("span", F.lower(have("verdict")), said("verdict"))), _maybe(have("critique_verdict"), _tag("span", F.lower(have("critique_verdict")), said("critique_verdict"))), F.when(F.coalesce(have("severity_tier"), F.lit("n/a")) != "n/a", _tag("span", have("severity_tier"), F.format_string("severity %s/10 (%s)", have("composite_severity").cast("string"), have("severity_tier")))), said("doc_id"), F.concat(F.lit("page "), have("page").cast("string")), html_escape(path)))
    failed = F.coalesce(have("error"), F.lit("")) != ""
    verdict = F.when(failed, _tag("div", "stage2", F.lit("Judgement failed: "), html_escape(F.substring(have("error"), 1, 200)))).otherwise(_maybe(have("verdict"), _tag("div", "stage2", _maybe(have("resolving_clause_id"), F.concat(F.lit("Resolved by "), said("resolving_clause_id"), F.lit(". "))), F.coalesce(said("rationale"), F.lit("")))))
    rated = F.lit("")
    if "severity" in rows.columns:
        s = F.col("severity")
        rated = F.when(s.isNotNull(), F.concat(F.format_string(" Commercial %d/5, dispute %d/5, reviewer cost %d/5. ", s["commercial_exposure"], s["dispute_likelihood"], s["reviewer_cost"]), F.coalesce(html_escape(s["rationale"]), F.lit("")))).otherwise("")
    critique = _maybe(have("critique_verdict"), _tag("div", "stage3", F.coalesce(said("critique_refutation"), F.lit("")), rated))
    body = _tag("section", "flag", F.lit("<h3>"), html_escape(F.col("clause_id")), F.lit("</h3>"), meta, F.lit("<blockquote>"), html_escape(F.btrim("clause_text")), F.lit("</blockquote>"), F.array_join(F.coalesce(each, F.array().cast("array<string>")), ""), F.coalesce(verdict, F.lit("")), F.coalesce(critique, F.lit("")))
    return rows.select("flag_id", body.alias("html"))


def question_html(asked: DataFrame) -> DataFrame:
    """One list item a question, in the order of ``asked``."""
    where = html_escape(F.substring(F.array_join("section_path", " > "), 1, 80))
    chip = F.when(F.coalesce("severity_tier", F.lit("")) != "", F.format_string(" <span class='%s'>%s (%d/10)</span>", "severity_tier", "severity_tier", "composite_severity")).otherwise("")
    return asked.select(F.concat(F.lit("<li><b>Re. clause <code>"), html_escape(F.col("clause_id")), F.lit("</code></b>"), chip, F.lit(" ("), where, F.lit("): "), html_escape(F.col("question")), F.lit("</li>")).alias("html"))


def open_questions(flags: DataFrame, verdicts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Questions of confirmed flags; before any is confirmed, those of real ones, in order of the flags and without a severity."""
    if not confirmed.filter("critique_verdict = 'CONFIRMED'").isEmpty():
        return questions(flags, confirmed)
    real = verdicts.filter("verdict = 'REAL' and coalesce(error, '') = ''").select("flag_id", F.lit("CONFIRMED").alias("critique_verdict"), F.lit(0).alias("composite_severity"), F.lit("").alias("severity_tier"), "ord")
    return questions(flags, real)


def sectioned(rows: DataFrame) -> DataFrame:
    """``rows`` with ``section``, one of SECTIONS or null for flags that are in none."""
    reviewed = F.max(F.when(F.col("critique_verdict").isin("CONFIRMED", "REJECTED"), 1).otherwise(0)).alias("reviewed")
    known = rows.join(F.broadcast(rows.agg(reviewed)), F.lit(True))
    real = F.expr("flagged and verdict = 'REAL' and coalesce(error, '') = ''")
    section = F.when(real & (F.col("critique_verdict") == "CONFIRMED"), "confirmed").when(real & (F.col("critique_verdict") == "REJECTED"), "rejected").when(real & (F.coalesce("reviewed", F.lit(0)) == 0), "unreviewed").when(F.expr("flagged and verdict = 'APPARENT'"), "apparent").when(F.expr("flagged and verdict = 'WEAK'"), "weak")
    return known.withColumn("section", section).drop("reviewed")


def table_html(rows: DataFrame, title: str) -> str:
    """A small table, such as the ablation's rungs, as HTML."""
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(html_escape(F.col(c).cast("string")), F.lit("")), F.lit("</td>")) for c in rows.columns], F.lit("</tr>"))
    body = "".join(r["html"] for r in rows.select(cells.alias("html")).collect())
    head = "".join(f"<th>{c}</th>" for c in rows.columns)
    return f"<h2>{title}</h2><table><tr>{head}</tr>{body}</table>"


def render(tender_id: str, flags: DataFrame, verdicts: DataFrame, confirmed: DataFrame, runs: DataFrame | None = None, evaluation: DataFrame | None = None, rewrites: DataFrame | None = None) -> str:
    """The whole report of one tender as a self-contained page.

    ``runs`` adds what the calls cost, ``evaluation`` a table of metrics, ``rewrites`` the accepted texts.
    """
    last = lambda df, *cols: df.groupBy("flag_id").agg(*[F.max_by(c, "ord").alias(c) for c in cols if c in df.columns])
    rows = report_rows(flags, verdicts, confirmed)
    for df, cols in ((verdicts, ("rationale", "resolving_clause_id", "confidence")), (confirmed, ("critique_refutation", "severity"))):
        rows = rows.join(last(df, *cols), "flag_id", "left")
    rows = sectioned(rows)
    head = cards(rows).first().asDict()
    asked = [r["html"] for r in question_html(open_questions(flags, verdicts, confirmed)).collect()]
    counts = "".join(f"<div class='card {k}'><b>{v}</b> {k}</div>" for k, v in (head | {"questions": len(asked)}).items())
    letter = f"<h2>Pre-bid questions</h2><ol>{''.join(asked)}</ol>" if asked else ""
    shown = rows.filter("section is not null")
    html = shown.select("flag_id", "section", "composite_severity", "ord").join(flag_html(shown), "flag_id").orderBy(F.desc_nulls_last("composite_severity"), "ord").select("section", "html").collect()
    parts = [f"<h2>{title}</h2>{''.join(r['html'] for r in html if r['section'] == name)}" for name, title in SECTIONS if any(r["section"] == name for r in html)]
    if rewrites is not None:
        done = rewrites.filter("status = 'ACCEPTED'").orderBy("flag_id").select(F.concat(F.lit("<li><code>"), html_escape(F.col("clause_id")), F.lit("</code>: "), html_escape(F.col("rewrite_text")), F.lit("</li>")).alias("html")).collect()
        parts.append(f"<h2>Accepted rewrites</h2><ol>{''.join(r['html'] for r in done)}</ol>" if done else "")
    if evaluation is not None:
        parts.append(table_html(evaluation, "Evaluation"))
    spent = ""
    if runs is not None:
        total = runs.agg(F.coalesce(F.sum("api_calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("cost_inr"), F.lit(0.0)).alias("inr")).first()
        spent = f"<p class='meta'>{total['calls']} calls, INR {total['inr']:.4f}</p>"
    name = reduce(lambda t, p: t.replace(*p), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), tender_id)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{name}</title><style>{_STYLE}</style></head><body><h1>Ambiguity report {name}</h1>{counts}{spent}{letter}{''.join(parts)}</body></html>"
