import math
import random

import pytest
from pyspark.sql import functions as F

from clausewright.functions import rules
from clausewright.operators import metrics, retrieve, stages
from clausewright.schemas import COMMITMENTS

U = rules.UNKNOWN


def evaluate(spark, commitments):
    row = spark.createDataFrame([(commitments,)], f"c {COMMITMENTS}").select(rules.evaluate_flag(F.col("c")).alias("v"), rules.unknown_count(F.col("c")).alias("n")).first()
    return row["v"]["flagged"], row["v"]["reason"], row["n"]


def test_flag_rule(spark):
    full = ("pay", "5%", "bank", "IS 1", [])
    assert evaluate(spark, [full])[:2] == (False, "all commitments specify quantity, method, and standard")
    assert evaluate(spark, []) == (False, "no commitments extracted (clause has no actionable obligation)", 0)
    assert evaluate(spark, None)[0] is False
    assert evaluate(spark, [("pay", U, "m", U, ["how?", "why?"])]) == (True, "obligation 'pay': quantity, standard, missing_info(2 questions)", 2)
    assert evaluate(spark, [("pay", "1", "m", "s", ["how?"])])[0] is True
    flagged, reason, n = evaluate(spark, [(f"o{k}", U, "m", "s", []) for k in range(7)])
    assert flagged and n == 7 and reason.endswith("(+4 more)") and reason.count("obligation") == 3


def test_normalised_commitments(spark):
    raw = [(" o ", "", " m ", None, [" q ", " "]), ("p", "  ", "m", "s", None)]
    got = spark.createDataFrame([(raw,)], f"c {COMMITMENTS}").select(rules.normalise_commitments(F.col("c")).alias("v")).first()["v"]
    assert [tuple(c) for c in got] == [("o", U, "m", U, ["q"]), ("p", "", "m", "s", [])]


@pytest.mark.parametrize("composite,tier", [(10, "high"), (8, "high"), (7, "medium"), (5, "medium"), (4, "low"), (2, "low"), (1, "n/a"), (0, "n/a")])
def test_tiers(spark, composite, tier):
    assert spark.range(1).select(rules.severity_tier(F.lit(composite)).alias("t")).first()["t"] == tier


@pytest.mark.parametrize("model,usd", [("gemini-2.5-flash", 0.375), ("models/gemini-2.5-pro-x", 6.25), ("gemini-2.5-flash-lite", 0.19), ("gemini", 0.375), ("other", 0.0)])
def test_costs(spark, model, usd):
    assert spark.range(1).select(rules.cost_usd(F.lit(model), F.lit(1_000_000), F.lit(1_000_000)).alias("c")).first()["c"] == pytest.approx(usd)


def test_small_rules(spark):
    row = spark.range(1).select(rules.sentinel_class(F.lit(U)).alias("a"), rules.sentinel_class(F.lit("CONTRACT_DEFINED")).alias("b"), rules.sentinel_class(F.lit("x")).alias("c"), rules.is_quota_error(F.lit("Too Many Requests")).alias("d"), rules.is_transient_error(F.lit("deadline")).alias("e"), rules.is_transient_error(F.lit(None).cast("string")).alias("f"), rules.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("g")).first()
    assert tuple(row) == ("cannot", "contract", "set", True, True, False, 0.0)


CLAUSES = "clause_id string, doc_id string, tender_id string, page int, section_path array<string>, clause_number string, text string, char_count int, table_origin boolean, ord int"


def clause_rows(spark, rows):
    return spark.createDataFrame([(f"d::{k}", "d", "T", 1, ["S"], None, t, len(t), tab, k) for k, (t, tab) in enumerate(rows)], CLAUSES)


def test_stage_1(spark):
    c = clause_rows(spark, [("The party shall do something about the works here.", False), ("row " * 20, True), ("tiny", False), ("A heading without any duty, but long enough to be asked about.", False), ("Another duty whose call has failed, of sufficient length.", False)])
    assert stages.eligibility_counts(c).first().asDict() == {"clauses_loaded": 5, "skipped_tables": 1, "skipped_tiny": 1, "eligible": 3}
    checks = spark.createDataFrame([("d::3", False, "heading")], "clause_id string, is_obligation boolean, rationale string")
    asked = stages.obligations(stages.eligible(c), checks)
    replies = spark.createDataFrame([("d::0", [("o", None, "m", "s", [])]), ("d::3", [("o", None, "m", "s", [])])], f"clause_id string, commitments {COMMITMENTS}")
    flags = stages.candidate_flags(asked, replies)
    got = {r["flag_id"]: (r["flagged"], r["is_obligation"], r["skipped_reason"], r["flag_reason"]) for r in flags.collect()}
    assert got == {"d::flag::0": (True, True, None, "obligation 'o': quantity"), "d::flag::3": (False, False, "heading", "not an obligation"), "d::flag::4": (False, False, "obligation filter said no", "not an obligation")}
    assert stages.stage1_summary(flags).first().asDict() == {"records": 3, "bct_calls": 1, "flagged": 1, "not_flagged": 0, "non_obligation_records": 2}
    assert stages.eligible(c, most=1).count() == 1 and stages.obligations(c, None).filter("is_obligation").count() == 5


def test_stages_2_and_3(spark):
    c = clause_rows(spark, [("x" * 50, False)] * 5)
    flags = stages.candidate_flags(stages.obligations(c, None), c.select("clause_id", F.lit(None).cast(COMMITMENTS).alias("commitments")))
    flags = flags.withColumn("flagged", F.lit(True)).withColumn("commitments", F.array(F.struct(F.lit("o").alias("obligation"), F.lit("q").alias("quantity"), F.lit("m").alias("method"), F.lit("s").alias("standard"), F.array(F.lit("How?"), F.lit(" how? ")).alias("missing_info"))))
    said = spark.createDataFrame([("d::flag::0", "REAL", None), ("d::flag::1", "APPARENT", None), ("d::flag::2", "other", None), ("d::flag::3", "REAL", "boom")], "flag_id string, verdict string, error string").selectExpr("*", "cast(null as string) as resolving_clause_id", "'why' as rationale", "0.5 as confidence")
    found = stages.verdicts(flags, said)
    assert {r["flag_id"][-1]: (r["verdict"], r["error"]) for r in found.collect()} == {"0": ("REAL", None), "1": ("APPARENT", None), "2": ("REAL", None), "3": ("REAL", "boom"), "4": ("REAL", "no reply")}
    assert stages.verdict_counts(found).first()["real"] == 4 and stages.real(found).count() == 2
    critiques = spark.createDataFrame([(f"d::flag::{k}", v, "r", "") for k, v in enumerate(["CONFIRMED", "CONFIRMED", "REJECTED", "CONFIRMED"])], "flag_id string, verdict string, refutation string, resolving_clause_id string")
    severities = spark.createDataFrame([(f"d::flag::{k}", 4, 4, 1, "") for k in range(5)], "flag_id string, commercial_exposure int, dispute_likelihood int, reviewer_cost int, rationale string")
    rows = stages.confirmed(found, flags, critiques, severities)
    assert {r["flag_id"][-1]: (r["critique_verdict"], r["severity_tier"], r["composite_severity"]) for r in rows.collect()} == {"0": ("CONFIRMED", "high", 8), "1": (None, "n/a", 0), "2": ("REJECTED", "n/a", 0), "3": (None, "n/a", 0), "4": (None, "n/a", 0)}
    summary = stages.stage3_summary(rows).first()
    assert (summary["critiqued"], summary["rejected"], summary["tier_high"], summary["rejection_rate"]) == (2, 1, 1, 0.5)
    assert stages.rewrite_candidates(rows, flags, tier="high").count() == 1 and stages.rewrite_candidates(rows, flags, tier="low").count() == 0
    assert [r["question"] for r in stages.questions(flags, rows).collect()] == ["How?"]
    assert stages.report_rows(flags, found, rows).filter("critique_verdict = 'CONFIRMED'").count() == 1


def attempt(flag, n, resolved=1, unresolved=0, before=3, after=2, v=(1.0, 0.0), w=(1.0, 0.0), error=None):
    one = lambda k: [("o", U, "m", "s", [])] * k
    return (flag, n, resolved, unresolved, one(before), one(after), v and list(v), w and list(w), error)


def test_stage_4(spark):
    rows = [
        attempt("pass", 1), attempt("retry", 1, resolved=0), attempt("retry", 2), attempt("worse", 1, after=6), attempt("worse", 2, after=6), attempt("worse", 3, after=6), attempt("far", 1, w=(0.0, 1.0)),
        attempt("skip", 1, v=None, w=None), attempt("error", 1, resolved=0), attempt("error", 2, error="down"), attempt("unresolved", 1, unresolved=1),
    ]
    df = spark.createDataFrame(rows, f"flag_id string, attempt int, resolved_count int, unresolved_count int, commitments {COMMITMENTS}, rewrite_commitments {COMMITMENTS}, vector array<double>, rewrite_vector array<double>, error string")
    done = stages.rewrite_status(stages.guardrails(df))
    got = {r["flag_id"]: (r["status"], r["attempts"], r["g3"]) for r in done.collect()}
    assert got == {"pass": ("ACCEPTED", 1, True), "retry": ("ACCEPTED", 2, True), "worse": ("RETRY_LIMIT_REACHED", 3, True), "far": ("PASSED_GUARDRAILS_FAILED", 1, False), "skip": ("ACCEPTED", 1, None), "error": ("ERROR", 2, True), "unresolved": ("PASSED_GUARDRAILS_FAILED", 1, True)}
    counts = {r["status"]: (r["rewrites"], r["g3_passed"]) for r in stages.status_counts(done).collect()}
    assert counts["ACCEPTED"] == (3, 2) and counts["REJECTED"] == (0, 0)


def test_formats(spark):
    c = [("do it", U, "m", U, ["a?", "b?"]), ("fine", "1", "m", "s", [])]
    got = spark.createDataFrame([(c,)], f"c {COMMITMENTS}").select(stages.findings(F.col("c"), 1).alias("v")).first()["v"]
    assert got == "  Commitment 1: do it\n    missing: quantity, standard\n    bidder_q: a?\n  Commitment 2: fine"
    chunks = spark.createDataFrame([([("IS 1", "4", 2, "a\nb" * 3)],)], "c array<struct<code_id: string, section: string, page: int, text: string>>")
    assert chunks.select(stages.context_block(F.col("c"), 4).alias("v")).first()["v"] == "  [1] IS 1  Section 4  (page 2)\n      a ba ..."


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "clause_id string")


def test_ablation(spark):
    universe, truth = ids(spark, [f"c{k}" for k in range(1, 11)]), ids(spark, [f"c{k}" for k in range(1, 6)])
    marked = lambda names, flag: ids(spark, [f"c{k}" for k in names]).selectExpr("clause_id", flag)
    rows = metrics.ablation(universe, truth, marked([2, 5, 7], "true as flagged"), marked([1, 2, 3, 4, 6], "true as flagged"), marked([1, 2, 4, 6], "'REAL' as verdict"), marked([1, 2, 4], "'CONFIRMED' as critique_verdict"))
    got = {r["rung"][:2]: (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"]) for r in rows.collect()}
    assert got == {"A0": (5, 5, 0, 0, 0.5), "A1": (2, 1, 3, 4, 0.6667), "A2": (4, 1, 1, 4, 0.8), "A3": (3, 1, 2, 4, 0.75), "A4": (3, 0, 2, 5, 1.0)}
    empty = metrics.confusion(ids(spark, []), ids(spark, []), ids(spark, []).selectExpr("'x' as rung", "clause_id"), ("x",)).first()
    assert (empty["precision"], empty["accuracy"], empty["tn"]) == (0.0, 0.0, 0)


def test_ladder_of_the_published_set(spark):
    """Counts of the published evaluation: universe 26, truth 13, rungs 26, 11, 18, 11 and 3."""
    u = [f"c{k}" for k in range(26)]
    sets = {"A1": u[:11], "A2": u[:11] + u[13:20], "A3": u[:7] + u[13:17], "A4": u[:3]}
    rows = None
    for name, s in {"A0": u, **sets}.items():
        part = ids(spark, s).selectExpr(f"'{name}' as rung", "clause_id")
        rows = part if rows is None else rows.unionByName(part)
    got = {r["rung"]: (r["precision"], r["recall"], r["f1"], r["accuracy"]) for r in metrics.confusion(ids(spark, u), ids(spark, u[:13]), rows).collect()}
    assert got == {"A0": (0.5, 1.0, 0.6667, 0.5), "A1": (1.0, 0.8462, 0.9167, 0.9231), "A2": (0.6111, 0.8462, 0.7097, 0.6538), "A3": (0.6364, 0.5385, 0.5833, 0.6154), "A4": (1.0, 0.2308, 0.375, 0.6154)}


@pytest.mark.parametrize("cells,expected", [((9, 9, 2, 6), 0.2011), ((0, 0, 0, 0), 0.0), ((5, 0, 0, 0), 1.0), ((5, 0, 0, 5), 1.0)])
def test_kappa(spark, cells, expected):
    assert spark.range(1).select(F.bround(metrics.kappa(*map(F.lit, cells)), 4).alias("k")).first()["k"] == expected


def route(spark, rows):
    return spark.createDataFrame([("f", c, s, k + 1) for k, (c, s) in enumerate(rows)], "flag_id string, clause_id string, score double, rank int")


def test_fusion(spark):
    got = retrieve.fuse({"R1_dense": route(spark, [("c", 0.9)]), "R2_defined_term": route(spark, [("c", 2.0)])}).collect()
    assert [(r["clause_id"], r["rrf_score"], r["rank"], r["sources"]) for r in got] == [("c", round(2 / 61, 6), 1, ["R1_dense", "R2_defined_term"])]
    tied = retrieve.fuse({"R3_referent": route(spark, [("a", 1.0)]), "R1_dense": route(spark, [("z", 1.0), ("y", 0.5)])}, top=2).collect()
    assert [r["clause_id"] for r in sorted(tied, key=lambda r: r["rank"])] == ["z", "a"]


def test_shared_terms_and_referents(spark):
    c = clause_rows(spark, [("the Works and the Contractor", False), ("works only", False), ("a contractor", False), ("nothing", False)])
    flags = spark.createDataFrame([("f", "d::0")], "flag_id string, clause_id string")
    terms = spark.createDataFrame([("Works",), ("Contractor",), ("",)], "canonical_form string")
    assert {r["clause_id"]: (r["score"], r["rank"]) for r in retrieve.shared_terms(flags, c, terms).collect()} == {"d::1": (1.0, 1), "d::2": (1.0, 2)}
    q = spark.createDataFrame([("d::0", "period"), ("d::0", "period"), ("d::1", "period"), ("d::1", "period"), ("d::2", "other"), ("d::0", "UNCLASSIFIED"), ("d::3", "UNCLASSIFIED"), ("gone", "period"), ("gone", "period"), ("gone", "period")], "clause_id string, referent string")
    got = {r["clause_id"]: (r["score"], r["rank"]) for r in retrieve.shared_referents(flags, q, c).collect()}
    assert got == {"d::1": (2.0, 2)}


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(60)] + [(60, [0.0] * 5), (61, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = retrieve.nearest(df.filter("id % 5 = 0").select(F.col("id").alias("query_id"), "vector"), df, 4).collect()
    for q, v in rows:
        if q % 5 == 0:
            brute = sorted(rows, key=lambda r: (math.dist(v, r[1]), r[0]))[:4]
            assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [r[0] for r in brute]


def test_dense_drops_the_own_clause_after_ranking(spark):
    v = spark.createDataFrame([("d::0", [0.0]), ("d::1", [1.0]), ("d::2", [5.0])], "clause_id string, vector array<double>")
    flags = spark.createDataFrame([("f", "d::0")], "flag_id string, clause_id string")
    got = retrieve.dense(flags, spark.createDataFrame([("f", [0.0])], "flag_id string, vector array<double>"), v, 2).collect()
    assert [(r["clause_id"], r["rank"], r["score"]) for r in got] == [("d::1", 1, 0.5)]


def test_manifest_validation(spark):
    m = spark.createDataFrame([("a", 5, "x"), ("b", 0, "y"), ("c", 7, ""), ("gone", 1, "z")], "filename string, file_size_bytes bigint, sha256 string")
    d = spark.createDataFrame([("a", 6, "x"), ("b", 9, "q"), ("c", 7, "w"), ("new", 1, "z")], "filename string, file_size_bytes bigint, sha256 string")
    assert {(r["filename"], r["issue"]) for r in stages.validate_manifest(m, d).collect()} == {("a", "size_mismatch"), ("b", "sha_mismatch"), ("gone", "missing"), ("new", "extra")}


def test_samples_and_scope(spark):
    c = clause_rows(spark, [(f"t{k}", False) for k in range(20)])
    one, two = ([r["clause_id"] for r in stages.sample(c, 5, "clause_id", 3).collect()] for _ in range(2))
    assert one == two and len(one) == 5 and one != [r["clause_id"] for r in stages.sample(c, 5, "clause_id", 4).collect()]
    assert stages.in_scope(c, " D ", 1, 1).count() == 20 and stages.in_scope(c, "d", 2, 9).count() == 0
