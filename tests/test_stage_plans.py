"""What the stages' plans leave out: numbering again, texts and commitments that only figures ask for."""

import pytest
from pyspark.sql import functions as F

from clausewright.functions import rules
from clausewright.operators import stages
from clausewright.plans import queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["stage1_summary", "stage3_summary", "confirmed_flags", "inspected", "open_questions", "scope_totals"])
def test_clauses_are_numbered_once(spark, name):
    assert "Window" not in _plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_figures_of_flags_move_no_commitments(spark):
    rows = "clause_id string, doc_id string, ord int, is_obligation boolean, rationale string"
    asked = spark.createDataFrame([(f"d::{k}", "d", k, k != 3, None) for k in range(5)], rows)
    kind = "array<struct<obligation: string, quantity: string, method: string, standard: string, missing_info: array<string>>>"
    whole, open_ = ("o", "5", "m", "s", [" "]), ("o", "5", "m", "s", ["why?"])
    replies = spark.createDataFrame([("d::0", [whole]), ("d::1", [whole, open_]), ("d::2", None), ("d::3", [open_])], f"clause_id string, commitments {kind}")
    flags = stages.candidate_flags(asked, replies)
    assert "clause_text" not in flags.columns
    assert {r["clause_id"]: (r["flagged"], r["is_obligation"]) for r in flags.collect()} == {"d::0": (False, True), "d::1": (True, True), "d::2": (False, False), "d::3": (False, False), "d::4": (False, False)}
    moved = [line for line in _plan(stages.stage1_summary(flags)).split("\n") if "Exchange" in line or "Join" in line]
    after = _plan(stages.stage1_summary(flags)).split("Join")[0]  # what the plan does above its topmost join
    assert moved and "missing_info" not in after


def test_flag_without_its_reason(spark):
    kind = "array<struct<obligation: string, quantity: string, method: string, standard: string, missing_info: array<string>>>"
    full, none = ("o", "5", "m", "s", []), ("o", None, None, None, None)
    cases = [None, [], [full], [none], [full, ("o", "5", rules.UNKNOWN, "s", None)], [("o", "5", "m", "s", ["q"])], [None]]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, commitments {kind}")
    got = rows.select("k", rules.is_flagged(F.col("commitments")).alias("f"), rules.evaluate_flag(F.col("commitments"))["flagged"].alias("g")).orderBy("k").collect()
    assert [(r["f"], r["g"]) for r in got] == [(x, x) for x in (False, False, False, False, True, True, False)]
