"""Evaluation: precision and recall, agreement, Cohen's kappa, the ablation ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNGS = ("A0_no_filter", "A1_lexicon", "A2_bct_stage1", "A3_bct_plus_stage2", "A4_bct_plus_stage3")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def scores(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Precision, recall, F1 and accuracy, rounded half-even to four digits; 0 for no cases."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    n = tp + fp + fn + tn
    return [F.bround(x, 4).alias(name) for name, x in (("precision", p), ("recall", r), ("f1", _ratio(2 * p * r, p + r)), ("accuracy", (tp + tn) / F.greatest(n, F.lit(1))))]


def _marked(universe: DataFrame, sets: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(clause_id, bits)`` of the universe: bit k is 1 if set k holds the id. One pass over all sets, merged by id and without a join."""
    bit = lambda df, k: df.select("clause_id", F.lit(1 << k).alias("bit"))
    rows = bit(universe, 0)
    for k, (_, df) in enumerate(sets):
        rows = rows.unionByName(bit(df.filter("clause_id is not null"), k + 1))
    return rows.groupBy("clause_id").agg(F.bit_or("bit").alias("bits")).filter(F.col("bits") % 2 == 1).select("clause_id", F.shiftright("bits", 1).alias("bits"))


def confusion(universe: DataFrame, truth: DataFrame, predicted: DataFrame, rungs: tuple[str, ...] | None = None) -> DataFrame:
    """Cells and scores by rung. ``universe`` and ``truth``: (clause_id); ``predicted``: (rung, clause_id).

    All sets are merged by id in one pass; what predictions miss follows from the totals. With ``rungs``, rungs
    without predictions appear too.
    """
    none = F.lit(None).cast("string")
    rows = universe.select("clause_id", F.lit(True).alias("u"), F.lit(False).alias("t"), none.alias("rung"))
    rows = rows.unionByName(truth.filter("clause_id is not null").select("clause_id", F.lit(False).alias("u"), F.lit(True).alias("t"), none.alias("rung")))
    rows = rows.unionByName(predicted.filter("clause_id is not null").select("clause_id", F.lit(False).alias("u"), F.lit(False).alias("t"), "rung"))
    known = rows.groupBy("clause_id").agg(F.bool_or("u").alias("u"), F.bool_or("t").alias("t"), F.collect_set("rung").alias("rungs")).filter("u")
    # a rung that is null counts the universe
    counted = known.select("t", F.explode(F.concat(F.array(none), "rungs")).alias("rung")).groupBy("rung").agg(F.count("*").alias("n"), F.count_if("t").alias("t"))
    wide = counted.agg(F.max(F.when(F.col("rung").isNull(), F.struct("n", "t"))).alias("all"), F.collect_list(F.when(F.col("rung").isNotNull(), F.struct("rung", "n", "t"))).alias("each"))  # a row for each rung
    if rungs is not None:
        of = lambda name: F.coalesce(F.get(F.filter("each", lambda e: e["rung"] == name), F.lit(0)), F.struct(F.lit(name).alias("rung"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("t")))
        wide = wide.withColumn("each", F.array(*map(of, rungs)))
    total = lambda f: F.coalesce(F.col(f"all.{f}"), F.lit(0))
    found = wide.select(total("n").alias("size"), total("t").alias("positives"), F.explode("each").alias("e"))
    tp, fp = F.col("e.t"), F.col("e.n") - F.col("e.t")
    cells = found.select(F.col("e.rung").alias("rung"), F.col("e.n").alias("predicted_positive"), tp.alias("tp"), fp.alias("fp"), (F.col("positives") - tp).alias("fn"), (F.col("size") - F.col("positives") - fp).alias("tn"))
    return cells.select("*", *scores(*map(F.col, ("tp", "fp", "fn", "tn"))))


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    n = both + only_a + only_b + neither
    a, b = (both + only_a) / n, (both + only_b) / n
    by_chance = a * b + (1 - a) * (1 - b)
    return F.when(n == 0, 0.0).when(by_chance == 1.0, 1.0).otherwise(((both + neither) / n - by_chance) / (1 - by_chance))


def agreement(universe: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both, only_a, only_b, neither and Cohen's kappa of two sets of clause ids."""
    rows = _marked(universe, [("a", a), ("b", b)])
    cells = rows.agg(*[F.count_if(F.col("bits") == k).alias(n) for k, n in ((3, "both"), (1, "only_a"), (2, "only_b"), (0, "neither"))])
    return cells.select("*", F.bround(kappa(*map(F.col, ("both", "only_a", "only_b", "neither"))), 4).alias("cohen_kappa"))


def set_sizes(universe: DataFrame, **sets: DataFrame) -> DataFrame:
    """``(bits, clauses)``: how many ids of the universe each combination of these sets has; bit k is the k-th set. Sizes,
    intersections, differences and complements of any of them are sums of these few rows."""
    return _marked(universe, list(sets.items())).groupBy("bits").agg(F.count("*").alias("clauses"))


def ablation(universe: DataFrame, truth: DataFrame, lexicon: DataFrame, flags: DataFrame, verdicts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The five rungs; each predicate is applied here: flagged, REAL, CONFIRMED."""
    sets = (universe, lexicon.filter("coalesce(flagged, false)"), flags.filter("coalesce(flagged, false)"), verdicts.filter("verdict = 'REAL'"), confirmed.filter("critique_verdict = 'CONFIRMED'"))
    rows = None
    for name, ids in zip(RUNGS, sets, strict=True):
        part = ids.select(F.lit(name).alias("rung"), "clause_id")
        rows = part if rows is None else rows.unionByName(part)
    return confusion(universe, truth, rows, RUNGS)


def observed(*tables: DataFrame) -> DataFrame:
    """The default universe: every clause id that any table has."""
    rows = tables[0].select("clause_id")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("clause_id"))
    return rows.distinct()


def format_table(rows: DataFrame) -> DataFrame:
    """Fixed-width lines, one a rung; scores of four digits are shown with three, halves up."""
    return rows.select("rung", F.format_string("%-22s%7d%5d%5d%5d%8.3f%8.3f%8.3f", "rung", "predicted_positive", "tp", "fp", "fn", "precision", "recall", "f1").alias("line"))


def labels_by_category(labels: DataFrame) -> DataFrame:
    return labels.filter("vague").groupBy("category").agg(F.count("*").alias("clauses"))


def vague_universe(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth and universe of hand-labelled clauses."""
    return labels.filter("vague").select("clause_id"), labels.select("clause_id").distinct()
