"""What the extractors' plans leave out: second searches, joins and shuffles."""

from pyspark.sql import functions as F

from clausewright.operators import citations, lexicon, quantities, references


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_markers_are_sought_once(spark):
    rows = spark.createDataFrame([("c", "d", "t", 1, "reasonable and adequate, some", "1")], "clause_id string, doc_id string, tender_id string, page int, text string, clause_number string").withColumn("section_path", F.array(F.lit("s")))
    plan = _plan(lexicon.by_category(lexicon.flags(rows)))
    assert plan.count("translate(lower(") == 1


def test_placed_references_need_no_join_for_their_document(spark):
    rows = spark.createDataFrame([("c1", "d", "see Clause 1.2", "1.1", 1), ("c2", "d", "x", "1.2", 2)], "clause_id string, doc_id string, text string, clause_number string, ord int")
    found = references.resolve(references.extract(rows, placed=True), rows)
    assert _plan(found).count("Join") == 1
    assert [(r["doc_id"], r["target_id"]) for r in found.collect()] == [("d", "c2")]


def test_citations_of_unique_texts_are_not_shuffled(spark):
    texts = ["IS 456:2000 Section 3.1 then IS 456:2000 section 3.1, IS 10 (Part 2)", "CPWD Vol2 and IS 456", "CPWD Works Manual: 2019 Vol. 2", "this is not one", "ı IS 5 é", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = citations.extract(rows, unique=True)
    assert "Exchange" not in _plan(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, citations.extract(rows).collect())) and got.count() == 6


def test_spans_of_quantities_in_any_text():
    found = lambda t: [(t[h[0] : h[1]], h[3], h[4], h[5], h[6]) for h in quantities.found_in(t)]
    assert found("Rs. 1,500 LAKH  or\t5 MM") == [("Rs. 1,500 LAKH", "money", "1,500", "LAKH", "Rs. 1,500 LAKH or 5 MM"), ("5 MM", "dimension", "5", "MM", "Rs. 1,500 LAKH or 5 MM")]
    assert found("₹ 5 crore ± 2 mm") == [("₹ 5 crore", "money", "5", "crore", "₹ 5 crore ± 2 mm"), ("± 2 mm", "tolerance", "2", "mm", "₹ 5 crore ± 2 mm")]
    assert found("") == []
