"""Figures that are counted while tables are written."""

import hashlib

import pytest
from pyspark.sql import functions as F

from clausewright.operators import references, rollups, stages
from clausewright.plans import extraction, pipeline
from clausewright.sources import sinks
from clausewright.sources.observed import figures_of, observed, one_row


def test_figures_equal_a_second_pass(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k.x"), F.create_map(F.lit("a"), F.col("id")).alias("m"), F.when(F.col("id") % 3 == 0, "t").alias("t"))
    held, seen = observed(df, "x", F.count_if(F.col("id") % 2 == 0).alias("even"), F.count("t").alias("t"))
    assert (seen["rows"], seen["even"], seen["t"]) == (1000, 500, 334) and held.count() == 1000
    other = observed(df.repartition(5).orderBy(F.rand(1)), "x")[1]
    assert other["fingerprint"] == seen["fingerprint"]
    assert observed(df.union(df.limit(1)), "x")[1]["fingerprint"] != seen["fingerprint"]
    assert observed(df.withColumn("t", F.lit("u")), "x")[1]["fingerprint"] != seen["fingerprint"]


@pytest.mark.parametrize("rows", [0, 1])
def test_small_tables(spark, rows):
    _, seen = observed(spark.range(rows), "x", F.count_if(F.col("id") == 0).alias("n"))
    assert seen["rows"] == rows and (seen.get("n") or 0) == rows
    assert (seen["fingerprint"] == "0" * 16) == (rows == 0)


def test_a_failing_write_fails(spark):
    with pytest.raises(ZeroDivisionError):
        figures_of(spark.range(3), lambda told: 1 // 0)


CLAUSES = [("d::1", "d", "T", 1, 0, "1.1", ["Section 1"], 'The "Works" means the construction of the road by the party. Within 30 days as per Clause 1.2 and Annexure B.', False), ("d::2", "d", "T", 1, 1, "1.2", ["Section 1"], "See Clause 9.9 and IS 456:2000; 5 mm twice, 3 times per week.", False)]


def test_extraction_counts_what_tables_hold(spark):
    clauses = spark.createDataFrame(CLAUSES, "clause_id string, doc_id string, tender_id string, page int, ord int, clause_number string, section_path array<string>, text string, table_origin boolean")
    told = lambda q: q.filter("kind = 'frequency'").selectExpr("quantity_id", "'Cube test frequency' as referent", "0.5 as confidence")
    held, figures = extraction.tables(clauses, referents=told)
    again = rollups.extract_summary(clauses, held["definitions"], held["quantities"], held["references"], references.nodes(held["references"], clauses), references.edges(held["references"])).first().asDict()
    assert {"clauses_loaded": 2} | figures == again
    assert figures["quantities_referent_classified"] == 1 and held["quantities"].filter("referent_method = 'llm'").first()["referent"] == "cube_test_frequency"
    assert figures["references_resolved_internal"] == 1 and figures["definitions_extracted"] == 1
    some, less = extraction.tables(clauses, with_quantities=False, with_references=False)
    assert set(some) == {"definitions"} and set(less) == {"definitions_extracted"}


def test_a_run_counts_its_stages(spark):
    pages = spark.createDataFrame([("d", "T", 1, "1.1 The Contractor shall place 5 mm of cement within 30 days as directed.\n1.2 The party shall report weekly on the progress of all of the works.", False)], "doc_id string, tender_id string, page_number int, text string, ocr_was_used boolean")
    text = lambda v: F.lit(v)
    given = pipeline.Providers(verdicts=lambda rows: rows.select("flag_id", text("REAL").alias("verdict"), text(None).cast("string").alias("resolving_clause_id"), text("r").alias("rationale"), text(0.5).alias("confidence"), text(None).cast("string").alias("error")))
    figures: dict = {}
    out = pipeline.run(pages, given=given, figures=figures)
    row = one_row(spark, rollups.rollup_figures(figures)).first().asDict()
    assert row["parse_clauses"] == out["clauses"].count() == 2 and row["score_eligible"] == stages.eligibility_counts(out["clauses"]).first()["eligible"]
    assert row["score_flagged"] == out["candidate_flags"].filter("flagged").count() == row["critique_real"] and row["confirm_confirmed"] is None
    assert row["extract_quantities"] == out["quantities"].count()


def test_records_of_files_and_folders(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("one\ntwo\n")
    (tmp_path / "in/y.txt").write_text("three\n")
    run = sinks.start_run("T", "s")
    for name in ("a.txt", "in", "none"):
        sinks.record(spark, run, str(tmp_path / name))
    one, two, none = run["inputs"]
    assert one["sha256"] == hashlib.sha256(b"one\ntwo\n").hexdigest() and (one["files"], one["size_bytes"]) == (1, 8)
    assert two["sha256"] is None and (two["files"], two["size_bytes"]) == (2, 14) and two["fingerprint"] != one["fingerprint"]
    assert list(none) == ["path"]
    (tmp_path / "in/x.txt").rename(tmp_path / "in/z.txt")
    sinks.record(spark, run, str(tmp_path / "in"))
    assert run["inputs"][-1]["fingerprint"] == two["fingerprint"]
    monkeypatch.setattr(sinks, "HASHED_WHOLE", 4)  # larger files by their lines
    sinks.record(spark, run, str(tmp_path / "in"))
    (tmp_path / "in/y.txt").write_text("thre3\n")
    sinks.record(spark, run, str(tmp_path / "in"))
    assert run["inputs"][-1]["fingerprint"] != run["inputs"][-2]["fingerprint"] and run["inputs"][-2]["sha256"] is None
    _, seen = observed(spark.range(5), "x")
    sinks.record(spark, run, str(tmp_path / "in"), "outputs", seen)
    assert run["outputs"][0]["line_count"] == 5 and run["outputs"][0]["fingerprint"] == seen["fingerprint"]


def test_providers_are_asked_once(spark):
    """Nothing is computed a second time for its figures."""
    asked = spark.sparkContext.accumulator(0)

    def slow(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    rows = spark.range(50).mapInArrow(slow, "id bigint")
    held, seen = observed(rows, "x", F.max("id").alias("most"))
    assert held.count() == 50 and seen["most"] == 49 and asked.value == 50
