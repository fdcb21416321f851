"""Headings and clause numbers are sought once, and no text moves with their places."""

from pyspark.sql import functions as F

from clausewright.operators import segment


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_move_without_texts(spark):
    texts = ["SECTION-1: Scope\n1.1 The party\n", "nothing here", "Annexure IV\nSECTION-2 x\nSection II é", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = segment.hits(rows, ["k"], [segment._LINES_ANY_CASE + p for p, _ in segment.SECTIONS])
    assert "gap" not in found.columns
    moved = [line for line in _plan(found.select("k", "start")).split("\n") if "Sort [" in line or "Window [" in line]
    assert moved and not any("length(gap" in line for line in moved)
    got = {(r["k"], r["pattern"], r["hit"], r["start"], r["raw"], r["number"]) for r in found.collect()}
    assert {(0, 0, 0, 0, "SECTION-1: Scope", "1"), (2, 1, 0, 0, "Annexure IV", "IV"), (2, 0, 0, 12, "SECTION-2 x", "2"), (2, 0, 1, 24, "Section II é", "II")} == got


def test_patterns_are_not_sought_again(spark, monkeypatch):
    rows = [("d", "t", 1, "SECTION-1: Scope of the works\n1.1 The party shall deliver all goods in time.\n", False), ("d", "t", 2, "(a) And it shall pay for all of them as well.\n", False)]
    pages = spark.createDataFrame(rows, "doc_id string, tender_id string, page_number int, text string, ocr_was_used boolean")
    searches = []
    real = segment.stage

    def counted(df, name):
        searches.append((name, "regexp_extract_all" in _plan(df)))
        return real(df, name)

    monkeypatch.setattr(segment, "stage", counted)
    got = segment.clauses(pages)
    assert "regexp_extract_all" not in _plan(got) and [n for n, sought in searches if sought] == ["segment-headings", "segment-numbers"]
    assert [(r["clause_number"], r["page"]) for r in got.orderBy("ord").collect()] == [("1.1", 1), ("a", 2)]
