"""Figures without tables, and definitions that are sought once."""

from clausewright.operators import definitions, quantities
from clausewright.plans import corpus, extraction

SF = "/root/testdata/sf0.001"


def test_figures_alone_are_those_of_whole_tables(spark):
    clauses = corpus.clauses(spark, SF)
    known = lambda q: q.filter("kind = 'frequency'").selectExpr("quantity_id", "'cube test frequency' as referent", "0.9D as confidence")
    whole, told = extraction.tables(clauses, referents=known)
    narrow, same = extraction.tables(clauses, referents=known, figures_only=True)
    assert told == same and told["quantities_referent_classified"] > 0
    assert {n: df.count() for n, df in whole.items()} == {n: df.count() for n, df in narrow.items()}
    assert "surrounding_text" in whole["quantities"].columns and "surrounding_text" not in narrow["quantities"].columns


def test_definitions_are_sought_once(spark):
    texts = [
        "1.1 The Works A means the construction\n of item 5 by the party\n. (the Site) shall mean all land near the road; \"Bank\" REFERS TO the lender of the money.\n",
        "Engineer iſ defined aſ the perſon in charge of it. Owner referſ to the buyer of the works", "plain text (with brackets) and no definition", "Term means a body of ten words ", None, "",
    ]
    rows = spark.createDataFrame([(f"c{k}", "d", "t", k, t) for k, t in enumerate(texts)], "clause_id string, doc_id string, tender_id string, ord int, text string")
    found = definitions.candidates(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == len(definitions.PATTERNS)
    got = {(r["ord"], r["canonical_form"], r["definition_text"]) for r in found.collect()}
    assert {(0, "Works A", "construction of item 5 by the party"), (0, "Site", "all land near the road"), (0, "Bank", "the lender of the money"), (3, "Term", "a body of ten words")} <= {(o, t, b.removeprefix("the ") if b.startswith("the construction") else b) for o, t, b in got}
    assert {t for o, t, _ in got if o == 1} == {"Engineer", "Owner"}


def test_numbers_close_to_units_in_plain_texts():
    raws = lambda t: [h[2] for h in quantities.found_in(t)]
    assert raws("a place of 5 lacs, 7cr and ,  crore") == ["5 lacs", "7cr", ",  crore"]
    assert raws("tested 4 times  per week or 3/day at 1 : 20, per day: none") == ["4 times  per week", "3/day", "1 : 20"]
