"""Figures of a run without tables: every text is searched once, and clauses decide what they can."""

import random

from pyspark.sql import functions as F

from clausewright.functions.text import folded
from clausewright.operators import definitions, quantities, references
from clausewright.plans import extraction, queries
from clausewright.sources import observed

SF = "/root/testdata/sf0.001"
NUMBERS = "1 20 . , 1.5 1,500 1. .5 lakh Lakhs cr lacs % per cent percent PER day wk weeks mo months m min mm cm ft in inches h hrs times time / : + - ± ₹ Rs. INR USD million kg deg C a x é ٣ ſ K".split()
WORDS = "Clause Sub-Clause sub- clause section Section IS is IRC SP MoRTH CPWD Works Manual NBC Annex Annexure Appendix Schedule Drawing No. 1.2 1.2a 3 IV B X 456 : 2000 Part - : this , . x é ſ K".split()


TERMS = "The Works Site a (the Site) Bank 'Bank' \" ` shall mean means MEANS meaning refers to is defined as is meant to include this the expression the term 5 5.1 . ; , - / é ſ land near the road".split()


def _texts(words, seed, n, most=14):
    pick = random.Random(seed)
    return ["".join(pick.choice(words) + pick.choice(["", " ", " ", "\n"]) for _ in range(pick.randint(0, most))) for _ in range(n)]


def test_spans_are_those_of_all_searches():
    for text in _texts(NUMBERS, 1, 20_000):
        low, patterns = (text.lower(), quantities._LOW) if text.isascii() else (text, quantities._ANY)
        kept = []
        for place, p in enumerate(patterns):
            for m in p.finditer(low):
                if all(m.end() <= s or e <= m.start() for s, e, *_ in kept):
                    kept.append((*m.span(), place, m.groups()))
        assert [(s, e, place, m.groups()) for s, e, place, m in quantities.spans_in(text)] == kept, text


def test_references_of_ascii_texts_are_those_of_the_expressions(spark):
    texts = [t for t in _texts(WORDS, 2, 4000) if t.isascii()] + ["CPWD ", "NBC\t2016 MoRTH  5.1", "Sub-\nClause 1.2.3b", "isis 5 IS 5"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", references.sought(F.col("text"), folded(F.col("text"))).alias("r")).collect()
    assert sum(len(r["r"]) for r in rows) > 1000
    for text, found in rows:
        assert references.found_in(text) == [(r["target_kind"], r["target_label"]) for r in found], text


def test_definitions_of_ascii_texts_are_sought_near_their_verbs(spark):
    """A letter behind a stop at the end keeps a text from being cut and changes no match."""
    texts = [t for t in _texts(TERMS, 3, 12_000, 40) if t.isascii()] + ["5 Works means the construction of it", "Works. means the construction", "a'b means the great road", "\nThe expression Site\tmeans  all the land", "x (y) Works shall\nmean the bridge; Site is defined as the land"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("other", F.concat("text", F.lit(";é")))
    cut, whole = (F.transform(definitions.sought(F.col(c)), lambda d: F.struct(d["canonical_form"], d["definition_text"])) for c in ("text", "other"))
    found = rows.select("text", cut.alias("a"), whole.alias("b")).collect()
    assert sum(len(r["a"]) for r in found) > 500
    assert [(r["text"], r["a"], r["b"]) for r in found if r["a"] != r["b"]] == []


def test_figures_of_odd_clauses(spark):
    """Nulls, letters beyond ASCII, repeated numbers, targets beside references to clauses, more quantities than ids tell apart, several and unknown replies."""
    texts = [
        ("1.1", "See Clause 1.2, clause 1.2 and Clause 9.9, Section 3 and section 3."), ("1.2", "Annexure B und Clauſe 1.1, ſection 4 é 5 mm and IS 456:2000"), ("1.2", "Section 3 again, Section 3; . mm and .,. days"), (None, None), ("", ""),
        ("3", "The Works means the construction of the road. the works MEANS the construction again. (the Site) shall mean all land near the road"), ("4", "tested 3 times per week. " * 1005), ("5", "“Bank” referſ to the lender of the money; 3 times per day é"),
    ]
    rows = [(f"{d}::{k}", d, "T", 1, k, n, ["s"], t) for d in ("d", "e") for k, (n, t) in enumerate(texts)]
    clauses = spark.createDataFrame(rows, "clause_id string, doc_id string, tender_id string, page int, ord int, clause_number string, section_path array<string>, text string")

    def told(q):
        known = q.filter("kind = 'frequency'").selectExpr("quantity_id", "'Slump' as referent", "0.5D as confidence")
        return known.unionByName(known.filter("quantity_id like 'd::%'")).unionByName(spark.createDataFrame([("none::q000", "x", 0.5), ("q", None, None), (None, "x", 0.5)], "quantity_id string, referent string, confidence double"))

    whole, figures = extraction.tables(clauses, referents=told)
    narrow, loaded = extraction.figures_of_clauses(clauses, referents=told)
    assert loaded == {"clauses_loaded": 16} | figures
    assert figures["quantities_referent_classified"] > 2 * 1000 and figures["references_resolved_internal"] > 0 and figures["definitions_extracted"] >= 6
    for name, df in narrow.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, whole[name].select(*df.columns).collect())), name
    taken = clauses.withColumn("clause_id", F.when(F.col("clause_id") == "d::2", "external::section::Section 3").otherwise(F.col("clause_id")))
    assert extraction.figures_of_clauses(taken)[1]["graph_edges"] == extraction.tables(taken)[1]["graph_edges"] == loaded["graph_edges"] - 1
    none = clauses.filter("false")
    assert set(extraction.figures_of_clauses(none, referents=told)[1].values()) == {0} == set(extraction.tables(none, referents=told)[1].values())
    assert set(extraction.tables(clauses, with_quantities=False, with_references=False, figures_only=True)[1]) == {"definitions_extracted"}


def test_texts_are_searched_once_and_not_staged(spark, monkeypatch):
    staged = []
    real = observed.stage

    def counted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        staged.append((name, set(df.columns), "regexp_extract_all" in plan or "ArrowEvalPython" in plan))
        return real(df, name)

    monkeypatch.setattr(observed, "stage", counted)
    monkeypatch.setattr(extraction, "stage", counted)
    row = queries.extract_summary(spark, SF).first()
    assert row["clauses_loaded"] > 0 and row["quantities_referent_classified"] > 0
    assert [n for n, _, sought in staged if sought] == ["found"] and not any("text" in columns for _, columns, _ in staged)
