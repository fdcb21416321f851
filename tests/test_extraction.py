import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text
from clausewright.operators import citations, definitions, lexicon, quantities, references, segment
from clausewright.functions import naming

CLAUSE = "clause_id string, doc_id string, tender_id string, page int, section_path array<string>, clause_number string, text string, ord int"


@pytest.fixture
def clauses(spark):
    def make(*rows):
        full = [(f"d::{k:05d}", "d", "T", 1, ["General"], r[1] if isinstance(r, tuple) else None, r[0] if isinstance(r, tuple) else r, k) for k, r in enumerate(rows)]
        return spark.createDataFrame(full, CLAUSE)

    return make


def found(spark, words, expr):
    return spark.createDataFrame([(words,)], "t string").select(expr(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("words", ["", "a 1 b 22 c", "12é34 — 5", "no digits", "7", "7 8\n9"])
def test_spans_equal_finditer(spark, words):
    got = found(spark, words, lambda t: text.spans(t, r"(\d)(\d)?", 1, 2))
    assert [(g["start"], g["end"], g["raw"], g["g0"], g["g1"]) for g in got] == [(m.start(), m.end(), m[0], m[1], m[2] or "") for m in re.finditer(r"(\d)(\d)?", words)]


@pytest.mark.parametrize("words", ["", "a", "a\n", "a\n\nb\r\nc\x0bd e", "\n"])
def test_splitlines(spark, words):
    assert found(spark, words, text.splitlines) == words.splitlines()


def test_text_helpers(spark):
    assert found(spark, " a  b\n", text.collapse) == "a b"
    assert found(spark, "a  b c", text.word_count) == 3
    assert found(spark, "abcdef", lambda t: text.truncate(t, 3)) == "abc…"
    assert found(spark, "<a href=\"x\">'&'", text.html_escape) == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;"


@pytest.mark.parametrize(
    "words,kind,norm,unit",
    [("within 6 months", "duration", 180, "days"), ("INR 250 crore", "money", 25000, "inr_lakhs"), ("a 2.5 m pipe", "dimension", 2500, "mm"), ("of 5% only", "percentage", 5, "pct"), ("± 2 mm", "tolerance", 2, "mm"), ("+/- 5%", "tolerance", 5, "%"), ("mix 1:4 by weight", "ratio", 0.25, "ratio"), ("3 times per week", "frequency", 3 / 7, "per_day"), ("USD 2 million", "money", 168, "inr_lakhs"), ("Rs. 1,50,000", "money", 1.5, "inr_lakhs"), ("8 to 4:0", "ratio", 4, "ratio"), ("12 hrs", "duration", 0.5, "days"), ("1. In force", "dimension", 25.4, "mm")],
)
def test_quantities(clauses, words, kind, norm, unit):
    rows = [r for r in quantities.extract(clauses(words)).collect() if r["kind"] == kind]
    assert len(rows) == 1 and rows[0]["value_norm"] == pytest.approx(norm) and rows[0]["unit_norm"] == unit


def test_quantities_do_not_overlap_and_are_numbered(clauses):
    rows = quantities.extract(clauses("Slump 75 mm and complete within 365 days, with deposit Rs. 50 lakh.", ".% and . In")).orderBy("quantity_id").collect()
    assert [(r["quantity_id"], r["kind"], r["raw_text"]) for r in rows] == [("d::00000::q000", "money", "Rs. 50 lakh"), ("d::00000::q001", "duration", "365 days"), ("d::00000::q002", "dimension", "75 mm")]
    assert quantities.extract(clauses("USD 2 million"), strict=True).first()["value_norm"] == pytest.approx(1680)


def test_referents(spark, clauses):
    q = quantities.extract(clauses("within 6 months"))
    replies = spark.createDataFrame([("d::00000::q000", " Notice Period ", 1.7), ("zz", "x", 0.1)], "quantity_id string, referent string, confidence double")
    r = quantities.classify(q, replies).collect()
    assert len(r) == 1 and (r[0]["referent"], r[0]["referent_confidence"], r[0]["referent_method"]) == ("notice_period", 1.0, "llm")


def test_definitions(clauses):
    rows = definitions.extract(clauses('"the Contractor" means the entity that builds. "the Contractor" means the entity again.', "The Works shall mean the permanent things under Sub-Clause 4.6.", "(Engineer) means a person named here; and so on", "X means short")).collect()
    assert {(r["canonical_form"], r["definition_text"]) for r in rows} == {("Contractor", "the entity that builds"), ("Works", "the permanent things under Sub-Clause 4"), ("Engineer", "a person named here")}


def test_definition_fallback(spark, clauses):
    c = clauses("Definitions follow but none is found here.", "Nothing to see.")
    assert [r["clause_id"] for r in definitions.fallback_candidates(c, definitions.extract(c)).collect()] == ["d::00000"]
    replies = spark.createDataFrame([("d::00000", "Works", "everything to be built")], "clause_id string, canonical_form string, definition_text string")
    assert [r["extraction_method"] for r in definitions.extract(c, replies).collect()] == ["llm"]


def test_references_and_graph(clauses):
    c = clauses(("As per Clause 4.6 and IS 456: 2000, Annexure-B, Drawing No. A-1.", "3.1"), ("Number four six.", "4.6"), ("Same number again.", "4.6"), ("See clause 9.9.", "5.1"))
    rows = references.resolve(references.extract(c), c)
    got = {(r["target_kind"], r["target_label"], r["resolved"], r["target_id"]) for r in rows.collect()}
    assert ("clause", "Clause 4.6", True, "d::00002") in got and ("annex", "Annex B", False, None) in got and ("standard", "IS 456: 2000", False, None) in got and ("clause", "Clause 9.9", False, None) in got
    edges = {(r["source"], r["target"]) for r in references.edges(rows).collect()}
    assert ("d::00000", "d::00002") in edges and ("d::00003", "external::clause::Clause 9.9") in edges
    nodes = {r["id"]: r["kind"] for r in references.nodes(rows, c).collect()}
    assert nodes["d::00001"] == "clause" and nodes["external::annex::Annex B"] == "annex"


def test_lexicon(clauses):
    c = clauses("The party shall use best efforts and reasonable means.", "Pour 5 m3 of concrete.", "As required, approximately 5 % or more.", "reaſonable")
    rows = {r["clause_id"][-1]: r for r in lexicon.flags(c).collect()}
    assert (rows["0"]["flagged"], rows["0"]["marker_count"], rows["0"]["flag_reason"]) == (True, 2, "lexicon:effort_pledges|subjectivity")
    assert (rows["1"]["flagged"], rows["1"]["flag_reason"]) == (False, "")
    assert rows["2"]["marker_categories"] == ["approximation", "delegated_authority", "feasibility_dodge"]
    brute = sum(len(re.findall(p, "As required, approximately 5 % or more.", re.I)) for ps in lexicon.LEXICON.values() for p in ps)
    assert rows["2"]["marker_count"] == brute and rows["3"]["flagged"]
    assert [lexicon.summary(lexicon.flags(c), n).first()["flagged"] for n in (1, 2, 9)] == [3, 2, 0]


def test_needles_are_in_every_match():
    samples = "best effort best efforts all reasonable step as directed as may be required as required subject to approval subject to the approval at the discretion of approximately 5 % or more any relevant other materials to the extent practicable wherever feasible".split("  ")
    for patterns in lexicon.LEXICON.values():
        for p in patterns:
            for s in samples:
                for m in re.finditer(p, s, re.I):
                    assert all(n in m[0].lower() for n in lexicon.needle(p))


def citation_rows(spark, words):
    df = spark.createDataFrame([("r", words)], "id string, text string")
    return [(r["code"], r["version"], r["section"]) for r in citations.extract(df).orderBy("ord").collect()]


def test_citations(spark):
    assert citation_rows(spark, "per IS 456:2000 Section 8.1.") == [("IS 456", "2000", "8.1")]
    assert citation_rows(spark, "IS 456:2000 and IS 875 (Part 5):1987, IS 456:2000") == [("IS 456", "2000", None), ("IS 875 (Part 5)", "1987", None)]
    assert citation_rows(spark, "CPWD Specifications:2019 Vol 1 Section 5.4") == [("CPWD Specifications Vol1", "2019", "5.4")]
    assert citation_rows(spark, "CPWD GCC Section 104") == [("CPWD GCC", None, "104")]
    assert citation_rows(spark, "nothing") == []


@pytest.mark.parametrize(
    "cite,chunk",
    [(("IS 456", "2000", "8.1"), "c1"), (("IS 456", "2000", "8"), "c1"), (("IS 456", "1978", "8.1"), "c1"), (("IS 456", "2000", "9"), None), (("IS 456", "2000", None), "c1"), (("IS 456", None, None), "c1"), (("IS 999", "2000", "8.1"), None), (("IS 45", None, "8.1"), "c1"), (("IS 800", None, "3"), "c4"), (("IS 800", "1984", None), None)],
)
def test_verification(spark, cite, chunk):
    registry = spark.createDataFrame([("IS 456:2000", "8.1", "c1", 1), ("IS 456:2000", "8.2", "c2", 2), ("IS 800:2007", "3", "c4", 3)], "code_id string, section string, chunk_id string, ord int")
    rows = spark.createDataFrame([("r", 0, *cite, "raw")], "id string, ord int, code string, version string, section string, raw_text string")
    got = citations.verify(rows, registry).first()
    assert (got["resolved_chunk_id"], got["resolved"]) == (chunk, chunk is not None)
    if cite == ("IS 45", None, "8.1"):
        assert not citations.verify(rows, registry, strict=True).first()["resolved"]


def pages(spark, *texts):
    return spark.createDataFrame([("doc", "T", k + 1, t, k == 1) for k, t in enumerate(texts)], "doc_id string, tender_id string, page_number int, text string, ocr_was_used boolean")


def test_sections_and_pages(spark):
    got = segment.clauses(pages(spark, "Leading text that is long enough to stay.\nSECTION-1: Scope\n1.1 The first clause is long enough here.\n", "1.2 The second clause stands on a page of its own.\nSECTION-2\n(a) too short\n2. Another clause that is long enough to keep")).orderBy("ord").collect()
    assert [(r["clause_id"], r["section_path"], r["clause_number"], r["page"], r["page_end"], r["ocr_was_used"]) for r in got] == [
        ("doc::00000", ["Front Matter"], None, 1, 1, False), ("doc::00001", ["Section 1"], "1.1", 1, 1, False), ("doc::00002", ["Section 1"], "1.2", 2, 2, True), ("doc::00003", ["Section 2"], "2.", 2, 2, True)]
    assert got[1]["text"] == "1.1 The first clause is long enough here." and got[1]["word_count"] == 8


def test_document_without_structure(spark):
    got = segment.clauses(pages(spark, "just prose that goes on and on for a while")).collect()
    assert [(r["section_path"], r["clause_number"]) for r in got] == [(["(unsectioned)"], None)]
    assert segment.clauses(pages(spark, "short")).collect() == [] and segment.clauses(pages(spark)).collect() == []


def plain_clauses(full):
    marks = {}
    for n, p in enumerate(segment.CLAUSES):
        flags = re.M | (re.I if "i" in p.split(")")[0] else 0)
        for m in re.finditer(p[p.index(")") + 1 :], full, flags):
            key = (-len(m[0]), n)
            if m.start() not in marks or key < marks[m.start()][0]:
                marks[m.start()] = (key, m[1].strip())
    cuts = sorted(marks)
    spans = ([(0, cuts[0], None)] if cuts and cuts[0] else []) + [(s, e, marks[s][1]) for s, e in zip(cuts, [*cuts[1:], len(full)], strict=True)] or [(0, len(full), None)]
    return [(n, full[s:e].strip()) for s, e, n in spans if len(full[s:e].strip()) >= 30]


@pytest.mark.parametrize("body", ["Clause 4(a) The supplier shall deliver all goods in time.\n10B The second one is of the same length as that.\nA. Further conditions follow in this paragraph here.", "4.2.1 x\n  (iv) the contractor keeps records for inspection always\n5. Then it ends with a final and long enough sentence.", "text before\n1.1\n2.2 something that is definitely longer than thirty"])
def test_clauses_equal_a_plain_chunker(spark, body):
    got = [(r["clause_number"], r["text"]) for r in segment.clauses(pages(spark, body)).orderBy("ord").collect()]
    assert got == plain_clauses(body + "\n")


def test_codes(spark):
    long = "\n\n".join(f"paragraph {k} " + "x" * 90 for k in range(6))
    df = spark.createDataFrame([("IS_1200_part5_1982_Form_work.pdf", "T", 1, f"5.4 Scope\n{long}\n6 short\n7.1 {'y' * 120}", False)], "doc_id string, tender_id string, page_number int, text string, ocr_was_used boolean")
    got = segment.code_sections(df, max_chars=300).orderBy("ord").collect()
    assert got[0]["code_id"] == "IS 1200 (Part 5):1982" and got[0]["code_title"] == "Form work" and got[0]["section_path"] == ["Form work", "5", "5.4"]
    assert got[0]["chunk_id"] == "IS_1200_Part_5_1982::s::5.4::0000"
    assert [r["section"] for r in got] == ["5.4", "5.4", "7.1"] or len({r["section"] for r in got}) == 2
    assert all(len(r["text"]) <= 300 for r in got)


def test_tables(spark):
    rows = [("d", "T", 3, 0, [["Item", None, "Rate"], ["Cement bags of fifty kilos", "10", " "], ["x", "", ""], [None, "", " "], ["Sand", "two loads", "rate of 55", "an extra cell"]])]
    df = spark.createDataFrame(rows, "doc_id string, tender_id string, page int, table_index int, rows array<array<string>>")
    got = segment.table_clauses(df, spark.createDataFrame([("d", 7)], "doc_id string, first_index int")).orderBy("ord").collect()
    assert [(r["clause_id"], r["text"]) for r in got] == [("d::table_003_00_r00007", "Item: Cement bags of fifty kilos; Col2: 10"), ("d::table_003_00_r00008", "Item: Sand; Col2: two loads; Rate: rate of 55; Col4: an extra cell")]


def test_page_lines_and_ocr(spark):
    assert found(spark, "keep\nPage 3 of 9\n 12 \n3 / 4\n\nPage 7\nend", segment.strip_page_lines) == "keep\n\nend"
    choose = lambda a, b, c: spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(segment.choose_text(F.col("a"), F.col("b"), F.col("c")).alias("v")).first()["v"]
    assert tuple(choose("x" * 30, "y" * 40, None)) == ("x" * 30, False)
    assert tuple(choose("x", " ", "z" * 40)) == ("z" * 40, True)
    assert tuple(choose("x", "short", "z" * 40)) == ("x", False)


@pytest.mark.parametrize("name,role,seq", [("Corrigendum_001.pdf", "corrigendum", 1), ("corr_2024_007.pdf", "corrigendum", 7), ("01_NIT.pdf", "nit", 1), ("GCC-2020.pdf", "gcc", 2020), ("technical specs.pdf", "specs", 0), ("schedule_of_rates.pdf", "boq", 0), ("Annexure IV.pdf", "annex", 0), ("a/b/tender.v2.pdf", "tender_v1", 2), ("misc.pdf", "other", 0)])
def test_file_names(spark, name, role, seq):
    assert found(spark, name, naming.role) == role and found(spark, name, naming.sequence) == seq


@pytest.mark.parametrize("name,code,family", [("IS_456_2000_Plain_Concrete.pdf", "IS 456:2000", "IS"), ("CPWD_Specifications_2019_Vol1_Civil.pdf", "CPWD Specifications:2019 Vol1", "CPWD"), ("Random.File.pdf", "Random.File", "OTHER")])
def test_code_names(spark, name, code, family):
    got = found(spark, name, naming.code_of_file)
    assert (got["code_id"], got["family"]) == (code, family)


def test_collections_and_ids(spark):
    assert found(spark, "_Te nder/1.", naming.collection) == "tender_Te_nder_1" and found(spark, "///", naming.collection) == "tender_tender"
    assert found(spark, "a::b::00012", naming.short_id) == "00012" and found(spark, "abcdefghijklmnop", naming.short_id) == "abcdefghijkl"


LINES = ["1.2", "1.2 ", "  1.3", "3.", "4A.", "(a)", "A.", "Clause", "Clause 7", "5", "SECTION", "SECTION-2", "SECTION 3: More", "PART", "Annexure", "Annexure B", "", "  ", "1.1 The party shall deliver all of it without delay.", "2. Another clause that is long enough to stay", "plain prose that goes on for a while, and then some more", "Title of what follows", "(b) lower letter clause of some length in it"]


def scattered_pages(seed, n=40):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(LINES) for _ in range(rng.choice([0, 1, 1, 2, 3, 6]))) + rng.choice(["", "\n", "\n\n"]) for _ in range(n)]


def test_runs_of_pages_give_the_same_clauses(spark, monkeypatch):
    """Numbers, headings and clauses over the ends of pages, blank pages, clauses of many pages; whatever the runs."""
    texts = {f"d{k}": scattered_pages(k) for k in range(6)}
    rows = [(d, None if d == "d1" else f"T{len(d)}", 3 * n + 1, t or None if n % 2 else t, n % 3 == 0) for d, held in texts.items() for n, t in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id string, tender_id string, page_number int, text string, ocr_was_used boolean")
    every = []
    for run in (1, 4, 10_000):
        monkeypatch.setattr(segment, "RUN", run)
        found = segment.clauses(df).orderBy("doc_id", "ord").collect()
        every.append(sorted(tuple(r) for r in found))
        assert [r["ord"] for r in found if r["doc_id"] == "d2"] == list(range(sum(r["doc_id"] == "d2" for r in found)))
        for d, held in texts.items():
            full = "".join(t + "\n" for t in held)
            ends = list(itertools.accumulate(len(t) + 1 for t in held))
            for r in (r for r in found if r["doc_id"] == d):
                assert r["text"] in full and r["page"] <= r["page_end"] <= len(ends) and r["ocr_was_used"] == ((r["page"] - 1) % 3 == 0)
    assert every[0] == every[1] == every[2] and len(every[0]) > 60
    monkeypatch.setattr(segment, "RUN", 4)
    assert segment.page_runs(df).groupBy("doc").count().agg(F.min("count")).first()[0] > 1


def test_a_long_document_has_no_large_row(spark):
    """Thousands of pages, one clause over most of them."""
    pages_ = spark.range(4000).select(F.lit("d").alias("doc_id"), F.lit("T").alias("tender_id"), (F.col("id") + 1).cast("int").alias("page_number"), F.concat(F.when(F.col("id").isin(0, 3990), F.concat(F.lit("1."), F.col("id") + 1, F.lit(" "))).otherwise(""), F.lit("words that go on and on")).alias("text"), F.lit(False).alias("ocr_was_used"))
    assert segment.page_runs(pages_).agg(F.max(F.length("text"))).first()[0] < 200 * 30
    got = segment.clauses(pages_).orderBy("ord").collect()
    assert [(r["clause_number"], r["page"], r["page_end"]) for r in got] == [("1.1", 1, 3990), ("1.3991", 3991, 4000)]
