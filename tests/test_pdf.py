"""PDF files made by hand: decoding, checks and the route of scanned pages."""

import zlib

import pytest

from clausewright import cli
from clausewright.operators import segment
from clausewright.sources import artefacts, pdf

LONG = "1.1 The Contractor shall complete the works in 30 days."


def made(contents, deflate=True, extra=b""):
    """A file with one page for each content stream."""
    n = len(contents)
    parts = [b"%PDF-1.4\n", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", b"2 0 obj << /Type /Pages /Count %d /Kids [%s] >> endobj\n" % (n, b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(n)))]
    for k, c in enumerate(contents):
        data = zlib.compress(c) if deflate else c
        parts.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (3 + 2 * k, 4 + 2 * k))
        parts.append(b"%d 0 obj << /Length %d %s >> stream\n%s\nendstream endobj\n" % (4 + 2 * k, len(data), b"/Filter /FlateDecode" if deflate else b"", data))
    return b"".join(parts) + extra


def shown(*lines):
    return b"BT /F1 12 Tf 72 720 Td " + b" T* ".join(b"(%s) Tj" % x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in lines) + b" ET"


@pytest.mark.parametrize("deflate", [True, False])
def test_texts_of_pages(deflate):
    data = made([shown("one (1)", "two £ \\ back"), b"BT [(Wor) -20 (ld) -300 (peace)] TJ T* <48656C6C6F> Tj ET", b"q Q"], deflate)
    assert pdf.page_texts(data) == ["one (1)\ntwo £ \\ back", "World peace\nHello", ""]
    assert pdf.page_texts(b"no pdf") == [] and pdf.page_texts(b"") == []


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary")


def test_checks(spark):
    rows = [("f/a.pdf", made([shown(LONG)])), ("f/b.pdf", b"<html>"), ("f/c.pdf", made([shown("x")], extra=b"trailer << /Encrypt 9 0 R >>")), ("f/d.pdf", made([b"q Q"] * 5)), ("f/e.pdf", None), ("f/g.pdf", b"%PDF-1.4")]
    got = {r["path"][2]: tuple(r)[1:] for r in pdf.checked(files(spark, rows)).collect()}
    assert got == {"a": (True, 1, False, True, None), "b": (False, 0, False, False, "not a PDF"), "c": (True, 0, True, False, "encrypted"), "d": (True, 5, False, False, None), "e": (False, 0, False, False, "not a PDF"), "g": (True, 0, False, False, "no pages")}


def test_scanned_pages_are_recognised(spark):
    calls = []

    def blank(content, page):
        return " "

    def fails(content, page):
        raise OSError("no engine")

    def vision(content, page):
        return f"recognised text of page number {page}, long enough" if page != 3 else "short"

    rows = files(spark, [("x/one.pdf", made([shown(LONG, "Page 1 of 2"), b"q Q", shown("tiny")]))])
    got = {r["page_number"]: r for r in pdf.pages(rows, "T", recognisers=(blank, fails, vision)).collect()}
    assert got[1]["text"] == LONG and not got[1]["ocr_was_used"] and got[1]["has_text_layer"]
    assert got[2]["ocr_was_used"] and got[2]["text"].startswith("recognised text of page number 2") and got[2]["char_count"] == len(got[2]["text"])
    assert got[3]["text"] == "tiny" and not got[3]["ocr_was_used"]
    plain = {r["page_number"]: r["text"] for r in pdf.pages(rows, "T").collect()}
    assert plain == {1: LONG, 2: "", 3: "tiny"} and calls == []


def test_from_files_to_clauses(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made([shown("SECTION 1 GENERAL", LONG, "1.2 The Contractor shall keep a record of all tests.")]))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    found = pdf.pages(spark.read.format("binaryFile").load(f"{tmp_path}/*.pdf"), "T")
    assert [r["clause_number"] for r in segment.clauses(found).orderBy("clause_id").collect()] == ["1.1", "1.2"]


def test_failing_decoder_gives_no_pages(spark):
    def broken(data):
        raise ValueError

    assert pdf.pages(files(spark, [("a", b"%PDF")]), "T", decode=broken).collect() == []


def test_command_line_reads_pdf_files(spark, tmp_path):
    at = tmp_path / "T9"
    at.mkdir()
    (at / "02_gcc.pdf").write_bytes(made([shown(LONG), shown("1.2 The Contractor shall keep a record of all tests.")]))
    cli.main(["acquire", "drop", "--folder", str(at)])
    cli.main(["acquire", "validate", "--folder", str(at)])
    cli.main(["parse", "run", "--folder", str(at)])
    listed = artefacts.manifest(spark, f"{at}/manifest.json").first()
    assert (listed["filename"], listed["page_count"], listed["tender_id"]) == ("02_gcc.pdf", 2, "T9")
    assert cli.Folder(spark, str(at)).read("clauses").count() == 2
