"""The command line over a made-up tender, from synthesis to the report."""

import json

import pytest

from clausewright import cli
from clausewright.functions import text as T
from clausewright.operators import rollups
from clausewright.plans import operations
from clausewright.sources import artefacts, sinks, synthetic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tender") / "EX1")
    cli.main(["acquire", "synthesize", "--folder", at])
    return at


def test_synthesis_refuses_to_overwrite(folder):
    with pytest.raises(FileExistsError):
        cli.main(["acquire", "synthesize", "--folder", folder])
    cli.main(["acquire", "synthesize", "--folder", folder, "--overwrite"])


def test_soft_wrap(spark):
    lines = ["", "short", "a " * 60, "x" * 100, "word " * 17 + "abcd", "one " + "y" * 90 + " two"]
    got = [r["w"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, v string").orderBy("k").select(synthetic.soft_wrap(T.F.col("v")).alias("w")).collect()]
    assert all(len(x) <= 88 for w in got for x in w)
    assert got[1] == ["short"] and ["".join(w).replace(" ", "") for w in got] == [v.replace(" ", "") for v in lines]
    assert got[4] == [("word " * 17).strip(), "abcd"]


def test_manifest_round_trip(spark, folder):
    rows = artefacts.manifest(spark, f"{folder}/manifest.json").collect()
    assert len(rows) == 7 and {r["tender_id"] for r in rows} == {"EX1"}
    raw = json.loads(next(line for line in spark.read.text(f"{folder}/manifest.json").toPandas().value))
    assert raw["award_date"] is None and raw["documents"][0]["sha256"] is None and raw["issuing_authority"] == "Example authority"
    listed = artefacts.manifest(spark, f"{folder}/manifest.json")
    assert [r["sequence"] for r in rollups.corrigenda(listed).collect()] == [1, 2]
    named = rollups.document_named(listed, spark.createDataFrame([("05_quantities.pdf",), ("none.pdf",)], "filename string")).collect()
    assert [(r["filename"], r["role"]) for r in named] == [("05_quantities.pdf", "boq")]


def test_validation_finds_what_is_missing(folder, capsys):
    with pytest.raises(SystemExit):
        cli.main(["acquire", "validate", "--folder", folder])
    assert "missing" in capsys.readouterr().out


def test_stages_from_the_command_line(spark, folder, capsys):
    for group, action, *more in (("parse", "run"), ("parse", "inspect", "--n", "3"), ("extract", "run"), ("extract", "summary"), ("score", "run"), ("score", "inspect", "--flagged-only"), ("critique", "run"), ("confirm", "run"), ("confirm", "inspect", "--tier", "medium"), ("eval", "lexicon"), ("eval", "compare"), ("eval", "metrics"), ("verify", "models")):
        cli.main([group, action, "--folder", folder, *more])
    out = capsys.readouterr().out
    assert "replies 1, cache hits 1, open 0" in out and "medium" in out
    at = cli.Folder(spark, folder)
    flagged = at.read("flags").filter("flagged").count()
    assert flagged > 0 and at.read("verdicts").count() == flagged
    assert {r["severity_tier"] for r in at.read("confirmed").collect()} == {"medium"}
    truth = [r["clause_id"] for r in at.read("flags").limit(3).collect()]
    spark.createDataFrame([(json.dumps(truth),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/truth.json")
    cli.main(["eval", "ablation", "--folder", folder, "--truth", f"{folder}/truth.json"])
    assert "A3_bct_plus_stage2" in capsys.readouterr().out
    cli.main(["extract", "query", "4.1 Concrete shall be tested as per IS 456:2000 Section 16.1 and cured adequately.", "--folder", folder, "--top-k", "2"])
    assert "04_specification" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["eval", "ablation", "--folder", folder])


def test_codes_rewrites_run_and_report(spark, folder, capsys):
    chunks = [("k1", "IS 456:2000", "Concrete", 2000, "16.1", ["16", "16.1"], 3, "Acceptance and curing of concrete.", 30, "f", None)]
    sinks.jsonl(spark.createDataFrame(chunks, cli.artefacts.schemas.TABLES["iscode_chunks"]), f"{folder}/codes.jsonl")
    cli.main(["codes", "build", "--folder", folder])
    cli.main(["codes", "build", "--folder", folder])
    assert spark.read.parquet(f"{folder}/code_vectors.parquet").count() == 1
    assert artefacts.registry(spark, f"{folder}/code_registry.json").first()["chunk_id"] == "k1"
    cli.main(["codes", "verify", "as per IS 456:2000 Section 16.1 and IS 9:1999 Section 1", "--folder", folder])
    assert "true" in (out := capsys.readouterr().out) and "false" in out
    # recorded replies of all operations
    at = cli.Folder(spark, folder)
    flags = at.read("flags").filter("flagged").select("flag_id", "clause_id").collect()
    told = {"verdict": {"verdict": "REAL", "rationale": "open"}, "critique": {"verdict": "CONFIRMED", "refutation": "none"}, "severity": {"commercial_exposure": 5, "dispute_likelihood": 4, "reviewer_cost": 1}, "rewrite": {"rewrite_text": "Cure as per IS 456:2000 Section 16.1.", "explanation": "e"}}
    for name, answer in told.items():
        sinks.jsonl(spark.createDataFrame([(f["flag_id"], json.dumps(answer), None) for f in flags], "flag_id string, reply string, error string"), f"{folder}/replies/{name}.jsonl")
    sinks.jsonl(spark.createDataFrame([(f["flag_id"], '{"commitments": []}', None) for f in flags], "clause_id string, reply string, error string"), f"{folder}/replies/commitments.jsonl")
    for group in ("critique", "confirm", "rewrite"):
        cli.main([group, "run", "--folder", folder, "--replies", f"{folder}/replies", "--intent-threshold", "0.0"])
    done = at.read("rewrites").collect()
    assert len(done) == len(flags) and {r["status"] for r in done} == {"ACCEPTED"}
    cli.main(["rewrite", "inspect", "--folder", folder, "--accepted-only"])
    cli.main(["pipeline", "run", "--folder", folder, "--skip", "rewrite"])
    cli.main(["pipeline", "history", "--folder", folder])
    cli.main(["pipeline", "status", "--folder", folder])
    out = capsys.readouterr().out
    assert "candidate_flags.jsonl" in out and "pipeline" in out
    cli.main(["report", "html", "--folder", folder])
    html = "\n".join(r["value"] for r in spark.read.text(f"{folder}/report.html").collect())
    assert "Ambiguity report EX1" in html and "Pre-bid questions" in html and "Accepted rewrites" in html and "INR" in html and "Confirmed ambiguities" in html


def test_tender_metrics(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "clause_id string")
    universe, truth = ids(*"abcdefgh"), ids("a", "b", "c")
    rows = {(r["measure"], r["name"]): r["value"] for r in rollups.tender_metrics(universe, truth, ids("a", "b", "x"), ids("b", "d"), ids()).collect()}
    assert rows["counts", "universe_size"] == 8 and rows["counts", "bct_confirmed"] == 0
    assert rows["bct_pipeline", "tp"] == 2 and rows["bct_pipeline", "recall"] == pytest.approx(0.6667) and rows["lexicon_baseline", "fp"] == 1
    assert not any(m == "bct_confirmed" for m, _ in rows) and any(m == "agreement" for m, _ in rows)
    plain = rollups.tender_metrics(universe, None, ids("a"), ids("b"), ids("c")).collect()
    assert {r["measure"] for r in plain} == {"counts", "agreement"}


def test_every_operation_has_a_reply_schema(spark):
    for name in operations.OPERATIONS:
        key = operations.OPERATIONS[name].key if operations.OPERATIONS[name].batch == 1 else "batch"
        assert operations.typed(name, spark.createDataFrame([("1", "{", None)], f"{key} string, reply string, error string")).collect() is not None
