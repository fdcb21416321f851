"""Requests, replies and the rewrite loop, with models that are tables or rules."""

import json

import pytest
from pyspark.sql import functions as F

from clausewright.plans import operations, pipeline, providers, rewrite

COMMITTED = "array<struct<obligation: string, quantity: string, method: string, standard: string, missing_info: array<string>>>"


def replies(spark, name, rows):
    key = operations.OPERATIONS[name].key if operations.OPERATIONS[name].batch == 1 else "batch"
    return operations.typed(name, spark.createDataFrame(rows, f"{key} string, reply string, error string"))


def test_replies_are_checked(spark):
    good = {"commercial_exposure": 4, "dispute_likelihood": 2, "reviewer_cost": 1, "rationale": "r"}
    rows = [("a", json.dumps(good), None), ("b", "```json\n" + json.dumps(good) + "\n```", None), ("c", "no json", None), ("d", json.dumps(good | {"commercial_exposure": 9}), None), ("e", None, None), ("f", json.dumps(good), "429 quota"), ("g", json.dumps({"rationale": "x"}), None), ("h", json.dumps(good | {"reviewer_cost": "three"}), None)]
    got = {r["flag_id"]: r for r in replies(spark, "severity", rows).collect()}
    assert {k for k, r in got.items() if r["error"] is None} == {"a", "b"}
    assert (got["a"]["commercial_exposure"], got["a"]["reviewer_cost"]) == (4, 1)
    assert got["f"]["error"] == "429 quota" and got["e"]["error"] == "no reply" and all(got[k]["commercial_exposure"] is None for k in "cdefgh")


def test_commitments_and_batches(spark):
    got = {r["clause_id"]: r for r in replies(spark, "commitments", [("a", '{"commitments": [{"obligation": "x", "quantity": "5", "missing_info": ["q?"]}]}', None), ("b", '{"commitments": [{"quantity": "5"}]}', None), ("c", '{"commitments": []}', None), ("d", "{}", None)]).collect()}
    assert got["a"]["commitments"][0]["quantity"] == "5" and got["a"]["commitments"][0]["method"] is None
    assert got["c"]["error"] is None and got["c"]["commitments"] == [] and got["b"]["error"] and got["d"]["error"]
    items = replies(spark, "obligation", [("0", '{"items": [{"clause_id": "a", "is_obligation": true}, {"clause_id": "b"}, {"is_obligation": false}]}', None), ("1", "broken", None)]).collect()
    assert [(r["clause_id"], r["is_obligation"]) for r in items] == [("a", True)]
    terms = replies(spark, "definition", [("0", '{"items": [{"clause_id": "a", "canonical_form": "Works", "definition_text": "all works"}, {"clause_id": "a", "canonical_form": ""}]}', None)]).collect()
    assert [(r["canonical_form"], r["definition_text"]) for r in terms] == [("Works", "all works")]


def test_referents_come_in_batches(spark):
    rows = spark.createDataFrame([(f"q{k}", f"{k} days", "within") for k in range(70)], "quantity_id string, raw_text string, surrounding_text string")
    sent = []

    def model(requests):
        sent.extend(requests.collect())
        return requests.select("batch", F.concat(F.lit('{"items": ['), F.array_join(F.transform(F.regexp_extract_all("prompt", F.lit(r"\[(q\d+)\]"), F.lit(1)), lambda q: F.concat(F.lit('{"quantity_id": "'), q, F.lit('", "referent": "notice_period", "confidence": 0.5}'))), ","), F.lit("]}")).alias("reply"), F.lit(None).cast("string").alias("error"))

    got = operations.referents(rows, model).collect()
    assert sorted(r["quantity_id"] for r in got) == sorted(f"q{k}" for k in range(70))
    assert len(sent) == 3 and {r["model"] for r in sent} == {operations.FAST} and all("notice_period" in r["system"] for r in sent)


FLAGS = "flag_id string, clause_id string, doc_id string, tender_id string, clause_text string, section_path array<string>"
GOOD = "Cure concrete for 7 days as per IS 456:2000 Section 13.5."
BAD = "Cure concrete as per IS 999:1999 Section 1.1."


def loop(spark, scripts, commitments=None, vectors=None, most=3):
    """``scripts``: each flag's texts by attempt; None is a failed call."""
    flags = spark.createDataFrame([(f, f"c{f}", "d", "T", f"Cure concrete well ({f}).", ["S"]) for f in scripts], FLAGS)
    unknown = F.array(F.struct(F.lit("cure").alias("obligation"), F.lit("CANNOT_DETERMINE").alias("quantity"), F.lit("m").alias("method"), F.lit("s").alias("standard"), F.array().cast("array<string>").alias("missing_info"))).cast(COMMITTED)
    full = flags.withColumn("commitments", unknown)
    prompts, rounds = [], []

    def write(rows, temperature):
        held = rows.select("flag_id", "prompt", "failures").collect()
        n = len(rounds)
        rounds.append((sorted(r["flag_id"] for r in held), temperature))
        prompts.extend((n + 1, r["flag_id"], r["prompt"]) for r in held)
        said = [(r["flag_id"], scripts[r["flag_id"]][n], "e", None if scripts[r["flag_id"]][n] else "503 busy") for r in held]
        return spark.createDataFrame(said, "flag_id string, rewrite_text string, explanation string, error string").withColumn("is_code_citations", F.array().cast("array<struct<code: string, version: string, section: string>>"))

    def again(rows):
        text = F.col("text")
        worse = F.array_repeat(unknown[0], 2)
        found = F.when(text.contains("WORSE"), worse).otherwise(F.array().cast(COMMITTED))
        return rows.filter(~text.contains("NOCHECK")).select("clause_id", found.alias("commitments"))

    def embed(rows):
        return rows.withColumn("vector", F.when(F.col("text").contains("DRIFT"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.1))))

    given = pipeline.Providers(commitments=again, embed=embed, rewrites=write)
    registry = spark.createDataFrame([("IS 456:2000", "13.5", "k1", 0)], "code_id string, section string, chunk_id string, ord int")
    chunks = full.select("flag_id", F.array(F.struct(F.lit("IS 456:2000").alias("code_id"), F.lit("13.5").alias("section"), F.lit(3).alias("page"), F.lit("Curing.").alias("text"))).alias("chunks"))
    rows, every = rewrite.loop(flags, full, given, chunks, registry, max_attempts=most)
    return {r["flag_id"]: r for r in rows.collect()}, every.collect(), prompts, rounds


def test_attempts_end_as_they_should(spark):
    scripts = {"ok": [GOOD], "second": [BAD, GOOD], "never": [BAD, BAD, BAD], "fails": [None], "worse": [GOOD + " WORSE", GOOD], "drift": [GOOD + " DRIFT"] * 3, "late": [BAD, None], "nocheck": [GOOD + " NOCHECK"] * 3}
    got, every, prompts, rounds = loop(spark, scripts)
    status = {f: (r["status"], r["attempts"]) for f, r in got.items()}
    assert status == {"ok": ("ACCEPTED", 1), "second": ("ACCEPTED", 2), "never": ("RETRY_LIMIT_REACHED", 3), "fails": ("ERROR", 1), "worse": ("ACCEPTED", 2), "drift": ("RETRY_LIMIT_REACHED", 3), "late": ("ERROR", 2), "nocheck": ("RETRY_LIMIT_REACHED", 3)}
    assert [t for _, t in rounds] == [None, operations.RETRY_TEMPERATURE, operations.RETRY_TEMPERATURE]
    assert rounds[1][0] == ["drift", "late", "never", "nocheck", "second", "worse"] and rounds[2][0] == ["drift", "never", "nocheck"]
    second = {(n, f): p for n, f, p in prompts}
    assert "G1" not in second[1, "never"] and "G1" in second[2, "never"] and second[3, "never"].count("G1") == 2 and "IS 999:1999" in second[2, "never"].replace("IS 999 1999", "IS 999:1999")
    assert "G2" in second[2, "worse"] and "G3" in second[2, "drift"] and "G2" in second[2, "nocheck"]
    assert got["ok"]["rejection_reason"] == "" and "503" in got["fails"]["rejection_reason"] and "G3" in got["drift"]["rejection_reason"]
    assert got["drift"]["g3"] is False and got["ok"]["g1"] and got["ok"]["g2"] and got["ok"]["g3"]
    # a check that an attempt did not reach is unknown; the last attempt makes them all
    by = {(r["flag_id"], r["attempt"]): r for r in every}
    assert by["never", 1]["g2"] is None and by["never", 3]["g2"] is True and by["never", 3]["g1"] is False
    assert len(every) == 8 + 6 + 3


def test_one_attempt_at_most(spark):
    got, every, _, _ = loop(spark, {"never": [BAD], "ok": [GOOD]}, most=1)
    assert {f: r["status"] for f, r in got.items()} == {"never": "RETRY_LIMIT_REACHED", "ok": "ACCEPTED"} and len(every) == 2


def test_whole_run_from_one_model(spark):
    """Every stage of the pipeline, rewrites included, from a single rule-based model."""
    pages = spark.createDataFrame([("d", "T", n, f"1.{n} The Contractor shall cure all concrete surfaces adequately and report the progress of works.", False) for n in (1, 2)] + [("e", "U", 1, "1.1 The Contractor shall cure all concrete surfaces adequately and report the works.", False)], "doc_id string, tender_id string, page_number int, text string, ocr_was_used boolean")
    answers = {"verdict": {"verdict": "REAL", "rationale": "open", "confidence": 0.9}, "critique": {"verdict": "CONFIRMED", "refutation": ""}, "severity": {"commercial_exposure": 5, "dispute_likelihood": 4, "reviewer_cost": 1, "rationale": ""}, "rewrite": {"rewrite_text": GOOD, "explanation": "", "is_code_citations": []}}
    systems = {operations.OPERATIONS[n].system: json.dumps(a) for n, a in answers.items()}

    def model(requests):
        if "batch" in requests.columns:
            ids = F.transform(F.regexp_extract_all("prompt", F.lit(r"(?m)^\[(.+?)\] "), F.lit(1)), lambda i: F.concat(F.lit('{"clause_id": "'), i, F.lit('", "is_obligation": true}')))
            return requests.select("batch", F.concat(F.lit('{"items": ['), F.array_join(ids, ","), F.lit("]}")).alias("reply"), F.lit(None).cast("string").alias("error"))
        said = F.lit('{"commitments": [{"obligation": "cure", "quantity": "", "method": "m", "standard": "s", "missing_info": ["How long?"]}]}')
        said = F.when(F.col("prompt").contains("7 days"), F.lit('{"commitments": []}')).otherwise(said)
        for system, answer in systems.items():
            said = F.when(F.col("system") == system, F.lit(answer)).otherwise(said)
        return requests.select(requests.columns[0], said.alias("reply"), F.lit(None).cast("string").alias("error"))

    codes = spark.createDataFrame([("k1", "IS 456:2000", "13.5", 3, "Concrete curing of surfaces", "f")], "chunk_id string, code_id string, section string, page int, text string, source_file string")
    given = operations.from_model(model, providers.stub_embedding())
    out = pipeline.run(pages, given=given, codes=codes)
    n = out["candidate_flags"].filter("flagged").count()
    assert n == 3 and out["verdicts"].filter("verdict = 'REAL'").count() == n
    assert out["confirmed"].filter("severity_tier = 'high'").count() == n
    # hits stay within the tender
    pairs = out["hybrid_hits"].join(out["candidate_flags"].select("flag_id", "tender_id"), "flag_id").select("tender_id", "clause_id").collect()
    assert pairs and all(r["clause_id"].startswith("d" if r["tender_id"] == "T" else "e") for r in pairs)
    done = {r["flag_id"]: r for r in out["rewrites"].collect()}
    assert len(done) == n and all(r["g1"] and r["g2"] and r["resolved_count"] == 1 for r in done.values())
    assert {r["status"] for r in done.values()} <= {"ACCEPTED", "RETRY_LIMIT_REACHED"}


def test_no_provider_of_rewrites(spark):
    flags = spark.createDataFrame([], FLAGS)
    with pytest.raises(ValueError):
        rewrite.loop(flags, flags, pipeline.Providers(), flags, flags)
