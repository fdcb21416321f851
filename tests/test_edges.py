import hashlib
import json

import pytest
from pyspark.sql import functions as F

from clausewright.operators import lexicon
from clausewright.plans import pipeline, prompts, providers
from clausewright.schemas import TABLES
from clausewright.sources import artefacts, report, sinks
from clausewright.streaming import incremental

PAGES = "doc_id string, tender_id string, page_number int, text string, ocr_was_used boolean"
BODY = """SECTION-1: General
1.1 The Works means the bridge and its approaches. The Contractor shall finish within 6 months.
1.2 The Contractor shall use reasonable care for the Works as directed, see Clause 1.1 and IS 456:2000.
1.3 A third heading that carries no duty of any kind whatsoever.
"""


def test_schemas_parse(spark):
    for ddl in TABLES.values():
        assert spark.createDataFrame([], ddl).count() == 0


def test_json_lines(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"quantity_id": "q", "value": 1.5}\n\n{"quantity_id": "r"}\n')
    rows = artefacts.jsonl(spark, str(path), "quantities").collect()
    assert {(r["quantity_id"], r["value"]) for r in rows} == {("q", 1.5), ("r", None)}
    assert artefacts.jsonl(spark, str(tmp_path / "none.jsonl"), "quantities", missing_ok=True).collect() == []
    with pytest.raises(Exception):
        artefacts.jsonl(spark, str(tmp_path / "none.jsonl"), "quantities").collect()
    path.write_text("{broken")
    with pytest.raises(Exception):
        artefacts.jsonl(spark, str(path), "quantities").collect()


def test_ids_and_lists(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text('{"clause_id": "a", "flagged": true}\n{"clause_id": "b"}\n{"clause_id": "a", "flagged": true}\n')
    got = lambda df: sorted(r[0] for r in df.collect())
    assert got(artefacts.ids(spark, str(path), "coalesce(flagged, false)")) == ["a"] and got(artefacts.ids(spark, str(path))) == ["a", "b"]
    assert got(artefacts.ids(spark, str(tmp_path / "none"))) == []
    path.write_text('["x", "y"]')
    assert got(artefacts.id_list(spark, str(path))) == ["x", "y"]
    path.write_text("x\n\n y \n")
    assert got(artefacts.id_list(spark, str(path))) == ["x", "y"]
    path.write_text("# note\nlabel_a\n\nlabel_b\n")
    assert got(artefacts.vocabulary(spark, str(path))) == ["label_a", "label_b"] and artefacts.vocabulary(spark).count() == 34


def test_manifest_and_registry(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"tender_id": "T", "documents": [{"filename": "a.pdf", "role": "corrigendum", "issuance_date": "2024-05-01"}, {"filename": "b.pdf", "role": "nit"}]}))
    assert [(r["tender_id"], r["filename"], r["role"]) for r in artefacts.manifest(spark, str(path)).collect()] == [("T", "a.pdf", "corrigendum"), ("T", "b.pdf", "nit")]
    path.write_text("{}")
    with pytest.raises(ValueError):
        artefacts.manifest(spark, str(path))
    entries = spark.createDataFrame([("IS 1:2000", "4", "c0", 0), ("IS 1:2000", "4.1", "c1", 1)], "code_id string, section string, chunk_id string, ord int")
    reg = tmp_path / "registry.json"
    reg.write_text(sinks.registry_json(entries).first()["value"])
    assert sorted(map(tuple, artefacts.registry(spark, str(reg)).collect())) == sorted(map(tuple, entries.collect()))
    assert artefacts.registry(spark, str(tmp_path / "none")).count() == 0


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "corrigendum_2.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "gcc.pdf").write_bytes(b"nope")
    (tmp_path / "notes.txt").write_bytes(b"no")
    got = {r["filename"]: r for r in artefacts.files(spark, str(tmp_path)).collect()}
    assert set(got) == {"corrigendum_2.pdf", "gcc.pdf"} and got["corrigendum_2.pdf"]["sequence"] == 2
    assert got["corrigendum_2.pdf"]["is_pdf"] and not got["gcc.pdf"]["is_pdf"]
    assert got["gcc.pdf"]["sha256"] == hashlib.sha256(b"nope").hexdigest()


def test_web_pages(spark):
    html = '<title> A tender </title><a href="x.PDF">1</a><a class="q" href=\'/DownloadDocument?id=1\'>2</a><a href="x.PDF">3</a><a href="y.html">4</a> Organisation Chain: <td>Works Dept</td>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert sorted(r["href"] for r in artefacts.links(df).collect()) == ["/DownloadDocument?id=1", "x.PDF"]
    rows = df.select(artefacts.page_title(F.col("html")).alias("t"), artefacts.issuing_authority(F.col("html")).alias("a")).collect()
    assert [tuple(r) for r in rows] == [("A tender", "Works Dept"), ("", "UNKNOWN")]


def test_runs(spark, tmp_path):
    assert artefacts.runs(spark, str(tmp_path / "runs/_index.jsonl")).count() == 0
    (tmp_path / "in.jsonl").write_text("{}\n{}\n")
    for stage in ("parse", "score"):
        run = sinks.start_run("T", stage, limit=3)
        run |= {"api_calls": 2, "cache_hits": 1}
        sinks.record(spark, run, str(tmp_path / "in.jsonl"))
        sinks.finish_run(spark, run, str(tmp_path))
    assert run["inputs"][0]["line_count"] == 2 and run["inputs"][0]["sha256"] == hashlib.sha256(b"{}\n{}\n").hexdigest()
    rows = artefacts.runs(spark, str(tmp_path / "runs/_index.jsonl")).collect()
    assert sorted((r["stage"], r["api_calls"], r["cache_hit_rate"]) for r in rows) == [("parse", 2, 0.5), ("score", 2, 0.5)]
    status = {r["artefact"]: r["present"] for r in artefacts.status(spark, {"in": str(tmp_path / "in.jsonl"), "no": str(tmp_path / "no")}).collect()}
    assert status == {"in": True, "no": False}


def test_vectors_are_added_once(spark):
    new = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    first = sinks.upsert_vectors(new, None, providers.stub_embedding(8))
    changed = spark.createDataFrame([("a", "changed"), ("c", "z")], "id string, text string")
    assert [r["id"] for r in sinks.upsert_vectors(changed, first, providers.stub_embedding(8)).collect()] == ["c"]
    assert first.filter("id = 'a'").first()["content_hash"] == hashlib.sha256(b"x").hexdigest()[:16]


def test_cache(spark):
    asked = spark.createDataFrame([("p1", 0.0), ("p2", 0.0), ("p1", 0.5)], "prompt string, t double")
    none = F.lit(None)
    keyed = asked.withColumn("cache_key", sinks.cache_key(F.lit("generate"), F.lit("m"), F.col("prompt"), F.lit(""), F.col("t"), none.cast("string"), none))
    keys = {(r["prompt"], r["t"]): r["cache_key"] for r in keyed.collect()}
    assert len(set(keys.values())) == 3
    payload = json.dumps({"kind": "generate", "max_out": None, "model": "m", "prompt": "p1", "schema": "", "sys": "", "temp": 0.0}, separators=(",", ":"))
    assert keys["p1", 0.0] == hashlib.sha256(payload.encode()).hexdigest()
    hits, misses = sinks.cached(keyed, spark.createDataFrame([(keys["p1", 0.0], "r")], "cache_key string, reply string"))
    assert hits.count() == 1 and misses.count() == 2


def test_providers(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("bad",)], "id string").coalesce(1)

    def call(rows):
        if any(r["id"] == "bad" for r in rows):
            raise RuntimeError("quota")
        return [{"id": r["id"], "reply": r["id"].upper()} for r in rows]

    got = {r["id"]: (r["reply"], r["error"]) for r in providers.calling(call, "id string, reply string, error string", 1)(requests).collect()}
    assert got == {"a": ("A", None), "b": ("B", None), "bad": (None, "quota")}
    assert [r["v"] for r in providers.recorded(spark.createDataFrame([("a", 1), ("z", 2)], "id string, v int"), "id")(requests).collect()] == [1]


def test_fallback_and_retry():
    clock, asked = [0.0], []

    def first(x):
        asked.append("first")
        raise RuntimeError("429")

    chain = providers.Fallback([first, lambda x: x + 1], lambda e: "429" in str(e), lambda: clock[0] + 1000)
    assert chain(1) == 2 and chain(1) == 2 and asked == ["first"]
    clock[0] = providers.COOLDOWN + 1
    assert chain(1) == 2 and asked == ["first", "first"]
    waits, left = [], [2]

    def flaky():
        left[0] -= 1
        if left[0] >= 0:
            raise RuntimeError("503")
        return "ok"

    assert providers.with_retry(flaky, 4, 1, 30, lambda e: True, waits.append)() == "ok" and waits == [1, 2]
    with pytest.raises(RuntimeError):
        providers.with_retry(first, 4, 1, 30, lambda e: False, waits.append)(1)


def test_prompts(spark):
    rows = prompts.batched(spark.createDataFrame([(f"c{k}", "text\n" * 30) for k in range(10)], "id string, text string"), "id", 3)
    made = prompts.batch_prompt(rows, "id", "text", "Head", 20).collect()
    assert sorted(i for r in made for i in r["ids"]) == sorted(f"c{k}" for k in range(10))
    assert all(r["prompt"].startswith("Head\n[c") and "…" in r["prompt"] for r in made)


def test_whole_run_and_report(spark, tmp_path):
    pages = spark.createDataFrame([("doc", "T", 1, BODY, False)], PAGES)
    said = lambda v: lambda requests: requests.select("flag_id", F.lit(v).alias("verdict"), F.lit(None).cast("string").alias("resolving_clause_id"), F.lit("<why>").alias("rationale"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("error"), F.lit("").alias("refutation"))
    rated = lambda requests: requests.select("flag_id", F.lit(4).alias("commercial_exposure"), F.lit(4).alias("dispute_likelihood"), F.lit(1).alias("reviewer_cost"), F.lit("").alias("rationale"))
    out = pipeline.run(pages, given=pipeline.Providers(verdicts=said("REAL"), critiques=said("CONFIRMED"), severities=rated))
    assert {r["clause_number"] for r in out["clauses"].collect()} == {"1.1", "1.2", "1.3"}
    assert {r["canonical_form"] for r in out["definitions"].collect()} == {"Works"}
    assert out["edges"].filter("target = 'doc::00000'").count() == 1
    assert {r["sources"][0] for r in out["hybrid_hits"].collect()} <= {"R1_dense", "R2_defined_term"}
    assert out["rewrite_candidates"].count() == out["candidate_flags"].filter("flagged").count() > 0
    html = report.render("T", out["candidate_flags"], out["verdicts"], out["confirmed"])
    assert html.startswith("<!doctype html>") and "Pre-bid questions" in html and "high (8/10)" in html
    sinks.jsonl(out["clauses"].drop("ord"), f"{tmp_path}/clauses.jsonl")
    assert artefacts.jsonl(spark, f"{tmp_path}/clauses.jsonl", "clauses").count() == 3
    graph = json.loads(sinks.node_link_json(out["nodes"], out["edges"]))
    assert len(graph["nodes"]) == out["nodes"].count() and len(graph["edges"]) == out["edges"].count()
    tree = sinks.document_tree(pages).first()
    assert (tree["page_count"], tree["total_chars"]) == (1, len(BODY))


def test_streams(spark, tmp_path):
    rows = [{"clause_id": f"c{k}", "doc_id": "d", "tender_id": "T", "page": 1, "text": "reasonable care" if k else "plain"} for k in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = incremental.lexicon_stream(incremental.clause_stream(spark, f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("flags").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start().awaitTermination()
    assert spark.table("flags").filter("flagged").count() == 2
    for n in (3, 4):
        incremental.vector_stream(incremental.clause_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/vectors", providers.stub_embedding(4), f"{tmp_path}/c2").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/vectors").count() == n
        (tmp_path / "in/b.json").write_text(json.dumps(rows[0] | {"clause_id": "c9"}))


def test_stand_ins(spark):
    c = spark.createDataFrame([("a", "The party shall test 5 samples to IS 456."), ("b", "Heading")], "clause_id string, text string")
    assert {r["clause_id"]: r["is_obligation"] for r in providers.stub_obligations(c).collect()} == {"a": True, "b": False}
    made = {r["clause_id"]: r["commitments"][0] for r in providers.stub_commitments(c).collect()}
    assert made["a"]["missing_info"] == [] and len(made["b"]["missing_info"]) == 2
    assert lexicon.flags is not None
