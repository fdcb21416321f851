import random

import corpus_pipeline
from clausewright.llm import sentencepieces, simhash


def tables(spark, prose, at, extra=()):
    rng = random.Random(1)
    item = prose(900, 30)
    rows, labels = [], []
    for i in range(120):
        poor = i % 4 == 0
        text = prose(i, 80)
        rows.append((i, " ".join(w + "%%%" for w in text.split()) if poor else text))
        labels.append((i, int(not poor), 0))
    rows += [(200, rows[1][1]), (201, prose(77, 40) + " " + item + " " + prose(78, 40)), (202, prose(279, 80) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), *extra]
    rng.shuffle(rows)
    spark.createDataFrame([(*r, "en", "src1", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return dict(rows)


def test_stages_take_effect(spark, prose, tmp_path):
    texts = tables(spark, prose, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert name == "sentencepiece" or docs.columns == columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {i for i in texts if i >= 200 or i % 4}
    assert set(seen["quality"]) == good
    assert set(seen["simhash_dedup"]) == good - {200}
    assert set(seen["decontaminate"]) == set(seen["secrets"]) == good - {200, 201}
    assert "[SECRET]" in seen["secrets"][202]["text"] and "04dbebab" not in seen["secrets"][202]["text"]
    assert all(seen["secrets"][i]["text"] == texts[i] for i in good - {200, 201, 202})
    codec = sentencepieces.ChunkCodec(sentencepieces.read_model())
    for i, r in seen["sentencepiece"].items():
        assert codec.sp.decode(r["ids"]) == seen["secrets"][i]["text"]
    ran = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {i: r["ids"] for i, r in seen["sentencepiece"].items()}


def test_odd_rows_and_empty_tables(spark, prose, tmp_path):
    tables(spark, prose, f"{tmp_path}/a", [(300, None), (301, ""), (None, prose(5, 50)), (302, "x")])
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 0
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, f"{tmp_path}/a").count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash_dedup", "decontaminate", "secrets", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None and simhash.MAX_BITS == 2


def test_small_batches_unless_the_session_names_a_size(spark, docs):
    from clausewright.llm import stage

    key, held = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.unset(key)
        corpus_pipeline.hide_secrets(spark, docs([(1, "x")]), "")
        assert spark.conf.get(key) == stage.BATCH_BYTES
        spark.conf.set(key, "9m")
        corpus_pipeline.tokenize(spark, docs([(1, "x")]), "")
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.set(key, held)
