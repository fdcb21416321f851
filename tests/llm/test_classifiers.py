import random
import zlib

import numpy as np
import pytest

from clausewright.llm import language, quality, stage, tokens, toxicity
from clausewright.llm.queries import queries

LANGS = {"en": "the of and with that for was this from have are been".split(), "de": "der die und mit nicht eine werden haben für über schön".split(), "fr": "les des une avec pour dans est être été où çà que".split()}
BAD = ["idiot", "moron", "scum"]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(n=360):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        words = [rng.choice(LANGS[lang]) + rng.choice(["", "en", "ix"]) for _ in range(rng.randint(20, 60))]
        toxic, poor = int(rng.random() < 0.3), int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        text = " ".join(w + "###" for w in words) if poor else " ".join(words) + "."
        rows.append((i, text, lang))
        labels.append((i, 1 - poor, toxic))
    return rows, labels


def test_fold_is_crc32_of_the_id(spark):
    ids = [0, 1, 7, 12345, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select(stage.fold().alias("f")).collect()
    assert [r["f"] for r in got] == [None if i is None else zlib.crc32(str(i).encode()) % 3 for i in ids]


def test_word_hashes_depend_on_the_word_alone():
    one, counts = tokens.word_hashes([b"alpha beta, alpha", b"", b"!!", "é-beta".encode()])
    assert counts.tolist() == [3, 0, 0, 2]
    assert one[0] == one[2] and one[1] == one[4] and len(set(one.tolist())) == 3
    assert (tokens.word_hashes([b"x" * 500 + b" y"])[0] != tokens.word_hashes([b"x" * 501 + b" y"])[0]).any()


def test_language(docs, odd):
    rows, _ = corpus()
    frame = docs(rows + [(1000 + k, t) for k, (_, t) in enumerate(odd)])
    model = language.fit(frame)
    truth = {r[0]: r[2] for r in rows}
    got = language.predict(frame, model).collect()
    assert len(got) == len(rows) + len(odd)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and held(r["doc_id"])]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    for k, (_, t) in enumerate(odd):
        letter = any(c.isalpha() for c in t or "")
        assert (by_id[1000 + k]["lang_pred"] != "und") == letter
    again = language.predict(docs([(9, rows[0][1], "xx")]), model).collect()[0]
    assert (again["lang_pred"], again["score"]) == (by_id[0]["lang_pred"], by_id[0]["score"])


def test_language_without_labels(docs):
    frame = docs([(1, "some text"), (2, None)])
    assert language.fit(frame) is None
    assert [r["lang_pred"] for r in language.predict(frame, None).collect()] == ["und", "und"]
    assert language.predict(docs([]), None).collect() == []


def test_training_ignores_fold_one(docs):
    rows = [(i, f"wort{i} und die", "zz" if held(i) else "de") for i in range(30)]
    assert language.fit(docs(rows)).languages == ["de"]


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, quality int, toxic int, text string")


def test_toxicity(spark, docs, odd):
    rows, labels = corpus(900)
    frame, marks = docs(rows), labelled(spark, labels + [(None, 1, 1), (5000, 0, 1), (1, None, None), (2, 7, 7)])
    model = toxicity.fit(frame, marks, lang_col="lang")
    truth = {r[0]: r[2] for r in labels}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert np.mean([(got[i] >= 0.7) == truth[i] for i in truth if held(i)]) > 0.95
    named = toxicity.score(docs(odd), model, lang_col="lang").collect()
    assert len(named) == len(odd) and all(0 <= r["score"] <= 1 and r["toxic"] == (r["score"] >= r["threshold"]) for r in named)
    lone = {r["doc_id"]: r["score"] for r in toxicity.score(docs([(1, "IDIOT!"), (2, "the"), (3, ""), (4, None)]), model).collect()}
    assert lone[1] >= 0.7 > max(lone[2], lone[3]) and lone[3] == lone[4]
    assert set(model.thresholds) <= set(LANGS)


def test_toxicity_without_labels(spark, docs):
    none = labelled(spark, [])
    assert toxicity.fit(docs([(1, "x")]), none) is None
    assert [r["score"] for r in toxicity.score(docs([(1, "x")]), None).collect()] == [0.0]
    assert toxicity.score(docs([]), None).collect() == []


def test_quality(spark, docs, odd):
    rows, labels = corpus()
    frame, marks = docs(rows + [(1000 + k, t) for k, (_, t) in enumerate(odd)]), labelled(spark, labels + [(None, 1, 1), (5000, 0, 1), (1, None, None), (2, 7, 7)])
    feats = stage.stage(quality.features(frame), "t")
    model = quality.fit(feats, marks)
    truth = {r[0]: r[1] for r in labels}
    got = {r["doc_id"]: r["score"] for r in quality.score(feats, model).collect()}
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in truth if held(i)]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert (np.diff(model.values) >= 0).all() and (np.diff(model.knots) > 0).all()
    inline = {r["doc_id"]: r["s"] for r in frame.select("doc_id", quality.scorer(model)("text").alias("s")).collect()}
    assert inline == pytest.approx(got)
    kept = quality.keep(frame, marks)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in frame.select("doc_id", quality.scorer(model)("text").alias("s")).filter("s >= 0.5").collect())


def test_normal_equations_equal_a_plain_fit(spark, docs):
    rows, labels = corpus(200)
    feats = stage.stage(quality.features(docs(rows).repartition(5)), "t")
    model = quality.fit(feats, labelled(spark, labels))
    x = np.array([quality.statistics(t) for i, t, _ in rows if not held(i)])
    y = np.array([label[1] for label in labels if not held(label[0])], float)
    z = model.lift(x)
    ridge = quality.RIDGE * len(x) * np.diag([1.0] * quality.FEATURES + [0.0])
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + ridge, z.T @ y), abs=1e-6)


def test_isotonic():
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1.0, 1, 1, 2, 1])) == pytest.approx([0.1, 0.3, 0.3, 0.3, 0.9])


def test_quality_without_labels(spark, docs):
    feats = quality.features(docs([(1, "x"), (2, None)]))
    assert [r["score"] for r in quality.score(feats, quality.fit(feats, labelled(spark, []))).collect()] == [0.5, 0.5]
    assert quality.features(docs([])).collect() == []


@pytest.mark.parametrize("name,columns", [("op2_language", ["doc_id", "held_out", "lang_pred", "score"]), ("op6_toxicity", ["doc_id", "held_out", "score", "predicted"]), ("op10_quality", ["doc_id", "held_out", "score", "predicted"])])
def test_queries(spark, docs, tmp_path, name, columns):
    rows, labels = corpus(200)
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries()[name](spark, str(tmp_path))
    assert got.columns[: len(columns)] == columns
    found = got.collect()
    assert len(found) == 200 and all(r["held_out"] == held(r["doc_id"]) for r in found)
