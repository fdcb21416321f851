"""Training of the language model stays finite and right on samples of any size, and rejection means something."""

import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest

from clausewright.llm import language
from clausewright.llm.queries import queries

TABLE = "/root/testdata/sf0.1/documents.parquet"


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"select doc_id, text, lang from '{TABLE}' where text is not null and lang is not null and length(text) < 5000 order by doc_id").fetchall()
    names = sorted({r[2] for r in rows})
    counts = np.concatenate([language.gram_counts([r[1].lower().encode() for r in rows[k : k + 128]]).astype(np.float32) for k in range(0, len(rows), 128)])
    held = np.array([zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows])
    return rows, counts, np.array([names.index(r[2]) for r in rows]), held, names


def test_every_sample_trains(texts):
    _, counts, y, held, names = texts
    free = np.nonzero(~held)[0]
    for seed, n in enumerate(np.linspace(400, 4000, 20).astype(int)):
        some = np.random.default_rng(seed).permutation(free)[:n]
        table, bias = language._descend(language._unit(counts[some]), y[some], len(names), np.random.default_rng(2))
        assert np.isfinite(table).all()
        right = ((language._unit(counts[held]) @ table + bias).argmax(1) == y[held]).mean()
        assert right >= 0.97, (seed, n, right)


def test_weights_that_are_not_finite_are_an_error(monkeypatch):
    monkeypatch.setattr(language, "RATE", float("nan"))
    with pytest.raises(ArithmeticError):
        language._descend(np.ones((4, language.BUCKETS)), np.array([0, 1, 0, 1]), 2, np.random.default_rng(1))


def test_query_on_held_out_rows(spark):
    got = queries()["op2_language"](spark, "/root/testdata/sf0.01").toPandas()
    truth = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet' where text is not null and lang is not null").fetchall())
    out = got[got.held_out & got.doc_id.isin(truth)]
    right = out.lang_pred == out.doc_id.map(truth)
    assert right.mean() >= 0.97 and got.score.between(0, 1).all() and out.score.nunique() > 100
    assert out.rejected[~right].mean() >= 0.5 or right.all()
    assert out.rejected.mean() < 0.2


def test_nonsense_is_rejected(spark, docs, texts):
    rows, *_, names = texts
    model = language.fit(docs([(r[0], r[1], r[2]) for r in rows[:800]]))
    rng = np.random.default_rng(3)
    noise = [" ".join("".join(rng.choice(list("qxzjkvwpbdfg"), rng.integers(2, 9))) for _ in range(30)) for _ in range(100)]
    got = language.predict(docs(list(enumerate(noise))), model).collect()
    assert np.mean([r["rejected"] for r in got]) > 0.8 and {r["lang_pred"] for r in got} <= set(names)


def test_letters_are_unicode_letters(docs):
    model = language.fit(docs([(i, "der Hund und die Katze", "de") for i in range(6)]))
    odd = ["½ ² ① 12", "ª", "漢", "_ 9", "é"]
    got = [r["lang_pred"] for r in language.predict(docs(list(enumerate(odd))), model).orderBy("doc_id").collect()]
    assert got == ["und", "de", "de", "und", "de"]


def test_training_holds_one_table_of_counts(monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 1)
    rng, n = np.random.default_rng(4), 4096
    counts = rng.integers(0, 2, (n, language.BUCKETS)).astype(np.float32)
    held = np.arange(n) % 2 == 0
    tracemalloc.start()
    model = language._train(counts, rng.integers(0, 3, n), ["a", "b", "c"], held, ~held, np.zeros(n, bool))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(model.table).all() and most < 64 << 20  # the table itself has 64 MB
