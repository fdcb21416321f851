import math
import re

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clausewright.llm import licences, secrets

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
KEY = "AKIA" + "QX7RT2PLM4ZV9KDW"


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.fit(secrets.labelled_findings(spark))


def test_forest_tells_secrets_from_lookalikes(spark, forest):
    held_out = secrets.labelled_findings(spark, each=20, seed=77)
    table = forest.transform(secrets._assembled(held_out))
    x, path = F.array(*secrets.features(*(F.col(c) for c in ("value", "before", "after")), F.col("path"))), vector_to_array("probability")[1]
    got = table.select("label", path.alias("of_model"), secrets.unrolled(forest).score(x).alias("score")).collect()
    assert sum(r["label"] == (r["score"] >= secrets.THRESHOLD) for r in got) / len(got) > 0.95
    assert all(r["score"] == pytest.approx(r["of_model"], abs=1e-9) for r in got)


def test_findings_on_odd_rows(docs, odd, forest):
    rows = odd + [(50, f'words token = "{HEX}" more. {HEX.upper()}'), (51, f"api_key: {KEY}\ncommit {HEX}"), (52, "mail 49@mail9.example.com and 2669109448945250"), (None, f"token = '{HEX}'"), (50, f'words token = "{HEX}" more. {HEX.upper()}')]
    got = secrets.findings(docs(rows), forest).collect()
    brute = sorted((str(i), m) for i, t in rows for m in (re.findall(r"(?<![A-Za-z0-9_+/=.\-])(?=[A-Za-z_+/=.\-]{0,60}[0-9])[A-Za-z0-9_+/=.\-]{16,}", t or "")))
    assert sorted((str(r["doc_id"]), r["value"]) for r in got) == brute
    told = {(r["doc_id"], r["value"]) for r in got if r["is_secret"]}
    assert {(50, HEX), (51, KEY), (None, HEX)} <= told
    assert not any(i == 52 for i, _ in told) and (51, HEX) not in told


def test_redact(docs, odd, forest):
    rows = odd + [(50, f'a token = "{HEX}" b token = "{HEX}"'), (None, f"token = '{HEX}'"), (60, "clean text 12")]
    frame = docs(rows)
    out = secrets.redact(frame, forest)
    assert out.columns == frame.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    assert got == sorted((str(i), str(t if t is None else t.replace(HEX, "[SECRET]"))) for i, t in rows)


def test_secrets_empty(docs, forest):
    assert secrets.findings(docs([]), forest).collect() == []
    assert secrets.redact(docs([]), forest).collect() == []


def test_licences_and_inheritance(spark, prose):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 100)
    rows = [
        (1, "repo/LICENSE", mit), (2, "repo/src/a.py", prose(1)), (3, "repo/src/deep/er/b.py", None), (4, "repo/vendor/COPYING.txt", "This work is licensed under the GNU General Public License, version 3"),
        (5, "repo/vendor/x.c", ""), (6, "repo/vendor/y.c", prose(2) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(3)), (7, "other/z.c", prose(4)), (8, None, prose(5)), (9, "repo/licensed.py", "my driver license is here"),
        (10, "/repo/src/a.py", prose(1)), (2, "repo/src/a.py", prose(1)), (None, "repo/n.py", prose(6)), (11, "repo/LICENSE", None), (12, "repo/up.py", "LICENSED!! UNDER!! CC!! BY-NC!! 4.0.!!"),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, p string, text string, licence string, row int")
    got = sorted(((str(r["doc_id"]), r["licence"], r["origin"], r["licence_dir"]) for r in licences.scan(df, path=df["p"]).collect()), key=str)
    own, up = (lambda i, n: (str(i), n, "own", None)), (lambda i, n, d: (str(i), n, "inherited", d))
    expected = [own(1, "MIT"), up(2, "MIT", "repo"), up(2, "MIT", "repo"), up(3, "MIT", "repo"), own(4, "GPL-3.0"), up(5, "GPL-3.0", "repo/vendor"), own(6, "Apache-2.0"), ("7", None, None, None), ("8", None, None, None), up(9, "MIT", "repo"), up(10, "MIT", "repo"), up(None, "MIT", "repo"), up(11, "MIT", "repo"), own(12, "CC-BY-NC-4.0")]
    assert got == sorted(expected, key=str)


def test_cosine_equals_plain_tfidf(spark):
    templates, idf = licences._weights()
    texts = ["Released under the MIT License", "licensed under gnu general public license version 3 or later", "software license"]
    texts.append("released under the strange mit license of the unknown valley")
    parts = spark.createDataFrame([(k, [re.findall(licences._TOKEN, t.lower())]) for k, t in enumerate(texts)], "row bigint, parts array<array<string>>")
    got = {r["row"]: r["own"]["cosine"] for r in licences.own_licences(parts).collect()}
    for k, t in enumerate(texts):
        words = re.findall(licences._TOKEN, t.lower())
        x = {w: words.count(w) * idf.get(w, math.log(1 + len(templates))) for w in words}  # unknown words count as well
        norm = sum(v * v for v in x.values()) ** 0.5
        best = max(sum(v * w.get(n, 0) for n, v in x.items()) / norm for _, w in templates)
        if len(x.keys() & idf.keys()) >= licences.WORDS and best >= licences.COSINE:
            assert got[k] == pytest.approx(best)
        else:
            assert k not in got


def test_licences_empty(docs):
    none = docs([])
    assert licences.scan(none, path=none["path"]).collect() == []
