from pathlib import Path

import pytest

from pyspark.sql import functions as F

from clausewright.llm import licences
from clausewright.llm.queries import queries

#: Whole licences where the machine has them.
SHARED = Path("/usr/share/common-licenses")
WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
MIT = """MIT License

Copyright (c) 2024 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD2 = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


@pytest.mark.parametrize("name", ["LICENSE", "notes.txt"])
def test_whole_licences(spark, name):
    """Whole licence texts are named rightly, as licence files and as other files."""
    texts = [(MIT, "MIT"), (BSD2, "BSD-2-Clause"), *(((SHARED / f).read_text(), want) for f, want in WHOLE.items() if (SHARED / f).exists())]
    df = spark.createDataFrame([(k, f"d{k}/{name}", t) for k, (t, _) in enumerate(texts)], "doc_id bigint, p string, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(df, path=df["p"]).collect()}
    wrong = [(want, got[k]) for k, (_, want) in enumerate(texts) if got[k] != want]
    assert wrong == []


def test_texts_without_a_licence(spark, prose):
    rows = ["my driver license is here and my dog is not", "the software licence market grew in 2019 as the public domain shrank", "neither the name nor the place was known", prose(1, 500), "A license fee of version 2.0 is due in January 2004"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id bigint, text string")
    assert [r["licence"] for r in licences.scan(df).collect()] == [None] * len(rows)


def test_query_names_the_notices_of_the_documents_and_inherits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = {"Released under the MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "GNU General Public License, version 3": "GPL-3.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0"}
    want = {r["doc_id"]: name for r in docs.collect() for mark, name in marks.items() if mark in (r["text"] or "")}
    got = {r["doc_id"]: r for r in queries()["op3_licences"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count()
    assert {i: r["licence"] for i, r in got.items() if r["origin"] == "own"} == want
    up = [r for r in got.values() if r["origin"] == "inherited"]
    givers = {r["path"].split("/")[0]: r["licence"] for r in got.values() if "/LICENSE-" in r["path"]}
    assert len(up) > 20 and all(r["licence"] == givers[r["path"].split("/")[0]] for r in up)


@pytest.mark.parametrize("gap", [0, 1, 5, 20, 38, 60])
def test_notices_after_another_licence_word(docs, prose, gap):
    """A notice is found however near an earlier licence word stands."""
    notices = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    rows, want = [], {}
    for k, (notice, name) in enumerate(notices.items()):
        rows.append((k, f"Please carry your license with you. {prose(k, gap) if gap else ''} {notice} {prose(k + 50, 60)}"))
        want[k] = name
    df = docs(rows)
    got = {r["doc_id"]: r["licence"] for r in licences.scan(df, path=df["source"]).collect()}
    assert got == want


def test_licence_files_are_told_by_content(spark):
    """Whole licences of any length are, prose that names one is not, however short."""
    long = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 150)
    rows = [(1, long), (2, "Released under the MIT License"), (3, "SPDX-License-Identifier: MIT"), (4, "My garden has a licence for tulips, roses and birds."), (5, "MIT License. " + "zebra quagga okapi " * 9), (6, None), (7, ""), (8, long + " " + long)]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k int, t string").select("k", licences.mostly_licence(F.col("t")).alias("m")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: True}
