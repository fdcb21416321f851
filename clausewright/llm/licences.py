"""Licence scans: TF-IDF cosine to templates, then inheritance along directories.

Headers are stretches of words of several widths about every licence word of a
text; licence files (by their name) are compared in overlapping stretches of the
whole file as well. Words are weighted by their rarity among the templates; a word
that no template has is as rare as can be and counts in a stretch's norm. A file
without a licence of its own takes that of the nearest directory above it which
holds a licence file.

Defined results: every row gives one row; null and empty texts have no licence
of their own but may inherit; very long texts are searched whole; a null path
lies in the root, whose directory is the empty string, and repeated rows repeat; a
licence that another one's text contains (GENERIC) gives way to it, ties of cosine
go to the alphabetically last licence, ties of licence files in one directory to
the higher cosine and then the last name; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import stage

#: Least cosine of a header or licence file to its template, and least number of different template words.
COSINE, WORDS = 0.6, 3
#: Tasks that the files of one directory are dealt to.
SALTS = 64
#: Titles, short notices and characteristic passages of public licences.
TEMPLATES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Artistic-1.0", "The \"Artistic License\" Preamble The intent of this document is to state the conditions under which a Package may be copied"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("ISC", "ISC License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain. CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
]
#: Licences whose passages are part of others.
GENERIC = {"BSD-2-Clause"}
#: What every text with a header has, and the words that headers stand about.
KEYWORD = r"(?i:licen[cs]e|spdx|public\s+domain|hereby\s+granted|redistribution\s+and\s+use|neither\s+the\s+name|legal\s+code\s+cc0)"
_LICENCE_WORD = r"^(?:(?:un)?licen[cs].*|spdx|redistribution|hereby|neither|unencumbered|cc0)$"
#: Words before a licence word, and words from it on, of the stretches compared: titles, short notices and passages.
AROUND = ((0, 5), (1, 3), (1, 7), (2, 3), (3, 5), (3, 6), (4, 3), (4, 5), (4, 8), (0, 24), (0, 30), (10, 41))
#: Words of the stretches of a licence file, and of the steps between them.
TILE, STEP = 40, 20
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)s?([-_.].*)?$"
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"


def _weights() -> tuple[list[tuple[str, dict[str, float]]], dict[str, float]]:
    bags = [(name, Counter(re.findall(_TOKEN, text.lower()))) for name, text in TEMPLATES]
    holds = Counter(w for _, bag in bags for w in bag)
    idf = {w: math.log(1 + len(bags) / n) for w, n in holds.items()}
    out = []
    for name, bag in bags:
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
        out.append((name, {w: n * idf[w] / norm for w, n in bag.items()}))
    return out, idf


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


#: Least share of a text's weight, that of words in the templates' vocabulary, that makes it a licence file.
MOSTLY = 0.5


def mostly_licence(text: Column) -> Column:
    """Whether a text is in the main a licence or a notice of one: at least half of its TF-IDF weight is of words that
    templates have. False for null."""
    templates, idf = _weights()
    rare = math.log(1 + len(templates))
    groups: dict[float, list[str]] = {}
    for word, weight in idf.items():
        groups.setdefault(weight, []).append(word)

    def share(words: Column) -> Column:
        among = lambda group: F.size(F.filter(words, lambda w: w.isin(*group)))
        of = [among(g) for g in groups.values()]
        known, count = of[0] * list(groups)[0], of[0]
        for n, weight in zip(of[1:], list(groups)[1:], strict=True):
            known, count = known + n * weight, count + n
        return known / (known + (F.size(words) - count) * rare)

    found = F.transform(F.array(_words(text)), share)[0]
    return F.coalesce(F.when(text.rlike(KEYWORD), found >= MOSTLY), F.lit(False))


def _headers(words: Column) -> Column:
    """Stretches of AROUND words about every licence word."""
    hits = F.filter(F.transform(words, lambda w, k: F.when(w.rlike(_LICENCE_WORD), k + 1)), lambda k: k.isNotNull())

    def stretch(k: Column, before: int, after: int) -> Column:
        start = F.greatest(k - before, F.lit(1))
        return F.slice(words, start, k - start + after)

    return F.flatten(F.transform(hits, lambda k: F.array(*[stretch(k, *n) for n in AROUND])))


def _tiles(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(STEP)), lambda k: F.slice(words, k, TILE))


def scanned(files: DataFrame) -> DataFrame:
    """One pass over the texts: ``(row, id, path, is_file, parts)``, where parts are the
    words of each different header and, of a licence file, of its tiles."""
    is_file = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    parts = lambda words: F.when(is_file, F.concat(_headers(words), _tiles(words))).otherwise(_headers(words))
    bound = F.transform(F.array(_words(F.col("text"))), parts)[0]  # the words are cut once
    held = F.when(F.col("text").isNotNull() & (is_file | F.col("text").rlike(KEYWORD)), F.array_distinct(bound))
    return stage(files.select(F.monotonically_increasing_id().alias("row"), "id", "path", is_file.alias("is_file"), held.alias("parts")), "licence-headers")


def own_licences(parts: DataFrame) -> DataFrame:
    """``(row, own)``: ``struct<cosine, licence>`` of the rows with a licence of their own.

    Sparse TF-IDF: the words of a part meet the templates' vocabulary, a table of
    fixed size, which holds each word's rarity and its weight in every template.
    """
    templates, idf = _weights()
    vocabulary = F.broadcast(parts.sparkSession.createDataFrame([(w, x, [t.get(w, 0.0) for _, t in templates]) for w, x in idf.items()], "word string, idf double, weights array<double>"))
    words = parts.select("row", F.posexplode("parts").alias("part", "words")).select("row", "part", F.explode("words").alias("word"))
    bags = words.groupBy("row", "part", "word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left")
    x = F.col("n") * F.coalesce("idf", F.lit(math.log(1 + len(templates))))
    dots = [F.sum(x * F.col("weights")[k]).alias(f"d{k}") for k in range(len(templates))]
    sums = bags.groupBy("row", "part").agg(F.sqrt(F.sum(x * x)).alias("norm"), F.count("idf").alias("words"), *dots)
    found = [F.struct((F.col(f"d{k}") / F.col("norm")).alias("cosine"), F.lit(name).alias("licence")) for k, (name, _) in enumerate(templates)]
    special = lambda c: F.struct((~c["licence"].isin(*GENERIC)).alias("special"), c["cosine"].alias("cosine"), c["licence"].alias("licence"))
    best = F.array_max(F.transform(F.filter(F.array(*found), lambda c: c["cosine"] >= COSINE), special))
    best = sums.filter(F.col("words") >= WORDS).select("row", best.alias("own")).filter("own is not null").groupBy("row").agg(F.max("own").alias("own"))
    return best.select("row", F.struct("own.cosine", "own.licence").alias("own"))


def scan(files: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """``(id_col, path, licence, cosine, origin, licence_dir)`` of every row.

    ``origin``: ``own``, ``inherited`` or null without a licence.
    """
    src = files.select(F.col(id_col).alias("id"), F.ltrim(F.coalesce((F.lit("") if path is None else path).cast("string"), F.lit("")), F.lit("/")).alias("path"), F.col(text_col).alias("text"))
    slim = scanned(src).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    own = stage(own_licences(slim), "licences-own")
    dirs = slim.filter("is_file").join(own, "row").groupBy(F.col("dir").alias("licence_dir")).agg(F.max("own").alias("given"))
    # each directory climbs to its ancestors once, however many files it holds
    steps = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))
    climbs = slim.select("dir").distinct().select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "licence_dir"))
    nearest = climbs.join(dirs, "licence_dir").groupBy("dir").agg(F.max_by(F.struct("licence_dir", "given"), "depth").alias("up"))
    # a directory may hold a third of all files: its rows are dealt to SALTS tasks
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = slim.join(own, "row", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["dir", "salt"], "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited")
    return joined.select(F.col("id").alias(id_col), "path", F.coalesce("own.licence", "up.given.licence").alias("licence"), F.coalesce("own.cosine", "up.given.cosine").alias("cosine"), origin.alias("origin"), F.when(origin == "inherited", F.col("up.licence_dir")).alias("licence_dir"))
