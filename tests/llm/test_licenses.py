import math
import re

import duckdb
import pytest

from mnemora.llm import queries
from mnemora.llm.licenses import LEAST, TEMPLATES, licence_scan

WORD = re.compile(r"[^\W_]+")
SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


def cosine(files):
    """Plain TF-IDF over all units; the score and licence of each text."""
    texts = [t for _, t in files if t is not None]
    vocabulary = {w for _, t in TEMPLATES for w in WORD.findall(t.lower())}
    df = {w: sum(w in set(WORD.findall(t.lower())) for t in texts) for w in vocabulary}
    weight = lambda w: math.log((1 + len(texts)) / (1 + df.get(w, 0))) + 1

    def vector(text):
        words = WORD.findall(text.lower())
        return {w: words.count(w) * weight(w) for w in words}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))

    templates = [(n, vector(t)) for n, t in TEMPLATES]
    out = []
    for path, text in files:
        units = re.split(r"\n|[.;!?]\s+", text) + [u for u in re.split(r"\n[^\w\n]*\n", text.replace("_", "-")) if "\n" in u] if text is not None else []
        if text is not None and re.search(r"(?i)(^|/)(licen[cs]e|copying)[^/]*$", path or ""):
            units.append(text)
        found = []
        for v in filter(None, map(vector, units)):
            found += [(-round(sum(x * v.get(w, 0) for w, x in t.items()) / norm(t) / norm(v), 6), n) for n, t in templates]
        found = [f for f in found if -f[0] >= LEAST]
        out.append((-min(found)[0], min(found)[1]) if found else None)
    return out


def test_units_match_a_plain_loop(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    files = [(f"d/{i}.txt", r.text) for i, r in enumerate(rows)]
    files += [("a/LICENSE", "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this software"), ("x", None), ("y", ""), ("z", "Mit Licence. Released under the MIT license; and so on")]
    got = {r.path: r for r in licence_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for (path, _), own in zip(files, cosine(files)):
        r = got[path]
        assert (r.own_license is None) == (own is None), path
        if own:
            assert r.own_license == own[1] and r.own_score == pytest.approx(own[0], abs=2e-6)
    assert got["a/LICENSE"].own_license == "MIT" and sum(r.own_license is not None for r in got.values()) > 5


def test_inheritance(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        (1, "LICENSE", mit, "x"), (2, "a/b/c.txt", "words", "x"), (3, "a/COPYING", apache, "x"), (4, "a/b/d/e.txt", None, "x"), (5, "ab/f.txt", "", "x"),
        (6, "a/b/own.txt", f"x\n{mit}", "x"), (7, None, mit, "x"), (8, None, "w", "x"), (9, "top.txt", "w", "x"), (9, "top.txt", "w", "x"), (10, "a/b/LICENSE", "no licence here", "x"),
    ]
    out = licence_scan(spark.createDataFrame(rows, "id int, path string, text string, license string"))
    got = sorted((r.id, r.license, r.found_in) for r in out.collect())
    assert got == [(1, "MIT", None), (2, "Apache-2.0", "a"), (3, "Apache-2.0", None), (4, "Apache-2.0", "a"), (5, "MIT", ""), (6, "MIT", None), (7, "MIT", None), (8, None, None), (9, "MIT", ""), (9, "MIT", ""), (10, "Apache-2.0", "a")]
    assert licence_scan(spark.createDataFrame([], "id int, path string, text string")).count() == 0


HEADERS = {
    "GPL-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY.""",
    "Apache-2.0": """/*
 * Copyright 2020 The Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */""",
    "MIT": "// SPDX-License-Identifier: MIT\nint main() { return 0; }",
    "CC-BY-4.0": "Words.\nThis work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "// Copyright 2009. \n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage x",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
}


def test_real_headers(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").select("text").collect()]
    files = [(f"d/{i}.txt", t) for i, t in enumerate(texts)] + [(f"h/{n}.c", t) for n, t in HEADERS.items()]
    files += [("p/readme.md", "This project is licensed under the MIT License - see the LICENSE file for details."), ("q/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Nyone\n")]
    got = {r.path: r.own_license for r in licence_scan(spark.createDataFrame(files, "path string, text string")).where("path not like 'd/%'").collect()}
    assert got == {f"h/{n}.c": n for n in HEADERS} | {"p/readme.md": "MIT", "q/LICENSE": "MIT"}


def test_a_megabyte_without_a_sentence_end(spark):
    import time

    long = "license released " + " ".join(f"w{i % 50000}" for i in range(150_000))
    df = spark.createDataFrame([("a", long), ("b", "Released under the MIT License")], "path string, text string")
    licence_scan(df.limit(0)).collect()
    began = time.time()
    assert {r.path: r.license for r in licence_scan(df).collect()} == {"a": None, "b": "MIT"}
    assert len(long) > 900_000 and time.time() - began < 30


def test_clashing_columns(spark):
    schema = "path string, text string, __own string, __dir string, __salt string, at string, dir string, tags map<string,string>, own_score string"
    out = licence_scan(spark.createDataFrame([("a/b", "Released under the MIT License", "1", "2", "3", "4", "5", {"a": "b"}, "6"), (None, None, *[None] * 7)], schema))
    assert out.columns == ["__own", "__dir", "__salt", "at", "dir", "tags", "path", "own_license", "own_score", "license", "found_in"]
    assert sorted(map(tuple, out.collect()), key=str) == [("1", "2", "3", "4", "5", {"a": "b"}, "a/b", "MIT", 1.0, "MIT", None), (*[None] * 11,)]


def test_query_matches_its_sql(spark):
    got = sorted(map(tuple, queries.op1_license_scan(spark, SF_MORE).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF_MORE}/documents.parquet'")
    want = sorted(db.execute(queries.ORACLE_SQL["op1_license_scan"]).fetchall(), key=str)
    assert got == want
    assert sum(r[5] is not None for r in got) > 5
