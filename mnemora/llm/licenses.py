"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Everything runs on built-in functions. A text's units are its lines and sentences, its paragraphs of several lines (parted by lines without
letters or digits, so that a header inside a comment is one), and for licence files also the whole text. Document frequencies of the templates' words are counted over all texts; a word of no template weighs as one
that no text has. A unit's licence is the template of highest cosine, from `least` up.

Only the weights of the templates' words (a fixed vocabulary) reach the driver. With them it splits the vocabulary:
words without which no unit can reach `least` (by Cauchy-Schwarz, the rest of each template's vector is too
short) gate the texts, so that few are compared; the gate loses nothing. Nor does the second bound: a unit whose template words
are too small a part of its length is dropped before it is compared. Words are counted as runs of the sorted unit, so
the work is linear in a text but for the sort. Scores are row by row. Licences
of directories are grouped, joined to the ancestors of the distinct directories, and the
nearest one is joined back to files on (directory, salt), so that a directory with most of the files is dealt out.

Edge cases: a null text has no licence of its own but may inherit; a null path lies in no directory; repeated rows each
get a row; of equal scores the first licence by name counts; columns beside path and text are carried along. Empty
in, empty out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.shared import cut, free_name

# Public notices, headings and tags by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0 - see the LICENSE file for details"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
LEAST = 0.75
WORD_GAP = r"[^\p{L}\p{N}]+"
UNIT_GAP = r"\n|[.;!?]\s+"
PARAGRAPH_GAP = r"\n[^\p{L}\p{N}\n]*\n"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
SALTS = 16


def _literal(x) -> str:
    return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(text: str) -> str:
    return f"filter(split(lower({text}), {_literal(WORD_GAP)}), w -> w <> '')"


def _plain_words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]


def _map(pairs: dict[str, float]) -> str:
    return "map(" + ", ".join(f"{_literal(w)}, double({x!r})" for w, x in sorted(pairs.items())) + ")"


def _array(words) -> str:
    return "array(" + ", ".join(map(_literal, sorted(words))) + ")"


def weights(files: DataFrame, vocabulary: set[str]) -> tuple[dict[str, float], float]:
    """ln((1 + texts) / (1 + texts with the word)) + 1 of each template word, and of a word that no text has."""
    present = files.where("text is not null").select(F.expr(f"array_intersect({_array(vocabulary)}, split(lower(text), {_literal(WORD_GAP)}))").alias("words"))
    counts = present.select(F.explode(F.concat("words", F.array(F.lit("")))).alias("word")).groupBy("word").count()
    seen = {r.word: r["count"] for r in counts.collect()}  # at most the vocabulary and ''
    n = seen.get("", 0)
    return {w: math.log((1 + n) / (1 + seen.get(w, 0))) + 1 for w in vocabulary}, math.log(1 + n) + 1


def template_vectors(weight: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """Unit vectors of the templates."""
    out = []
    for name, text in TEMPLATES:
        words = _plain_words(text)
        vector = {w: words.count(w) * weight[w] for w in words}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        out.append((name, {w: x / norm for w, x in vector.items()}))
    return out


def gate_words(vectors: list[tuple[str, dict[str, float]]], weight: dict[str, float], least: float) -> set[str]:
    """Words one of which each unit that reaches `least` must have."""
    loose: set[str] = set()
    for w in sorted(weight, key=lambda w: (weight[w], w)):
        more = loose | {w}
        if all(sum(x * x for v, x in t.items() if v in more) < (least - 1e-9) ** 2 for _, t in vectors):
            loose = more
    return set(weight) - loose


def with_own_licence(files: DataFrame, name: str, least: float = LEAST) -> DataFrame:
    """files with a column `name`: the struct (score, licence) of the best unit, null below `least`."""
    vocabulary = {w for _, t in TEMPLATES for w in _plain_words(t)}
    weight, unseen = weights(files, vocabulary)
    vectors = template_vectors(weight)
    gate = _array(gate_words(vectors, weight, least))
    units = f"transform(concat(split(text, {_literal(UNIT_GAP)}), filter(split(text, {_literal(PARAGRAPH_GAP)}), u -> instr(u, '\\n') > 0), if(path rlike {_literal(LICENCE_FILE)}, array(text), array())), u -> {_words('u')})"
    # sorted words; where a run of equal ones begins; (word, count) of each run
    listed = f"transform(filter({units}, ws -> arrays_overlap(ws, {gate})), ws -> array_sort(ws))"
    heads = "filter(sequence(0, size(s) - 1), i -> i = 0 or get(s, i) <> get(s, i - 1))"
    runs = f"flatten(transform(array({heads}), h -> transform(h, (p, k) -> struct(get(s, p) as w, double(coalesce(get(h, k + 1), size(s)) - p) as n))))"
    known = f"filter(transform(v, e -> struct(e.w as w, e.n * element_at({_map(weight)}, e.w) as x)), e -> e.x is not null)"
    length = f"aggregate(v, 0D, (a, e) -> a + power(e.n * coalesce(element_at({_map(weight)}, e.w), double({unseen!r})), 2))"
    sized = f"transform(transform({listed}, s -> {runs}), v -> struct({known} as own, {length} as n2))"
    near = f"filter({sized}, u -> aggregate(u.own, 0D, (a, e) -> a + e.x * e.x) >= {(least - 1e-6) ** 2!r}D * u.n2)"
    dots = ", ".join(f"struct(aggregate(u.own, 0D, (a, e) -> a + e.x * coalesce(element_at({_map(t)}, e.w), 0D)) as dot, {_literal(name)} as name)" for name, t in vectors)
    best = f"transform({near}, u -> transform(array({dots}), d -> struct(round(d.dot / sqrt(u.n2), 6) as score, d.name as licence)))"
    chosen = f"array_sort(filter(flatten({best}), s -> s.score >= {least}D), (a, b) -> if(a.score <> b.score, if(a.score > b.score, -1, 1), if(a.licence < b.licence, -1, if(a.licence > b.licence, 1, 0))))"
    gated = f"arrays_overlap(split(lower(text), {_literal(WORD_GAP)}), {gate})"
    return files.withColumn(name, F.expr(f"case when {gated} then try_element_at({chosen}, 1) end"))


def licence_scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """files without text, with own_license, own_score, license (own, else that of the nearest ancestor directory) and
    found_in (that directory; null for its own licence or none). Columns of these names are replaced, all others carried along."""
    added = ("own_license", "own_score", "license", "found_in")
    others = [c for c in files.columns if c not in ("path", "text", *added)]
    own, dir_, salt = free_name(files, "own"), free_name(files, "dir"), free_name(files, "salt")
    scanned = with_own_licence(files.select(*[F.col(f"`{c}`") for c in others], "path", "text"), own, least).drop("text")
    scanned = scanned.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    scanned = scanned.withColumn(dir_, F.expr("if(instr(path, '/') > 0, regexp_replace(path, '/[^/]*$', ''), if(path is null, null, ''))"))
    scanned = cut(scanned)  # rows without text: each text is scored once, not for its directory and its heirs again
    score, licence = F.col(f"{own}.score"), F.col(f"{own}.licence")
    licence_files = scanned.where(F.col(own).isNotNull() & F.col("path").rlike(LICENCE_FILE))
    of_dir = licence_files.groupBy(F.col(dir_).alias("at")).agg(F.min(F.struct((-score).alias("s"), licence.alias("l"))).alias("best")).select("at", F.col("best.l").alias("licence"))
    parts = "split(dir, '/')"
    above = f"if(dir = '', array(''), concat(transform(sequence(size({parts}), 1), k -> array_join(slice({parts}, 1, k), '/')), array('')))"
    dirs = scanned.where(F.col(own).isNull() & F.col(dir_).isNotNull()).select(F.col(dir_).alias("dir")).distinct()
    ladder = dirs.select("dir", F.posexplode(F.expr(above)).alias("up", "at"))
    nearest = ladder.join(of_dir, "at").groupBy("dir").agg(F.min(F.struct("up", "at", "licence")).alias("near"))
    nearest = nearest.select(F.col("dir").alias(dir_), F.struct("near.at", "near.licence").alias(f"{own}_near"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    joined = scanned.join(nearest, [dir_, salt], "left")
    found = F.col(own).isNotNull()
    return joined.select(
        *[F.col(f"`{c}`") for c in others], "path", licence.alias("own_license"), score.alias("own_score"),
        F.when(found, licence).otherwise(F.col(f"{own}_near.licence")).alias("license"), F.when(~found, F.col(f"{own}_near.at")).alias("found_in"),
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents laid out as a source tree: one file each, a LICENSE of its directory at every fifth id, a COPYING of the
    whole source at every fiftieth."""
    name = "case when doc_id % 50 = 0 then concat(source, '/COPYING') when doc_id % 5 = 0 then concat(source, '/', lang, '/LICENSE') else concat(source, '/', lang, '/', doc_id div 1000, '/', doc_id, '.txt') end"
    return docs.select("doc_id", F.expr(name).alias("path"), "text")


def documents_sql(least: float = LEAST) -> str:
    """The same over documents in DuckDB's SQL."""

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({i}, {q(name)}, {q(text)})" for i, (name, text) in enumerate(TEMPLATES))
    words = lambda text: f"list_filter(regexp_split_to_array(lower({text}), {q(WORD_GAP)}), lambda w: w <> '')"
    return f"""
with templates(t, name, text) as (values {rows}),
t_words as (select t, name, w, count(*) as tf from (select t, name, unnest({words('text')}) as w from templates) group by all),
files as (select row_number() over () as r, doc_id, text, case when doc_id % 50 = 0 then source || '/COPYING' when doc_id % 5 = 0 then source || '/' || lang || '/LICENSE'
  else source || '/' || lang || '/' || (doc_id // 1000) || '/' || doc_id || '.txt' end as path from documents),
placed as (select *, regexp_replace(path, '/[^/]*$', '') as dir, regexp_matches(path, '(^|/)(?i:licen[cs]e|copying|unlicense)[^/]*$') as is_licence from files),
present as (select distinct r, w from (select r, unnest({words('text')}) as w from files) where w in (select w from t_words)),
n as (select count(text) as n from files),
weight as (select v.w, ln((1 + n) / (1 + count(p.r))) + 1 as x from (select distinct w from t_words) v cross join n left join present p on p.w = v.w group by v.w, n),
vectors as (select t, name, t_words.w, tf * x / sqrt(sum((tf * x) * (tf * x)) over (partition by t)) as x from t_words join weight using (w)),
units as (select r, unnest(regexp_split_to_array(text, {q(UNIT_GAP)})) as u from files union all select r, u from (select r, unnest(regexp_split_to_array(text, {q(PARAGRAPH_GAP)})) as u from files) where contains(u, chr(10)) union all select r, text from placed where is_licence),
numbered as (select row_number() over () as k, r, {words('u')} as ws from units),
word_rows as (select k, r, unnest(ws) as w from numbered where list_has_any(ws, (select list(distinct w) from t_words))),
tfs as (select k, r, w, count(*) as tf from word_rows group by all),
weighed as (select k, r, w, tf * coalesce(x, (select ln(1 + n) + 1 from n)) as x from tfs left join weight using (w)),
norms as (select k, sqrt(sum(x * x)) as norm from weighed group by k),
scores as (select s.r, v.name, round(s.dot / norm, 6) as score from (select k, r, t, sum(weighed.x * vectors.x) as dot from weighed join vectors using (w) group by all) s
  join norms using (k) join (select distinct t, name from templates) v using (t)),
own as (select r, name, score from scores where score >= {least} qualify row_number() over (partition by r order by score desc, name) = 1),
of_dir as (select dir, name from placed join own using (r) where is_licence qualify row_number() over (partition by dir order by score desc, name) = 1),
near as (select p.r, d.dir, d.name from placed p join of_dir d on p.dir = d.dir or starts_with(p.dir, d.dir || '/') where p.r not in (select r from own)
  qualify row_number() over (partition by p.r order by length(d.dir) desc) = 1)
select doc_id, path, own.name as own_license, own.score as own_score, coalesce(own.name, near.name) as license, near.dir as found_in
from placed left join own using (r) left join near using (r)
"""
