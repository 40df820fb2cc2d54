"""License scans, with DataFrame operations only.

A file is read as its sequence of terms. Around each licence word of it, every template (an SPDX line, a
usual notice, or whole paragraphs of a licence) is laid so that its own first licence word lies there, and
compared with the terms it covers, however lines are broken and whatever stands around them: by the
cosine of sparse TF-IDF vectors, term counts times ``ln(1 + n / df)`` over the templates, terms of no
template weighing most. Numbers and licence names of the template must be among these terms, names of its variants must not. A hit is a
score at or above ``least``. The licence of an SPDX line is the file's own; without one it is that of the
best hit: by the score to one decimal, then the longer template, then the score, then the name. A licence
file (by its name, or because its hits cover most of its words, each word counted once) licenses its
directory; a file without a licence of its own takes that of the nearest directory above it that has
one, found by joining the distinct directories with their ancestors.

Templates are constants of the plan, so texts are scored where they are read and nothing is shuffled
for them; only directories are joined.

Defined cases: null and empty texts have no hits; of several SPDX lines the first counts, and of one its
first identifier, one that is not known as it is written; among several licence files of a directory the best score, then name, then path; a null path
neither licenses nor inherits; repeated rows are scored each; an empty table gives an empty result;
other columns are carried, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.llm import store

#: Sentences by which public licences are known.
SENTENCES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LICENCE_WORD = r"(?i)licen[cs]|copyright|permission|public domain|redistribution|spdx"
#: Names of licences as notices spell them.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"),
    ("Apache-2.0", "Apache License version 2.0", "Apache 2.0 license", "Apache-2.0"),
    ("BSD-2-Clause", "BSD 2-Clause license", "2-clause BSD license", "simplified BSD license"),
    ("BSD-3-Clause", "BSD 3-Clause license", "3-clause BSD license", "new BSD license"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-2.0", "GNU General Public License version 2", "GNU GPL v2", "GNU GPL version 2", "GPL v2", "GPLv2", "GPL-2.0"),
    ("GPL-3.0", "GNU General Public License version 3", "GNU GPL v3", "GNU GPL version 3", "GPL v3", "GPLv3", "GPL-3.0"),
    ("ISC", "ISC license"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"),
    ("MIT", "MIT license"),
    ("MPL-2.0", "Mozilla Public License version 2.0", "MPL 2.0", "MPL-2.0"),
)
_GNU = "under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
_NEITHER = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
#: Usual notices, and paragraphs of grants and conditions.
PARAGRAPHS = (
    ("AGPL-3.0", _GNU.format("GNU Affero General Public License", "3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " 3. " + _NEITHER),
    ("BSD-3-Clause", _NEITHER),
    ("GPL", "under the terms of the GNU General Public License as published by"),
    ("GPL-2.0", _GNU.format("GNU General Public License", "2")),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", _GNU.format("GNU General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
     "and this permission notice appear in all copies."),
    ("LGPL-2.1", _GNU.format("GNU Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("GNU Lesser General Public License", "3")),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
     "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
     "commercial or non-commercial, and by any means. This is free and unencumbered software released into the public domain."),
)
ANCHOR = r"^(un)?licen[cs]|^copyright|^permission|^public$|^redistribution|^spdx"
#: Terms a notice cannot do without, besides numbers.
KEYS = set("affero agpl agplv apache attribution bsd cc creative gnu gpl gplv isc lesser lgpl lgplv mit mozilla mpl nc neither new noncommercial sa sharealike simplified sublicense".split())
#: Terms that make another licence of one that holds the first.
OTHERS = {"gnu": ("affero", "lesser"), "creative": ("noncommercial", "sharealike"), "cc": ("nc", "sa")}
SPDX = r"(?i)SPDX-License-Identifier:\s*\(*\s*([a-z0-9][a-z0-9.+-]*)"
FILE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^notice"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _templates() -> list[tuple[str, list[str]]]:
    """Names and terms of all templates, each with a licence word to lay it by."""
    named = [(name, f"{'under' if 'icense' in form else 'licensed under'} the {form}") for name, *forms in NAMES for form in forms]
    named += [(name, f"License: {form}") for name, *forms in NAMES for form in (name, *forms) if "icense" not in form]
    terms = [(name, _terms(text)) for name, text in (*SENTENCES, *PARAGRAPHS, *named)]
    return sorted({(name, tuple(t)) for name, t in terms if any(re.search(ANCHOR, x) for x in t)})


def _vectors() -> tuple[list[tuple[str, int, int, list[str], list[str], dict[str, float]]], dict[str, float], float]:
    """Templates (name, number of terms, terms before the first licence word, terms that must and must not be
    there, unit vector), the weight of each of their terms, and that of all others."""
    texts = _templates()
    df = Counter(t for _, terms in texts for t in set(terms))
    idf = {t: math.log(1 + len(texts) / n) for t, n in df.items()}
    vectors = []
    for name, terms in texts:
        c = Counter(terms)
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        keys = sorted(t for t in c if t in KEYS or t[0].isdigit()) or sorted(c, key=lambda t: (-idf[t], t))[:2]
        before = next(k for k, t in enumerate(terms) if re.search(ANCHOR, t))
        others = sorted(x for t in c for x in OTHERS.get(t, ()) if x not in c)
        vectors.append((name, len(terms), before, keys, others, {t: n * idf[t] / norm for t, n in c.items()}))
    return vectors, idf, math.log(1 + len(texts))


def laid(terms: Column, least: float) -> Column:
    """``score``, ``name``, ``at`` (first term, from 1) and ``n`` (terms covered) of all hits in a text."""
    vectors, idf, rare = _vectors()
    map_of = lambda d: F.create_map(*[F.lit(x) for pair in sorted(d.items()) for x in pair])
    array_of = lambda terms: F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    weight_of = map_of(idf)
    templates = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(n).alias("n"), F.lit(before).alias("before"), array_of(keys).alias("keys"), array_of(others).alias("others"), map_of(v).alias("terms"))
        for name, n, before, keys, others, v in vectors])
    places = F.filter(F.transform(terms, lambda t, i: F.when(t.rlike(ANCHOR), i + 1)), lambda i: i.isNotNull())

    def windows(place: Column) -> Column:
        at = lambda t: F.greatest(F.lit(1), place - t.before)
        found = F.transform(templates, lambda t: F.struct(t.alias("t"), at(t).alias("at"), F.slice(terms, at(t), t.n).alias("w")))
        return F.filter(found, lambda x: F.forall(x.t["keys"], lambda k: F.array_contains(x.w, k)) & ~F.arrays_overlap(x.w, x.t["others"]))

    def scored(x: Column) -> Column:
        counted = F.transform(F.array_distinct(x.w), lambda t: F.struct(
            (F.size(F.filter(x.w, lambda y: y == t)) * F.coalesce(F.element_at(weight_of, t), F.lit(rare))).alias("w"), F.coalesce(F.element_at(x.t["terms"], t), F.lit(0.0)).alias("v")))
        sums = F.aggregate(counted, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s")), lambda a, y: F.struct((a.d + y.w * y.v).alias("d"), (a.s + y.w * y.w).alias("s")), lambda a: a.d / F.sqrt(a.s))
        return F.struct(F.round(sums, 9).alias("score"), x.t["name"].alias("name"), x["at"].alias("at"), F.size(x.w).alias("n"))

    return F.filter(F.transform(F.flatten(F.transform(places, windows)), scored), lambda h: h.score >= least)


def _spdx_name(identifier: Column) -> Column:
    """The name of a licence by its SPDX identifier."""
    known = {name.lower(): name for name, _ in _templates()}
    plain = F.regexp_replace(identifier, r"(?i)(-only|-or-later|\+)$|\.$", "")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]), F.lower(plain)), plain)


def scan(files: DataFrame, path: Column, least: float = 0.7, text_column: str = "text") -> DataFrame:
    """Per row of ``files``: ``row`` (its columns but the text), ``path``, ``own_license``,
    ``own_score``, ``license`` (own or inherited) and ``inherited_from`` (directory)."""
    spark = files.sparkSession
    text = F.col(text_column)
    rest = F.struct(*[F.col(f"`{c}`") for c in files.columns if c != text_column])
    terms_of = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))
    meant = text.rlike(LICENCE_WORD)
    rows = files.select(rest.alias("row"), path.alias("path"), F.when(meant, terms_of(text)).alias("terms"), F.when(meant, F.regexp_extract_all(text, F.lit(SPDX), F.lit(0))).alias("lines"),
                        F.when(meant, F.regexp_extract(text, SPDX, 1)).alias("identifier"))
    rows = rows.withColumn("hits", laid(F.col("terms"), least))
    best = F.array_min(F.transform("hits", lambda h: F.struct((-F.round(h.score, 1)).alias("r"), (-h.n).alias("n"), (-h.score).alias("s"), h["name"].alias("name"))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h.n - 1)))))
    covered = covered + F.aggregate("lines", F.lit(0), lambda a, x: a + F.size(terms_of(x)))
    rows = rows.withColumn("best", best).withColumn("own", F.when(F.size("lines") > 0, F.struct(_spdx_name(F.col("identifier")).alias("name"), F.lit(1.0).alias("score"))).otherwise(
        F.when(F.size("hits") > 0, F.struct(F.col("best.name").alias("name"), (-F.col("best.s")).alias("score")))))
    has = F.col("own").isNotNull()
    scored = rows.select(
        "row", "path", F.col("own.name").alias("own_license"), F.col("own.score").alias("own_score"),
        F.coalesce(has & (F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME) | (covered * 2 >= F.size("terms"))), F.lit(False)).alias("for_directory"),
        F.regexp_replace("path", r"/[^/]*$", "").alias("directory"))
    scored, folder = store.parked(scored)
    rank = F.struct((-F.col("own_score")).alias("s"), "own_license", "path")
    licensed, licensed_folder = store.parked(
        scored.where("for_directory").groupBy("directory").agg(F.min(rank).alias("r")).select(F.col("directory").alias("above"), F.col("r.own_license").alias("license")))
    parts = F.split("directory", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.concat_ws("/", F.slice(parts, 1, n)).alias("above"), n.alias("depth"))))
    directories = scored.where("directory is not null").select("directory").distinct().select("directory", above.alias("a")).select("directory", "a.*")
    nearest = directories.join(licensed, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "license")).alias("n"))
    nearest, nearest_folder = store.parked(nearest.select("directory", F.col("n.above").alias("inherited_from"), F.col("n.license").alias("inherited")))
    out = scored.join(nearest, "directory", "left").select(
        "row", "path", "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("inherited_from")).alias("inherited_from"))
    out, _ = store.parked(out)
    store.remove(spark, folder, licensed_folder, nearest_folder)
    return out
