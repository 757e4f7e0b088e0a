"""License scans: sparse TF-IDF cosine of spans to licence templates, then directory inheritance.

A text is a sequence of terms (line ends and comment signs are none), so wrapped notices are found like single lines. A
span of a template's own number of terms is laid wherever a telling term of the template stands in the text, at the place
that the term has in the template, and compared with it: cosine of (1 + ln count) times inverse document frequency. What
surrounds a span does not enter its cosine. Spans of long templates begin at multiples of an eighth of their length; where a
text has no span that reaches ``least``, every start is tried next to those that come within ``NEAR`` of it.

Document frequencies are counted over all texts for all terms. Telling terms are the heaviest of a template, as many as
leave less than ``least`` squared of its squared length to the others; so by the Cauchy-Schwarz inequality a span without
one cannot reach ``least``, and the same bound gives the squared weight that a span's template terms must have (or those of
all spans from one start of the grid to the next together). Texts are read in overlapping stretches of terms, so a text's length does not matter.

A file's own licence is the one of its best span from ``least`` on (ties: by name). Files without one inherit from the
nearest ancestor directory with a licence file (LICENSE, LICENCE, COPYING, NOTICE): each distinct directory is joined by
path with its ancestors, the deepest wins.

Defined cases: null and empty texts have no licence; null paths have no directory, so inherit nothing; repeated rows and
paths are scanned each; of several licence files in a directory the best score wins, then the last path; very long texts
are scanned whole; other columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import ascii_lower, read, stored, text_or_empty, with_row_key

LEAST, NEAR = 0.7, 0.2
# Wordings of public licences. Of long licences their openings and their notices for source files.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_2_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_APACHE_FILE = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,
REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and
distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity
authorized by the copyright owner that is granting the License."""
_GPL = """This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General
Public License as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option)
any later version."""
_GPL_FILE = """GNU {kind}GENERAL PUBLIC LICENSE Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone
is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
_GPL_SHORT = "licensed under the GNU {kind}General Public License, version {version}"
_CC = "Licensed under CC {kind} 4.0."
_CC_LONG = "This work is licensed under a Creative Commons {kind} 4.0 International License."
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", _MIT),
    ("ISC", "Licensed under the ISC License."), ("ISC", _ISC),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("BSD-2-Clause", f"{_BSD_2} {_BSD_2_END}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-3-Clause", f"{_BSD_2} {_BSD_3}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE_FILE),
    ("GPL-2.0", _GPL_SHORT.format(kind="", version="2")), ("GPL-2.0", _GPL.format(mark=";", kind="", version="2")),
    ("GPL-2.0", _GPL_FILE.format(kind="", version="2", date="June 1991", year="1989, 1991")),
    ("GPL-3.0", _GPL_SHORT.format(kind="", version="3")), ("GPL-3.0", _GPL.format(mark=":", kind="", version="3")),
    ("GPL-3.0", _GPL_FILE.format(kind="", version="3", date="29 June 2007", year="2007")),
    ("LGPL-2.1", _GPL_SHORT.format(kind="Lesser ", version="2.1")), ("LGPL-2.1", _GPL.format(mark=";", kind="Lesser ", version="2.1")),
    ("LGPL-2.1", _GPL_FILE.format(kind="LESSER ", version="2.1", date="February 1999", year="1991, 1999")),
    ("LGPL-3.0", _GPL_SHORT.format(kind="Lesser ", version="3")), ("LGPL-3.0", _GPL.format(mark=":", kind="Lesser ", version="3")),
    ("LGPL-3.0", _GPL_FILE.format(kind="LESSER ", version="3", date="29 June 2007", year="2007")),
    ("AGPL-3.0", _GPL_SHORT.format(kind="Affero ", version="3")), ("AGPL-3.0", _GPL.format(mark=":", kind="Affero ", version="3")),
    ("AGPL-3.0", _GPL_FILE.format(kind="AFFERO ", version="3", date="19 November 2007", year="2007")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."), ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."), ("CC0-1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    *((f"CC-{kind}-4.0", text.format(kind=name)) for kind, long in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike")) for text, name in ((_CC, kind), (_CC_LONG, long))),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")),
    *((name, f"SPDX-License-Identifier: {name}-{form}") for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for form in ("only", "or-later")),
]
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_FILE = r"(?i)^(?:LICEN[SC]E|COPYING|NOTICE)(?:\.[a-z]+)?$"
#: Spans begin in stretches of so many terms; a stretch is read with what its last spans reach beyond it.
STRETCH = 512


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(_TERM), F.lit(0))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, df) for ``texts`` (terms)."""
    return texts.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse(n: int, df: float) -> float:
    return math.log((1 + n) / (1 + df)) + 1


class Template:
    """A template's terms, the weights of its distinct ones, its telling terms and the squared weight a span must share."""

    def __init__(self, name: str, text: str, idf: dict[str, float], least: float):
        self.name, self.terms = name, re.findall(_TERM, text.lower())
        self.stride = max(1, len(self.terms) // 8)
        counts = Counter(self.terms)
        self.weights = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
        self.size = math.sqrt(sum(w * w for w in self.weights.values()))
        heavy = sorted(counts, key=lambda t: (-self.weights[t], t))
        # what is left without the first i of them
        left = [sum(self.weights[t] ** 2 for t in heavy[i:]) for i in range(len(heavy) + 1)]
        self.need = (least * self.size) ** 2 * (1 - 1e-9)
        self.telling = heavy[: next(i for i, x in enumerate(left) if x < self.need)]

    def places(self, term: str) -> list[int]:
        return [i for i, t in enumerate(self.terms) if t == term]


def templates(frequencies: DataFrame, n: int, least: float, texts=None) -> list[Template]:
    """The templates, weighed by the frequencies of their terms (a vocabulary of fixed size)."""
    texts = texts or TEMPLATES
    vocabulary = sorted({t for _, text in texts for t in re.findall(_TERM, text.lower())})
    known = frequencies.join(F.broadcast(frequencies.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")), "term")
    seen = {r["term"]: r["df"] for r in known.collect()}
    idf = {t: inverse(n, seen.get(t, 0)) for t in vocabulary}
    return [Template(name, text, idf, least) for name, text in texts]


def _spans(texts: DataFrame, given: list[Template]) -> DataFrame:
    """(key_file, key_row, template, start, terms) of all places of the grid from which, or from a start before the next, a span
    could reach the least score; ``terms`` has all terms of these spans. ``texts``: key, terms."""
    reach = max(len(t.terms) + t.stride for t in given)
    at: dict[str, list[tuple[int, int]]] = {}
    for i, template in enumerate(given):
        for term in template.telling:
            at.setdefault(term, []).extend((i, place) for place in template.places(term))
    telling = sorted(at)
    numbers = lambda of: F.array(*[F.lit(of(t)) for t in given])
    wide, strides, need = numbers(lambda t: len(t.terms) + t.stride - 1), numbers(lambda t: t.stride), numbers(lambda t: t.need)
    words = F.array(*[F.array(*map(F.lit, sorted(t.weights))) for t in given])
    squares = F.array(*[F.create_map(*[F.lit(x) for t in sorted(own.weights) for x in (t, own.weights[t] ** 2)]) for own in given])
    layout = F.array(*[F.array(*[F.struct(F.lit(i).alias("template"), F.lit(p).alias("place")) for i, p in at[t]]) for t in telling])

    hinted = texts.where(F.arrays_overlap("terms", F.array(*map(F.lit, telling))))
    bases = F.sequence(F.lit(0), F.size("terms") - 1, F.lit(STRETCH))
    stretches = hinted.select("key_file", "key_row", F.size("terms").alias("n"), F.explode(F.transform(bases, lambda b: F.struct(b.alias("base"), F.slice("terms", b + 1, F.lit(STRETCH + reach)).alias("terms")))).alias("s"))
    stretches = stretches.select("key_file", "key_row", "n", "s.*")
    hits = F.filter(F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.col("base") + i).alias("pos"))), lambda h: h["term"].isin(*telling))

    def laid(h: Column) -> Column:
        lay = F.get(layout, F.array_position(F.array(*map(F.lit, telling)), h["term"]).cast("int") - 1)
        return F.transform(lay, lambda x: F.struct(x["template"].alias("template"), _floor(F.greatest(h["pos"] - x["place"], F.lit(0)), F.get(strides, x["template"])).alias("start")))

    inside = lambda x: (x["start"] >= F.col("base")) & (x["start"] < F.col("base") + STRETCH)
    spans = stretches.select("key_file", "key_row", "base", "terms", F.explode(F.array_distinct(F.filter(F.flatten(F.transform(hits, laid)), inside))).alias("x"))
    spans = spans.select("key_file", "key_row", "x.*", F.slice("terms", F.col("x.start") - F.col("base") + 1, F.get(wide, F.col("x.template"))).alias("terms"))
    shared = F.transform(F.array_intersect("terms", F.get(words, F.col("template"))), lambda t: F.get(squares, F.col("template"))[t])
    return spans.where(F.aggregate(shared, F.lit(0.0), lambda a, x: a + x) >= F.get(need, F.col("template")))


_SPAN = ["key_file", "key_row", "template", "start"]


def _cosines(spans: DataFrame, given: list[Template], frequencies: DataFrame, n: int) -> DataFrame:
    """(span, score) of ``spans`` (span, terms)."""
    tf = spans.select(*_SPAN, F.explode("terms").alias("term")).groupBy(*_SPAN, "term").agg(F.count(F.lit(1)).alias("n"))
    rows = [(i, term, w / t.size) for i, t in enumerate(given) for term, w in t.weights.items()]
    weights = spans.sparkSession.createDataFrame(rows, "template int, term string, weight double")  # of fixed size
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    weighed = tf.join(frequencies, "term").join(F.broadcast(weights), ["template", "term"], "left").select(*_SPAN, ((1 + F.log("n")) * idf).alias("own"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return weighed.groupBy(*_SPAN).agg((F.sum(F.col("own") * F.col("weight")) / F.sqrt(F.sum(F.col("own") * F.col("own")))).alias("score"))


def _floor(value: Column, step: Column) -> Column:
    return (value - value % step).cast("int")


def matches(keyed: DataFrame, least: float = LEAST, texts=None) -> DataFrame:
    """(key_file, key_row, n_matches, license, score) for rows with a match; ``keyed``: with_row_key, row has text.

    n_matches: spans that reach ``least`` for the licence of the best one."""
    read_ = keyed.select("key_file", "key_row", terms(text_or_empty(F.col("row.text"))).alias("terms"))
    frequencies = stored(document_frequencies(read_), "term-counts")
    n = keyed.count()
    given = templates(frequencies, n, least, texts)
    grid = stored(_spans(read_, given), "spans")
    sizes, strides = (F.array(*[F.lit(x) for x in of]) for of in ([len(t.terms) for t in given], [t.stride for t in given]))
    at = lambda shift: F.slice("terms", shift + 1, F.get(sizes, F.col("template"))).alias("terms")
    on_grid = stored(_cosines(grid.select(*_SPAN, at(F.lit(0))), given, frequencies, n), "span-scores")
    whole = on_grid.where(F.col("score") >= least)
    close = on_grid.where((F.col("score") < least) & (F.col("score") >= least - NEAR)).select(*_SPAN).join(whole, _SPAN[:3], "left_anti")
    shifts = F.sequence(F.lit(1), F.get(strides, F.col("template")) - 1)
    again = grid.join(close, _SPAN).where(F.get(strides, F.col("template")) > 1).select(*_SPAN, "terms", F.explode(shifts).alias("shift"))
    again = again.select(*_SPAN[:3], (F.col("start") + F.col("shift")).alias("start"), at(F.col("shift")))
    scored = whole.unionByName(_cosines(again, given, frequencies, n))
    names = F.array(*[F.lit(t.name) for t in given])
    found = scored.select("key_file", "key_row", F.get(names, F.col("template")).alias("license"), F.round("score", 6).alias("score")).where(F.col("score") >= least)
    by_name = found.groupBy("key_file", "key_row", "license").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    top = by_name.groupBy("key_file", "key_row").agg(F.min(F.struct((-F.col("score")).alias("less"), "license", "n")).alias("top"))
    return top.select("key_file", "key_row", F.col("top.n").alias("n_matches"), "top.license", (-F.col("top.less")).alias("score"))


def ancestors(directory: Column) -> Column:
    """A directory and all above it."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def inherited(files: DataFrame) -> DataFrame:
    """(directory, given, given_by): the nearest licence file's licence for each directory of ``files`` (path, license, score)."""
    placed = files.select("path", "license", "score", F.regexp_replace("path", r"/?[^/]*$", "").alias("directory"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    best = F.struct("score", F.col("path"), "license")
    holders = placed.where(F.col("license").isNotNull() & F.col("name").rlike(_FILE)).groupBy(F.col("directory").alias("given_by")).agg(F.max(best)["license"].alias("given"))
    up = placed.where("directory is not null").select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("given_by"))
    return up.join(holders, "given_by").groupBy("directory").agg(F.max(F.struct(F.length("given_by"), "given_by", "given")).alias("b")).select("directory", "b.given_by", "b.given")


def scan(docs: DataFrame, least: float = LEAST, texts=None, scan_only: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, path, text): own licence and score, the licence that holds and where it is from.

    ``texts``: (licence, wording) pairs instead of TEMPLATES. ``scan_only``: see ``with_row_key``."""
    keyed = with_row_key(docs.select("doc_id", "path", "text"), scan_only)
    own = stored(matches(keyed, least, texts), "licences")
    files = keyed.select("key_file", "key_row", F.col("row.doc_id").alias("doc_id"), F.col("row.path").alias("path")).join(own, ["key_file", "key_row"], "left")
    files = stored(files, "files")
    given = stored(inherited(files), "inherited")
    told = files.withColumn("directory", F.regexp_replace("path", r"/?[^/]*$", "")).join(given, "directory", "left")
    return told.select(
        "doc_id",
        "path",
        F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"),
        F.col("license").alias("own_license"),
        "score",
        F.coalesce("license", "given").alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("given_by")).alias("given_by"),
    )


def op3_license_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 50 == 0, "LICENSE").otherwise(F.concat(F.lit("f"), F.col("doc_id"), F.lit(".txt")))
    folder = F.when(F.col("doc_id") % 100 == 0, F.lit("")).otherwise(F.concat(F.lit("/d"), F.floor(F.col("doc_id") / 20).cast("string")))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/p"), F.floor(F.col("doc_id") / 1000).cast("string"), folder, F.lit("/"), name)
    return scan(docs.select("doc_id", path.alias("path"), "text"), scan_only=True)
