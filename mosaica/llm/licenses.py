"""Licence scan: Dice coefficient of word bigrams against licence templates, in DataFrame functions only.

A text's words are its lower-cased runs of letters and digits, so line breaks
and comment marks make no difference. A template is laid at every place of a
text, and the words it then covers are a unit A. It fits if
2 |A n T| / (|A| + |T|) over sets of bigrams reaches the threshold. That needs
|A n T| of |T| t / (2 - t) at least, so a fit may lack few of the template's
bigrams: of its marks, the longest ones, a unit must hold so many that units
with fewer are left out before their bigrams are made, and none of them fits.
A notice fits at its place and, less well, some words before and after it. So a
template stands where it fits and the text has one of its anchors - bigrams of
long words, spread over the template - at the anchor's place; of its fits that
overlap no better one of these (an altered notice may lack all anchors) it
stands at the best ones. So each fit that overlaps no better one stands. Where templates that stand overlap, the best stays: a notice inside a
file, wrapped over many lines, is one row, and so is a licence's text.

The templates are a fixed table of literals. Only fits, a few small rows, are
shuffled. Long licences have their opening as a template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize_table

THRESHOLD = 0.8
SLACK = 1e-9

#: Notices, short texts and openings of widely used licences, one (id, text) per template.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("bsd-2-clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("bsd-3-clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("lgpl-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("bsl-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.'),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def anchors(words: list[str], threshold: float = THRESHOLD, most: int = 8) -> list[int]:
    """Places of a template's anchors: the longest bigram of each of k equal stretches, ``most`` at most. Fits that lack
    all of so few are found by ``marks``."""
    n = len(words) - 1
    k = max(1, min(most, int((2 - 2 * threshold) / (2 - threshold) * n + SLACK) + 1))
    cut = [n * i // k for i in range(k + 1)]
    return [max(range(a, b), key=lambda i: (len(words[i]) + len(words[i + 1]), -i)) for a, b in zip(cut, cut[1:], strict=False)]


def template_rows(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, str, str, int, int, list[str]]]:
    """(template, licence, anchor bigram, its place, words, distinct bigrams) for every anchor."""
    out = []
    for number, (name, text) in enumerate(templates):
        w = words_of(text)
        bigrams = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
        out += [(number, name, f"{w[i]} {w[i + 1]}", i, len(w), bigrams) for i in anchors(w, threshold)]
    return out


def marks(words: list[str], threshold: float = THRESHOLD) -> tuple[list[str], int]:
    """The longest of a template's distinct bigrams, and how many of them every fit has at least: a fit lacks at most
    (2 - 2t) / (2 - t) of all, and there are twice as many marks and one more, or all bigrams."""
    bigrams = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}, key=lambda x: (-len(x), x))
    lacks = int((2 - 2 * threshold) / (2 - threshold) * len(bigrams) + SLACK)
    found = bigrams[: 2 * lacks + 1]
    return found, len(found) - lacks


def _known(templates: list[tuple[str, str]], threshold: float) -> tuple[str, list[str], int]:
    """Templates of two words or more as an array in SQL, all their marks, and the words of the longest."""
    words = {n: w for n, (_, text) in enumerate(templates) if len(w := words_of(text)) > 1}
    texts = lambda x: f"array({', '.join(map(repr, x))})"
    rows, wanted = [], set()
    for n, w in words.items():
        own, need = marks(w, threshold)
        wanted.update(own)
        name = templates[n][0].replace("\\", "\\\\").replace("'", "\\'")
        bigrams = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
        places = ", ".join(f"named_struct('anchor', '{w[i]} {w[i + 1]}', 'place', {i})" for i in anchors(w, threshold))
        rows.append(f"named_struct('template', {n}, 'license', '{name}', 'size', {len(w)}, 'need', {need}, 'marks', {texts(own)}, 'bigrams', {texts(bigrams)}, 'anchors', array({places}))")
    return f"array({', '.join(rows)})", sorted(wanted), max(map(len, words.values()), default=1)


def _overlap(fits: DataFrame, others: DataFrame, longest: int, *more: Column) -> DataFrame:
    """``fits`` a that overlap none of ``others`` b (of those for which ``more`` holds); overlapping ones share a stretch of
    as many words as the longest template has, or have neighbouring ones."""
    stretch = lambda c: F.floor(c / longest)
    a = fits.withColumn("stretch", stretch(F.col("start"))).alias("a")
    b = others.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")) - 1, stretch(F.col("start") + F.col("n") - 1)))).alias("b")
    on = (F.col("a.row") == F.col("b.row")) & (F.col("a.stretch") == F.col("b.stretch"))
    on &= (F.col("a.start") < F.col("b.start") + F.col("b.n")) & (F.col("b.start") < F.col("a.start") + F.col("a.n"))
    for c in more:
        on &= c
    return a.join(b, on, "left_anti").drop("stretch")


def _order(t: str) -> Column:
    return F.struct((-F.col(f"{t}dice")).alias("d"), (-F.col(f"{t}n")).alias("n"), F.col(f"{t}license").alias("l"), F.col(f"{t}template").alias("t"), F.col(f"{t}start").alias("s"))


def _standing(fits: DataFrame, longest: int) -> DataFrame:
    """The anchored fits and, of a template's others that overlap no better one of these, the best, then the best that
    overlaps none of those, and so on: a round takes those without a better one and leaves what overlaps none of them."""
    same, better = F.col("a.template") == F.col("b.template"), _order("b.") < _order("a.")
    stand = fits.where("anchored")
    # A unit that a text's ends cut on both sides has several places, anchored ones perhaps: it is one fit.
    rest = materialize_table(_overlap(fits.where("NOT anchored"), stand, longest, same, _order("b.") <= _order("a.")))
    while not rest.isEmpty():
        # Fits in one cell all overlap, so only the cell's best can stand; all of them can be the better one.
        tops = rest.groupBy("row", "template", "cell").agg(F.min_by(F.struct(*rest.columns), _order("")).alias("_f")).select("_f.*")
        best = materialize_table(_overlap(tops, rest, longest, same, better))
        stand, rest = stand.unionByName(best), materialize_table(_overlap(rest, best, longest, same))
    return stand


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, start (word, from 0), words, license, dice: the best of the fits that overlap at each place of a text.

    Better is the higher Dice, then the longer unit, then licence, template and
    place in order. Null and empty texts and texts of one word match nothing;
    texts of any length are scanned whole; repeated rows are each reported; null
    ids are reported as null; further columns are not read; an empty table gives
    no row.
    """
    known, wanted, longest = _known(templates, threshold)
    firsts = sorted({x.split()[0] for x in wanted})
    low = threshold / (2 - threshold) * (1 - SLACK)
    text = F.regexp_replace(F.lower(F.col("text").cast("string")), "[^a-z0-9]+", " ")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.trim(text), " ").alias("words")).where("words is not null")
    pair = lambda a, b: F.concat(a, F.lit(" "), b)
    # Only where the first word is a mark's is a pair put together at all.
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.when(a.isin(firsts), pair(a, b)))
    hits = F.filter(F.transform(pairs, lambda x, i: F.when(x.isin(wanted), F.struct(x.alias("mark"), i.alias("at")))), lambda h: h.isNotNull())
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "words", hits.alias("hits"))
    there = F.array_distinct("hits.mark")
    laid = F.when(F.size("hits") > 0, F.filter(F.expr(known), lambda t: F.size(F.array_intersect(t["marks"], there)) >= t["need"]))
    # The outer form, as Spark would compute the array twice to leave out rows without an element.
    found = d.select("row", "doc_id", "words", "hits", F.explode_outer(laid).alias("t")).where("t is not null")
    ats = F.transform(F.filter("hits", lambda h: F.array_contains("t.marks", h["mark"])), lambda h: h["at"])
    found = found.select("row", "doc_id", "words", "t", ats.alias("ats"))
    # Places whose unit has marks enough, each under the first of them; the first word may lie before the text's.
    first = lambda j: F.greatest(F.get("ats", j + F.col("t.need") - 1) + 2 - F.col("t.size"), F.get("ats", j - 1) + 1)
    spans = F.transform(F.sequence(F.lit(0), F.size("ats") - F.col("t.need")), lambda j: F.when(first(j) <= F.get("ats", j), F.sequence(first(j), F.get("ats", j))))
    found = found.select("row", "doc_id", "words", "t", F.flatten(F.filter(spans, lambda x: x.isNotNull())).alias("places")).where(F.size("places") > 0)
    a = F.greatest(F.lit(0), F.element_at("places", 1))
    stretch = F.slice("words", a + 1, F.least(F.size("words"), F.element_at("places", -1) + F.col("t.size")) - a)
    found = found.select("row", "doc_id", "t", "places", F.size("words").alias("all"), a.alias("a"), stretch.alias("stretch"))
    own = F.zip_with(F.slice("stretch", F.lit(1), F.size("stretch") - 1), F.slice("stretch", F.lit(2), F.size("stretch")), pair)
    found = found.select("row", "doc_id", "t", "places", "all", "a", own.alias("own"))
    anchored = lambda s: F.exists("t.anchors", lambda x: F.get("own", s + x["place"] - F.col("a")).eqNullSafe(x["anchor"]))
    unit = lambda s: F.struct(F.greatest(F.lit(0), s).alias("start"), (F.least("all", s + F.col("t.size")) - F.greatest(F.lit(0), s)).alias("n"), anchored(s).alias("anchored"))
    units = F.filter(F.array_distinct(F.transform("places", unit)), lambda u: u["n"] - 1 >= F.size("t.bigrams") * F.lit(low))
    cut = lambda u: F.slice("own", u["start"] - F.col("a") + 1, u["n"] - 1)
    dice = lambda u: 2.0 * F.size(F.array_intersect(cut(u), F.col("t.bigrams"))) / (F.size(F.array_distinct(cut(u))) + F.size("t.bigrams"))
    fits = F.filter(F.transform(units, lambda u: F.struct(u["start"].alias("start"), u["n"].alias("n"), u["anchored"].alias("anchored"), dice(u).alias("dice"))), lambda f: f["dice"] >= threshold)
    cell = F.floor(F.col("f.start") / F.greatest(F.lit(1), F.ceil(F.size("t.bigrams") * F.lit(low)))).alias("cell")
    found = found.select("row", "doc_id", "t", F.explode_outer(fits).alias("f")).where("f is not null")
    fits = materialize_table(found.select("row", "doc_id", "f.start", "f.n", "f.anchored", "t.template", "t.license", "f.dice", cell))
    stand = _standing(fits, longest)
    best = _overlap(stand, stand, longest, _order("b.") < _order("a."))
    return best.select("doc_id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("words"), "license", "dice")
