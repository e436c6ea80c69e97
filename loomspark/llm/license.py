"""Licence scan: Dice coefficient over word bigrams against templates, in SQL functions only.

Templates are notices, whole licence texts and each paragraph of them; more can be passed to ``scan``. A document's units
(its lines, its paragraphs and the whole text, of any length) are normalised: lower case, runs of anything but letters
and digits become one space. A unit whose number of distinct bigrams can't reach the threshold with any template is
dropped before bigrams are built (they are bounded from above by the words, from below by the distinct words): ``2 min(a, b) / (a + b) >= t`` bounds b by ``a t / (2 - t)`` and ``a (2 - t) / t``; the same bounds choose the
templates that a unit is compared with.

Edge cases: null and empty texts match nothing; a unit of one word has no bigram and matches nothing; equal
coefficients are all reported by the scan, and the summary takes the first licence by name; repeated rows are scanned
one by one, and summed up by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices and declarations, as licences ask for them or as projects write them. Fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
}
THRESHOLD = 0.8


#: Whole licence texts, a paragraph to a string. Fixed values.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
)
FULL_TEXTS: dict[str, tuple[str, ...]] = {
    "BSD-2-Clause": (_BSD_HEAD, _BSD_1, _BSD_2, _BSD_WARRANTY),
    "BSD-3-Clause": (_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_WARRANTY),
    "ISC": (TEMPLATES["ISC"][0], _ISC_WARRANTY),
    "MIT": (_MIT_GRANT, _MIT_NOTICE, _WARRANTY),
    "Unlicense": (*_UNLICENSE, _WARRANTY),
}
#: Paragraphs that several licences share tell none of them.
_SHARED = {p for texts in FULL_TEXTS.values() for p in texts if sum(p in other for other in FULL_TEXTS.values()) > 1}
for _name, _texts in FULL_TEXTS.items():
    _own = [p for p in _texts if p not in _SHARED and len(p.split()) >= 10 and p not in TEMPLATES.get(_name, ())]
    TEMPLATES[_name] = (*TEMPLATES.get(_name, ()), " ".join(_texts), *_own)


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def flat_templates(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    return [(name, i, template_bigrams(t)) for name, texts in sorted(templates.items()) for i, t in enumerate(texts)]


def normal_words(unit: Column) -> Column:
    trimmed = F.btrim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "))
    return F.split(trimmed, " ")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, unit_kind, unit_no, license, template_no, dice): every unit that reaches the threshold with a template."""
    flat = flat_templates(templates)
    sizes = [len(b) for _, _, b in flat]
    low = min(sizes) * threshold / (2 - threshold)
    high = max(sizes) * (2 - threshold) / threshold
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines, paragraphs = F.split(text, "\n", -1), F.split(text, r"\n[\x20\t\r]*\n", -1)
    kinds = "array<struct<kind:string,no:int,unit:string>>"
    tagged = lambda units, kind: F.transform(units, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), x.alias("unit")))
    several = F.when(F.size(lines) > 1, tagged(F.array(text), "text")).otherwise(F.array().cast(kinds))
    parts = F.when(F.size(paragraphs) > 1, tagged(paragraphs, "paragraph")).otherwise(F.array().cast(kinds))
    units = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(F.concat(tagged(lines, "line"), parts, several), lambda u: F.length(u["unit"]) >= 3)).alias("u"))
    units = units.select("id", F.col("u.kind").alias("unit_kind"), F.col("u.no").alias("unit_no"), normal_words(F.col("u.unit")).alias("w"))
    # words bound bigrams from above, distinct words from below: most units go before their bigrams are built
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    near = (F.size("w") - 1 >= low) & (F.size(F.array_distinct("w")) - 1 <= high)
    units = units.select("id", "unit_kind", "unit_no", F.when(near, F.array_distinct(pairs)).alias("b"))
    # the templates are a few dozen fixed rows; size bounds choose those that a unit is compared with (conditions on
    # "b" stand inside the generator: as filters, the optimiser would repeat the computation of "b" in them)
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(i).alias("template_no"), F.split(F.lit("\t".join(b)), "\t").alias("t")) for name, i, b in flat])
    admitted = F.filter(table, lambda t: (F.size("b") >= F.size(t["t"]) * (threshold / (2 - threshold))) & (F.size("b") <= F.size(t["t"]) * ((2 - threshold) / threshold)))
    judged = F.transform(admitted, lambda t: F.struct(t["license"].alias("license"), t["template_no"].alias("template_no"), (2.0 * F.size(F.array_intersect("b", t["t"])) / (F.size("b") + F.size(t["t"]))).alias("dice")))
    found = units.select("id", "unit_kind", "unit_no", F.explode(F.when(F.col("b").isNotNull(), F.filter(judged, lambda m: m["dice"] >= threshold))).alias("m"))
    return found.select("id", "unit_kind", "unit_no", "m.license", "m.template_no", "m.dice")


def op9_license(docs: DataFrame) -> DataFrame:
    """doc_id, license, n_units, best_dice, first_line: each document with each licence that it carries."""
    found = scan(docs)
    first = F.min(F.when(F.col("unit_kind") == "line", F.col("unit_no")))
    return found.groupBy(F.col("id").alias("doc_id"), "license").agg(F.count_distinct("unit_kind", "unit_no").alias("n_units"), F.round(F.max("dice"), 6).alias("best_dice"), first.cast("bigint").alias("first_line"))
