"""Operator 7: licence notices by Dice coefficient over word bigrams, in DataFrame functions alone.

Units of a text are its lines, its blocks (what stands between blank lines) and
the whole text.
A unit is normalised to its lower-cased words (runs of letters and digits) and
compared to each template by 2 |A n B| / (|A| + |B|) of the sets of bigrams.

Two bounds prune before bigrams are built, and lose nothing at a coefficient of
``least``: the sizes must satisfy |A| <= |B| (2 - least) / least and the other way
round; and as ``least / (2 - least)`` of a template's bigrams must occur, a unit
without any of a few pieces of words, which touch more than the rest of each
template's bigrams, cannot match. Nothing is shuffled.

``windows`` looks inside units: each template is compared to runs of as many
words of a text, wherever lines and blocks break (comment marks are no words), so
a notice is found with words around it, wrapped, or in a comment. A run begins at
a bigram of the template, and is compared only if so many of its bigrams follow
within the template's length that the coefficient can be reached. Of overlapping
runs the best stays. It, too, is DataFrame functions alone, without a shuffle.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

LEAST = 0.8
# Notices and texts of public licences, as they are customarily written.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Full texts, and SPDX tags.
FULL = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")),
]
ALL = TEMPLATES + FULL
_COMMON = set("a an and any are as at be by can for if in is it its may not of on or that the this to use was with work you".split())


def words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def stems(pairs: list[list[str]], least: float) -> list[str]:
    """Pieces of words, long uncommon ones first, then digits, that touch so many bigrams of each template that no match can lack them all."""
    out: list[str] = []
    for p in pairs:
        spare = len(p) * (1 - least / (2 - least)) + 1e-9
        left = {x for x in p if not any(k in x for k in out)}
        while len(p) - len(left) <= spare and left:
            counts: dict[str, int] = {}
            for x in left:
                for w in set(x.split()):
                    k = w[:6] if w not in _COMMON else w
                    counts[k] = counts.get(k, 0) + 1
            best = max(sorted(counts), key=lambda k: (2 * (k not in _COMMON and len(k) > 4) or k.isdigit(), k not in _COMMON, counts[k], len(k)))
            out.append(best)
            left = {x for x in left if best not in x}
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = ALL, least: float = LEAST) -> DataFrame:
    """documents (doc_id, text) -> doc_id, unit (line, block or text), place (from 0), license, template (from 0), dice.

    For each unit the best template (of equal ones, the first) at
    ``least`` or above; a block of one line counts as its line only, a text of
    one block as that. Null and empty texts and units of one word have no matches; null ids keep their
    rows. Other columns are ignored.
    """
    pairs = [bigrams(t) for _, t in templates]
    keys = stems(pairs, least)
    reach = (2 - least) / least
    low, high = min(map(len, pairs)) / reach, max(map(len, pairs)) * reach
    has = lambda c: reduce(or_, (F.contains(c, F.lit(k)) for k in keys))
    # A generator keeps a value as a column of its own; else it would be computed again at every mention of it.
    held = lambda c: F.explode(F.array(c))
    text = docs.select(F.col("doc_id").cast("long"), held(F.lower("text")).alias("text")).where(has(F.col("text")))
    kinds = F.array(F.struct(F.lit("line").alias("unit"), F.split("text", "\n", -1).alias("parts")), F.struct(F.lit("block").alias("unit"), F.split("text", "\n[ \t\r]*\n", -1).alias("parts")), F.struct(F.lit("text").alias("unit"), F.array("text").alias("parts")))
    units = text.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", F.col("k.unit").alias("unit"), F.posexplode("k.parts").alias("place", "body"))
    units = units.where(has(F.col("body")) & ((F.col("unit") == "line") | (F.col("unit") == "block") & F.contains("body", F.lit("\n")) | (F.col("unit") == "text") & F.col("body").rlike("\n[ \t\r]*\n")))
    plain = F.trim(F.regexp_replace("body", r"[^\p{L}\p{N}]+", " "))
    units = units.select("doc_id", "unit", "place", held(F.split(plain, " ")).alias("w"))
    units = units.where(F.size("w") > low)
    two = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    units = units.select("doc_id", "unit", "place", held(two).alias("a")).where((F.size("a") >= low) & (F.size("a") <= high))
    # One literal: an array built of a thousand would be planned literal by literal.
    known = F.from_json(F.lit(json.dumps([{"license": name, "template": k, "n": len(p), "b": p} for k, ((name, _), p) in enumerate(zip(templates, pairs))])), "array<struct<license:string,template:int,n:int,b:array<string>>>")
    fits = F.filter(known, lambda t: (F.size("a") <= t["n"] * reach) & (t["n"] <= F.size("a") * reach))
    scored = F.transform(fits, lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"), (F.lit(2.0) * F.size(F.array_intersect(F.col("a"), t["b"])) / (F.size("a") + t["n"])).alias("dice")))
    best = F.filter(scored, lambda t: t["dice"] >= least)
    out = units.select("doc_id", "unit", "place", held(best).alias("m")).where(F.size("m") > 0)
    first = F.reduce("m", F.col("m")[0], lambda x, y: F.when((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["template"] < x["template"])), y).otherwise(x))
    return out.select("doc_id", "unit", "place", first.alias("t")).select("doc_id", "unit", "place", "t.license", "t.template", "t.dice")


def windows(docs: DataFrame, templates: list[tuple[str, str]] = ALL, least: float = LEAST) -> DataFrame:
    """documents (doc_id, text) -> doc_id, start, end (code points), license, template (from 0), dice: windows at ``least`` or above.

    Windows of a text do not overlap: the best stays, then the longer, then the
    first, then the first template. Null and empty texts have none; null ids
    keep their rows. Other columns are ignored.
    """
    sets = [bigrams(t) for _, t in templates]
    table_ = [{"license": name, "template": k, "n": len(words(t)) - 1, "size": len(b), "need": math.ceil(least / (2 - least) * len(b) - 1e-9), "b": b} for k, ((name, t), b) in enumerate(zip(templates, sets))]
    every = ", ".join("'" + x + "'" for x in sorted(set().union(*sets)))
    held = lambda c: F.explode(F.array(c))
    word = r"[\p{L}\p{N}]+"
    rows = docs.select(F.col("doc_id").cast("long"), "text").where(reduce(or_, (F.contains(F.lower("text"), F.lit(k)) for k in stems(sets, least))))
    rows = rows.select("doc_id", "text", held(F.regexp_extract_all("text", F.lit(f"({word})"), 1)).alias("w"))
    low = F.transform("w", F.lower)
    two = F.zip_with(F.slice(low, 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice(low, 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.where(F.size("w") > 1).select("doc_id", "text", "w", held(two).alias("p"))
    # An IN of literals is a hash set to the optimiser; a map or an array would be searched one by one.
    rows = rows.select("*", held(F.expr(f"filter(transform(p, (x, i) -> struct(i AS i, x AS x)), h -> h.x IN ({every}))")).alias("h")).where(F.size("h") > 0)
    known = F.from_json(F.lit(json.dumps(table_)), "array<struct<license:string,template:int,n:int,size:int,need:int,b:array<string>>>")

    def candidates(t):
        own = F.filter("h", lambda x: F.array_contains(t["b"], x["x"]))
        begins = F.filter(F.transform(own, lambda x, j: F.struct(x["i"].alias("i"), F.get(own, j + t["need"] - 1)["i"].alias("last"))), lambda c: c["last"] < c["i"] + t["n"])
        a = lambda c: F.array_distinct(F.slice("p", c["i"] + 1, t["n"]))
        dice = lambda c: F.lit(2.0) * F.size(F.array_intersect(a(c), t["b"])) / (F.size(a(c)) + t["size"])
        end = lambda c: F.least(c["i"] + t["n"], F.size("w") - 1)  # noqa: E731  the last word
        return F.transform(begins, lambda c: F.struct((-dice(c)).alias("worse"), (c["i"] - end(c)).alias("shorter"), c["i"].alias("i"), t["template"].alias("template"), end(c).alias("end"), t["license"].alias("license")))

    found = F.filter(F.flatten(F.transform(known, candidates)), lambda c: c["worse"] <= -least)
    rows = rows.select("doc_id", "text", "w", held(F.array_sort(found)).alias("c")).where(F.size("c") > 0)
    kind = "array<struct<worse:double,shorter:int,i:int,template:int,end:int,license:string>>"
    free = F.aggregate(F.col("c").cast(kind), F.array().cast(kind), lambda taken, c: F.when(F.exists(taken, lambda x: (x["i"] <= c["end"]) & (c["i"] <= x["end"])), taken).otherwise(F.concat(taken, F.array(c))))
    rows = rows.select("doc_id", "w", F.split("text", word, -1).alias("between"), F.explode(free).alias("c"))
    length = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    start = length("between", F.col("c.i") + 1) + length("w", F.col("c.i"))
    end = length("between", F.col("c.end") + 1) + length("w", F.col("c.end") + 1)
    return rows.select("doc_id", start.alias("start"), end.alias("end"), "c.license", "c.template", (-F.col("c.worse")).alias("dice"))


def oracle(templates: list[tuple[str, str]] = ALL, least: float = LEAST) -> str:
    """The same by comparing every unit to every template."""
    rows = ",\n  ".join("('{}', {}, [{}])".format(name, k, ", ".join(f"'{p}'" for p in bigrams(t))) for k, (name, t) in enumerate(templates))
    return rf"""
WITH known(license, template, b) AS (VALUES {rows}),
lines AS (SELECT doc_id, 'line' AS unit, unnest(generate_series(0, len(x) - 1)) AS place, unnest(x) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
blocks AS (SELECT doc_id, 'block' AS unit, unnest(generate_series(0, len(x) - 1)) AS place, unnest(x) AS body FROM (SELECT doc_id, string_split_regex(text, '\n[ \t\r]*\n') AS x FROM documents WHERE text IS NOT NULL)),
units AS (SELECT * FROM lines UNION ALL SELECT * FROM blocks WHERE contains(body, chr(10)) UNION ALL SELECT doc_id, 'text', 0, text FROM documents WHERE regexp_matches(text, '\n[ \t\r]*\n')),
split AS (SELECT doc_id, unit, place, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
pairs AS (SELECT doc_id, unit, place, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM split WHERE len(w) >= 2),
scored AS (SELECT doc_id, unit, place, license, template, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM pairs, known WHERE {least} * (len(a) + len(b)) <= 2 * least(len(a), len(b)) AND list_has_any(a, b))
SELECT doc_id, unit, CAST(place AS INTEGER) AS place, license, CAST(template AS INTEGER) AS template, dice FROM scored WHERE dice >= {least}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, template) = 1
"""


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(table(spark, sf_dir, "documents"))
