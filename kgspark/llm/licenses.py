"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory, in DataFrame functions only.

A licence has several templates: its full text or that text's first part, its standard notice and the paragraphs of it, its SPDX form, its title and short statements. What is
compared with them are the parts of a file: its lines, its sentences, its paragraphs (over line breaks and comment marks), and the whole of a licence file. A part's terms are
weighed by (1 + ln tf) * idf, function words left out and bare numbers at half their weight, where idf = ln((1 + N) / (1 + df)) + 1 comes from the N templates; a term that no template has gets df 0, and so lowers the cosine. The
best template per file wins from ``threshold`` on (ties: the smaller name).

Texts and parts that can't reach ``threshold`` are passed over before they are taken apart. A cosine is at most the length of what a part shares with the template's unit
vector, so it takes at least as many of a template's words as the heaviest of them need to be long enough, and LEAST in any case. The bound is exact, so no part that
matters is lost.

A directory's licence is the best one found in its licence files (ties: smaller name). A file without a licence of its own takes that of
its nearest ancestor directory that has one; distinct directories are resolved first, by equi-joins on ancestor paths, and files join their directory.

Edge cases: null and empty texts have no licence of their own; a null path has neither a licence nor ancestors; repeated rows get the same result each; rows that share a path
are one file, whose licence is the best of their texts; parts match whatever their length; an empty table gives an empty result; extra columns pass through ``scan_licenses``
whatever their names, except those that it adds.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm._common import cut, discard, packed

THRESHOLD = 0.6
#: Public texts, notices and statements of common licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "CC-BY-4.0": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": (
        "Dedicated to the public domain under the Creative Commons Zero 1.0 Universal License.",
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        "Subject to the terms of the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Function words, which are no terms.
COMMON = frozenset("a all an and any are as at be but by can do for from has have if in is it its may must no not of on one or see so such that the this to under use was who whom will with without you your".split())
#: So many words (numbers aside) a part has to share with a template: one word proves nothing, however rare (*mit* is German for *with*).
LEAST = 2
#: What a bare number weighs beside a word: it tells versions, but no licence by itself.
NUMBER = 0.5
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
#: Lower-cased first lines that make a document of the query a licence file.
STATES = "(^|[^a-z0-9])(licen[cs]ed?|unlicense|copyright|spdx|public domain)($|[^a-z0-9])"
#: What parts are split at: line ends, sentence ends, and lines without a letter or digit.
SPLITS = ("\\n", "[.!?]+[\\x09\\x0A\\x0C\\x0D\\x20]+", "\\n[^A-Za-z0-9\\n]*\\n")


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+", -1), "")


def weights(known: dict[str, tuple[str, ...]]) -> tuple[dict[str, float], list[tuple[str, int, str, float]]]:
    """(idf by term, (licence, template, term, weight in the unit vector)) of the templates."""
    tf = [(name, k, Counter(t for t in re.findall("[a-z0-9]+", body.lower()) if t not in COMMON)) for k, (name, body) in enumerate((n, b) for n, bodies in known.items() for b in bodies)]
    df = Counter(t for *_, c in tf for t in c)
    idf = {t: math.log((1 + len(tf)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for name, k, c in tf:
        w = {t: (1 + math.log(n)) * idf[t] * (NUMBER if t.isdigit() else 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(name, k, t, x / norm) for t, x in w.items()]
    return idf, rows


def needed(rows: list[tuple[str, int, str, float]], threshold: float) -> list[tuple[list[str], int]]:
    """For each template (its words, m): whatever reaches ``threshold`` has m of these or more."""
    by: dict[int, dict[str, float]] = {}
    for _, k, t, w in rows:
        by.setdefault(k, {})[t] = w * w
    out, enough = [], threshold * threshold - 1e-6
    for mass in by.values():
        rare = sorted((t for t in mass if not t.isdigit()), key=lambda t: (-mass[t], t))
        got, m = 1 - sum(mass[t] for t in rare), 0
        while got < enough:
            got += mass[rare[m]]
            m += 1
        out.append((rare, max(m, LEAST)))
    return out


def promising(held: Column, needs: list[tuple[list[str], int]]) -> Column:
    """Whether terms can reach the threshold of any template.

    What they share with all templates is bound to a variable by a lambda: a column would be computed again for each template where the optimiser pushes the condition below it.
    """
    strings = lambda xs: F.array(*map(F.lit, sorted(set(xs))))

    def enough(shared: Column) -> Column:
        found = F.lit(False)
        for rare, m in needs:
            found = found | ((F.size(shared) >= m) & (F.size(F.array_intersect(shared, strings(rare))) >= m))
        return F.when(F.size(shared) < LEAST, F.lit(False)).otherwise(found)

    return F.exists(F.array(F.array_intersect(held, strings(t for few, _ in needs for t in few))), enough)


def scan(files: DataFrame, path: str, text: str, known: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, licence_file: str = LICENCE_FILE) -> DataFrame:
    """(path, license, score): the best template of each distinct path that reaches ``threshold``."""
    spark: SparkSession = files.sparkSession
    idf, rows = weights(known or TEMPLATES)
    needs, foreign = needed(rows, threshold), math.log(1.0 + len({k for _, k, *_ in rows})) + 1
    vectors = F.broadcast(spark.createDataFrame(rows, "license string, template int, term string, weight double"))  # the templates are a fixed, small list
    known_idf = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    texts = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where("path is not null and text is not null")
    texts = texts.where(promising(terms(F.col("text")), needs))
    parts = F.concat(*[F.split("text", s, -1) for s in SPLITS], F.when(F.col("path").rlike(licence_file), F.array("text")).otherwise(F.expr("cast(array() as array<string>)")))
    each = texts.select("path", F.explode(F.array_distinct(parts)).alias("part")).select("path", F.md5("part").alias("unit"), terms(F.col("part")).alias("held"))
    each = each.where(promising(F.col("held"), needs)).dropDuplicates(["path", "unit"])  # one unit, however many rows hold it
    exploded = each.select("path", "unit", F.explode("held").alias("term")).where(~F.col("term").isin(*sorted(COMMON)))
    tf = exploded.groupBy("path", "unit", "term").agg(F.count("*").alias("tf"))
    number = F.when(F.col("term").rlike("^[0-9]+$"), NUMBER).otherwise(1.0)
    weighed = tf.join(known_idf, "term", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(foreign)) * number)
    norm = weighed.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(vectors, "term").groupBy("path", "unit", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count_if(~F.col("term").rlike("^[0-9]+$")).alias("shared")).where(F.col("shared") >= LEAST)
    scored = dots.join(norm, ["path", "unit"]).select("path", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def inherit(files: DataFrame, found: DataFrame, path: str, licence_file: str = LICENCE_FILE) -> DataFrame:
    """``files`` with ``own_license, own_score, license, inherited_from``."""
    granted = found.where(F.col("path").rlike(licence_file)).select(directory(F.col("path")).alias("dir"), "license", "score").where("dir is not null")
    granted = granted.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("g")).select(F.col("dir").alias("up"), F.col("g.license").alias("granted"))
    dirs = files.select(directory(F.col(path)).alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/", -1)
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("up"))
    nearest = ups.join(granted, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "granted")).alias("x"))
    nearest = cut(nearest.select(F.col("dir").alias("at"), F.col("x.up").alias("up"), F.col("x.granted").alias("granted")), "nearest")
    own = found.select(F.col("path").alias("p"), F.col("license").alias("own_license"), F.col("score").alias("own_score"))
    rows = packed(files, file=F.col(path), dir=directory(F.col(path)))
    joined = rows.join(own, F.col("file") == F.col("p"), "left").join(nearest, F.col("dir") == F.col("at"), "left")
    return joined.select("row.*", "own_license", "own_score", F.coalesce("own_license", "granted").alias("license"), F.when(F.col("own_license").isNull(), F.col("up")).alias("inherited_from"))


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", known: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    found = cut(scan(files, path, text, known, threshold), "licenses")
    return inherit(files.drop(text), found, path)


def document_files(docs: DataFrame) -> DataFrame:
    """``documents`` as a file tree: source/lang/hundred/name, where a text whose first line speaks of a licence is its directory's licence file."""
    begins = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).rlike(STATES)
    name = F.concat(F.when(begins, F.lit("LICENSE-")).otherwise(F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt"))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("null")), F.coalesce("lang", F.lit("null")), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("null")))
    return docs.select("doc_id", F.concat(folder, F.lit("/"), name).alias("path"), "text")


def report(docs: DataFrame) -> DataFrame:
    return scan_licenses(document_files(docs)).select("doc_id", "path", "own_license", "own_score", "license", "inherited_from")


def _sql() -> str:
    rows = ", ".join("('{}', {}, '{}')".format(n, k, b.replace("'", "''")) for k, (n, b) in enumerate((n, b) for n, bodies in TEMPLATES.items() for b in bodies))
    begins = f"regexp_matches(lower(string_split(coalesce(text, ''), chr(10))[1]), '{STATES}')"
    n = sum(map(len, TEMPLATES.values()))
    number = f"CASE WHEN regexp_matches(term, '^[0-9]+$') THEN {NUMBER} ELSE 1.0 END::DOUBLE"
    terms_of = f"list_filter(string_split_regex(lower({{}}), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN {tuple(sorted(COMMON))})"
    parts = "list_concat(" + ", ".join(f"string_split_regex(text, '{s}')" for s in SPLITS) + f", CASE WHEN regexp_matches(path, '{LICENCE_FILE}') THEN [text] ELSE [] END)"
    return f"""
WITH tpl(license, k, body) AS (VALUES {rows}),
ttf AS (SELECT license, k, term, count(*) tf FROM (SELECT license, k, unnest({terms_of.format('body')}) term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln({n + 1.0} / (1 + count(*))) + 1 idf FROM ttf GROUP BY term),
tw AS (SELECT license, k, term, (1 + ln(tf)) * idf * {number} w FROM ttf JOIN idf USING (term)),
weights AS (SELECT license, k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) weight FROM tw),
f AS (SELECT doc_id, text, concat_ws('/', coalesce(source, 'null'), coalesce(lang, 'null'), coalesce(CAST(doc_id // 100 AS VARCHAR), 'null'))
   || '/' || CASE WHEN {begins} THEN 'LICENSE-' ELSE '' END || coalesce(CAST(doc_id AS VARCHAR), 'null') || '.txt' AS path FROM documents),
units AS (SELECT DISTINCT path, part FROM (SELECT path, unnest({parts}) part FROM f)),
tf AS (SELECT path, part, term, count(*) tf FROM (SELECT path, part, unnest({terms_of.format('part')}) term FROM units) GROUP BY ALL),
w AS (SELECT path, part, term, (1 + ln(tf)) * coalesce(idf, ln({n + 1.0}) + 1) * {number} w FROM tf LEFT JOIN idf USING (term)),
norm AS (SELECT path, part, sqrt(sum(w * w)) norm FROM w GROUP BY ALL),
scored AS (SELECT path, license, round(sum(w * weight) / any_value(norm), 6) score FROM w JOIN weights USING (term) JOIN norm USING (path, part) GROUP BY path, part, license, k HAVING count(*) FILTER (WHERE NOT regexp_matches(term, '^[0-9]+$')) >= {LEAST}),
own AS (SELECT path, license, score FROM scored WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
granted AS (SELECT regexp_replace(path, '/[^/]*$', '') up, license FROM own WHERE regexp_matches(path, '{LICENCE_FILE}')
   QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, license) = 1),
near AS (SELECT DISTINCT path, up, g.license FROM f JOIN granted g ON starts_with(path, up || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(up) DESC) = 1)
SELECT f.doc_id, f.path, own.license AS own_license, own.score AS own_score, coalesce(own.license, near.license) AS license,
   CASE WHEN own.license IS NULL THEN near.up END AS inherited_from
FROM f LEFT JOIN own USING (path) LEFT JOIN near USING (path)"""


SQL = _sql()
