"""Operator 1: licence notices in texts, by the Dice coefficient of word bigrams with licence templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import let

DICE = 0.9
#: What the two- and three-clause licences share; the third clause tells them apart.
BSD = "BSD"
#: Licence names and the usual texts of their notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (BSD, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    (BSD, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (BSD, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "3. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    (BSD, "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)


def words_of(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of adjacent words."""
    def pairs(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 2)
        return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))

    return F.when(F.size(words) >= 2, pairs(words)).otherwise(F.array().cast("array<string>"))


def template_table(spark: SparkSession, dice: float = DICE, templates=TEMPLATES) -> DataFrame:
    """One row per template and admissible number of bigrams: (size, template, license, grams, n_grams).

    Dice = 2c / (a + b) with c at most the smaller of a and b, so a text reaches ``dice`` against a template of b bigrams only
    if its own number a lies between b * dice / (2 - dice) and b * (2 - dice) / dice."""
    named = spark.createDataFrame([(i, *x) for i, x in enumerate(templates)], "template int, license string, text string")
    grams = named.select("template", "license", bigrams(words_of(F.col("text"))).alias("grams"))
    n = F.size("grams")
    sizes = F.sequence(F.ceil(n * (dice / (2 - dice)) - 1e-9), F.floor(n * ((2 - dice) / dice) + 1e-9))
    return grams.select("template", "license", "grams", n.alias("n_grams"), F.explode(sizes.cast("array<int>")).alias("size"))


def license_matches(docs: DataFrame, *, dice: float = DICE, templates=TEMPLATES) -> DataFrame:
    """(key, at, unit, license, template, dice) of all units of ``docs`` (key, text) that match a template: each line, each
    paragraph of several lines, and the whole text of several paragraphs; unit is line, paragraph or text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[\x20\t\r]*\n"), lambda x: x.contains("\n"))
    whole = F.when(text.rlike(r"\n[\x20\t\r]*\n"), F.array(text)).otherwise(F.array().cast("array<string>"))
    units = F.concat(
        F.transform(lines, lambda x: F.struct(F.lit("line").alias("unit"), x.alias("x"))),
        F.transform(paragraphs, lambda x: F.struct(F.lit("paragraph").alias("unit"), x.alias("x"))),
        F.transform(whole, lambda x: F.struct(F.lit("text").alias("unit"), x.alias("x"))),
    )
    table = template_table(spark, dice, templates)
    rows = docs.select("key", F.posexplode(units).alias("at", "u")).select("key", "at", "u.unit", "u.x")
    rows = rows.where(F.octet_length("x") >= 3).select("key", "at", "unit", let(words_of(F.col("x")), bigrams).alias("own"))
    met = rows.where("size(own) > 0").withColumn("size", F.size("own")).join(F.broadcast(table), "size")
    common = F.size(F.array_intersect("own", "grams"))
    scored = met.select("key", "at", "unit", "license", "template", (2.0 * common / (F.col("size") + F.col("n_grams"))).alias("dice"))
    return scored.where(F.col("dice") >= dice)


def _told_apart(names: Column) -> Column:
    """The family's shared text means three clauses where the third one is there, and else two."""
    three = F.array_contains(names, "BSD-3-Clause")
    two = F.array_sort(F.array_distinct(F.transform(names, lambda x: F.when(x == BSD, F.lit("BSD-2-Clause")).otherwise(x))))
    return F.when(three, F.array_remove(names, BSD)).otherwise(two)


def scan_licenses(docs: DataFrame, *, dice: float = DICE, templates=TEMPLATES) -> DataFrame:
    """Licences noticed in every document (doc_id, text).

    Each line, paragraph and whole text is lower-cased, reduced to runs of letters and digits, and compared with each template
    of a fitting size by the Dice coefficient of its distinct word bigrams. The templates are a fixed list, so they
    are broadcast; the join is by size, so a unit only meets templates that it could match.

    Returns doc_id, n_matches (pairs of a unit and a template; texts that are equal share theirs), licenses (names, sorted, comma-joined; empty if none; the text that the two- and three-clause BSD licences share counts as the three-clause one
    where its third clause is there too), best_dice (0 if
    none). A null or empty text matches nothing; a null doc_id stays null; repeated rows give repeated results; an
    empty table gives no rows; other columns are ignored. Units of one word have no bigrams and match nothing.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.struct(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")))
    found = license_matches(rows.select("key", "text"), dice=dice, templates=templates)
    best = found.groupBy("key").agg(
        F.size(F.collect_set(F.struct("at", "template"))).cast("long").alias("n"), F.array_sort(F.collect_set("license")).alias("names"), F.max("dice").alias("d")
    )
    best = best.withColumn("names", F.array_join(_told_apart(F.col("names")), ","))
    return rows.select("doc_id", "key").join(best, "key", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("n_matches"),
        F.coalesce("names", F.lit("")).alias("licenses"),
        F.coalesce("d", F.lit(0.0)).alias("best_dice"),
    )
