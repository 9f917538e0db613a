"""Licence scans: lines and whole texts compared to licence templates by their word bigrams.

Both sides are normalised (ASCII letters lower, other ASCII signs as blanks) and compared by the
Dice coefficient of their distinct word bigrams. Dice at ``threshold`` t needs a size between
t / (2 - t) and (2 - t) / t times the template's, so templates of another size are not candidates;
texts without any bigram of a template are none either. Built-in expressions only.

Bigrams are 64-bit hashes. Null and empty texts, and texts of one word, match nothing and have
zero matches; repeated rows are judged each; of equal scores the first name wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

THRESHOLD = 0.8

# Public licence notices and texts, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}


def normalised(text: Column) -> Column:
    """ASCII letters lower, other ASCII signs but line breaks as blanks; beyond ASCII as it is."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(folded, "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")


def bigrams(words: Column) -> Column:
    """Distinct hashed word pairs."""
    # No reference to the words inside the lambda: the optimizer may put their split in its place.
    size = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, F.lit(1), size), F.slice(words, F.lit(2), size), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) < 2, F.array().cast("array<bigint>")).otherwise(F.array_distinct(pairs))


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """licence, template (number), wanted (its bigrams), wanted_size. Templates are a stated, small set."""
    rows = [(name, k, text) for name in sorted(templates) for k, text in enumerate(templates[name])]
    frame = spark.createDataFrame(rows, "licence string, template int, text string")
    words = frame.select("licence", "template", F.split(F.trim(F.translate(normalised(F.col("text")), "\n", " ")), " +").alias("words"))
    return words.select("licence", "template", bigrams(F.col("words")).alias("wanted")).withColumn("wanted_size", F.size("wanted"))


def unit_bigrams(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, line (null: the whole text) and grams, of every line and every whole text."""
    norm = docs.select(*keep, F.split(normalised(F.col("text")), "\n").alias("lines"))
    units = F.concat(
        F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("words"))),
        F.when(F.size("lines") > 1, F.array(F.struct(F.lit(None).cast("int").alias("line"), F.array_join("lines", " ").alias("words")))).otherwise(F.array().cast("array<struct<line:int,words:string>>")),
    )
    split = norm.select(*keep, F.explode(units).alias("u")).select(*keep, "u.line", F.split(F.trim("u.words"), " +").alias("words"))
    return split.select(*keep, "line", bigrams(F.col("words")).alias("grams"))


def licence_matches(docs: DataFrame, keep: list[str], templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, line (null: the whole text), licence, template and dice of every match."""
    table = template_table(docs.sparkSession, templates)
    known = sorted({g for r in table.select("wanted").collect() for g in r["wanted"]})
    units = unit_bigrams(docs, keep).filter(F.exists("grams", lambda g: g.isin(known)))
    size = F.size("grams")
    fits = ((2 - threshold) * size >= threshold * F.col("wanted_size")) & ((2 - threshold) * F.col("wanted_size") >= threshold * size)
    met = units.join(F.broadcast(table), fits).withColumn("dice", 2.0 * F.size(F.array_intersect("grams", "wanted")) / (size + F.col("wanted_size")))
    return met.filter(F.col("dice") >= threshold).select(*keep, "line", "licence", "template", "dice")


def licence_report(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, licence (best), dice, n_matches (lines and whole texts), licences (all, comma-joined)."""
    # A document is known by its id and text; equal rows have equal matches.
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    units = licence_matches(keyed, ["doc_id", "text_key"], templates, threshold)
    # One best licence a unit, then the sums of a document: all combine before the shuffle.
    best = units.groupBy("doc_id", "text_key", "line").agg(F.min_by("licence", F.struct(-F.col("dice"), F.col("licence"))).alias("licence"), F.max("dice").alias("dice"))
    per_doc = best.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.min_by("licence", F.struct(-F.col("dice"), F.col("licence"))).alias("licence"), F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_matches"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
    )
    return keyed.select("doc_id", "text_key").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select(
        "doc_id", "licence", "dice", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), F.coalesce("licences", F.lit("")).alias("licences")
    )
