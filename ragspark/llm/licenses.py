"""Licence scans with DataFrame functions only: TF-IDF cosine to templates, then inheritance along directories.

Every sentence of every whole text that holds a licence cue is a candidate. Equal sentences are handled once. Their
term vectors, weighted by inverse document frequency over all candidates, meet the templates' vectors in a join on the
term; the best template with a cosine of at least ``threshold`` names the licence. Beside them, the whole text, the opening
comment, and every paragraph and sentence of the text without comment marks and line breaks are units; their vectors meet
those of ``NOTICES`` (short licence texts whole, headers and titles of long ones), weighted by inverse document frequency
over the notices, so that a file's score does not depend on other files. A name in an SPDX tag counts 1. A file's own licence is that of its
best sentence or unit. A file with a licence of its own (of those that ``speaks`` allows, such as files named LICENSE) speaks for
its directory and everything below it; a file without one takes that of the nearest directory that has a speaker.

Ancestors are looked up for directories, not files, so a directory's files add nothing to that join. Null and empty
texts have no licence of their own and inherit; a null path has no directory. Ties go to the smaller licence name, in a
directory to the smaller id. Repeated rows give one row each; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import stored

#: Licence names with the statements that stand for them.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style 3-Clause license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, Version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, The Unlicense."),
)
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_REST = ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
             "the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
             "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
             "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
             "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
             "THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission.")
_BSD_REST = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
             "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
             "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
             "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
             "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
             "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
             "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.")
_ISC_REST = ("THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
             "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
             "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
             "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
             "PERFORMANCE OF THIS SOFTWARE.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
           "License. You may obtain a copy of the License at")
_APACHE_REST = ("http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
                "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                "either express or implied. See the License for the specific language governing permissions and limitations "
                "under the License.")
_GNU = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
        "the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
_GNU_REST = ("This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
             "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should "
             "have received a copy of the GNU {name} along with this {what}. If not, see http://www.gnu.org/licenses/.")
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
                   "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")
_GNU_KINDS = (("AGPL-3.0", "program", "Affero General Public License", "3", "19 November 2007"),
              ("GPL-2.0", "program", "General Public License", "2", "June 1991"),
              ("GPL-3.0", "program", "General Public License", "3", "29 June 2007"),
              ("LGPL-2.1", "library", "Lesser General Public License", "2.1", "February 1999"),
              ("LGPL-3.0", "library", "Lesser General Public License", "3", "29 June 2007"))
#: Whole texts of short licences, and headers and titles of long ones. Parts that two licences share stand in
#: whole texts only.
NOTICES = (
    *TEMPLATES, ("MIT", _MIT), ("MIT", f"{_MIT} {_MIT_REST}"), ("MIT", f"MIT License {_MIT} {_MIT_REST}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_REST}"), ("BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_REST}"), ("BSD-3-Clause", _BSD_THIRD),
    ("ISC", _ISC), ("ISC", f"{_ISC} {_ISC_REST}"), ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *((n, part.format(what=w, name=k, version=v)) for n, w, k, v, _ in _GNU_KINDS for part in (_GNU, f"{_GNU} {_GNU_REST}")),
    *((n, f"GNU {k} Version {v}, {day}") for n, _, k, v, day in _GNU_KINDS),
    ("MPL-2.0", _MPL), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", _UNLICENSE), ("Unlicense", f"{_UNLICENSE} {_UNLICENSE_REST}"),
)
#: SPDX names; ``-only``, ``-or-later`` and ``+`` do not count.
SPDX = ("0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause",
        "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0",
        "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3",
        "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL",
        "MS-RL", "MulanPSL-2.0", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "UPL-1.0", "Unlicense",
        "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1")
SPDX_TAG = r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)"
NOTICE_CUE = r"licen[cs]|copyright|spdx|public domain|hereby granted|redistribut|warrant|free software|prior written permission"
COMMENT = r"^[ \t]*(?:/\*|\*|//|#|--|;|%|<!--|\r?$)"
MARKS = (r"^[ \t]*(?:(?:/\*+|\*+/|\*+|//+!?|#+!?|--|;+|%+|<!--|\"\"\"|'{3})[ \t]*)?|[ \t]*(?:\*+/|-->|\"\"\"|'{3})?[ \t\r]*$")
OPENING = r"^\s*(?:#![^\n]*\n\s*)?(/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|<!--[\s\S]*?-->)"
CUE = r"licen[cs]|copyright|spdx|public domain|hereby granted"
SENTENCE = r"[.!?;][ \n\t]+|\n"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: The same with possessive repeats, which Java takes in a loop; it takes plain ones of a group by recursion, to the stack's end.
JAVA_TERM = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"
THRESHOLD = 0.75


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(JAVA_TERM), F.lit(0))


def candidates(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sentences with a cue, by id."""
    cue = F.lower(F.col(text_col)).rlike(CUE)
    return (files.where(cue).select(id_col, F.explode(F.split(text_col, SENTENCE)).alias("sentence"))
            .where(F.lower("sentence").rlike(CUE)))


def licence_of_sentences(found: DataFrame, threshold: float) -> DataFrame:
    """``sentence``, ``licence`` and ``score`` of the different sentences that match a template."""
    spark = found.sparkSession
    # partial sums leave one row per sentence and task, however often a sentence repeats
    different = stored(found.groupBy("sentence").agg(F.count("*").alias("copies")))
    tf = (different.select("sentence", "copies", F.explode(terms(F.col("sentence"))).alias("term"))
          .groupBy("sentence", "copies", "term").agg(F.count("*").alias("tf")))
    total = F.lit(different.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total")).first()["total"])
    df = tf.groupBy("term").agg(F.sum("copies").alias("df"))
    # one row per template statement and term: a fixed, small table
    bodies = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
    fixed = (spark.sql(f"select * from values {bodies} as bodies(template, licence, body)")
             .select("template", "licence", F.explode(terms(F.col("body"))).alias("term"))
             .groupBy("template", "licence", "term").agg(F.count("*").alias("template_tf")))
    known = stored(fixed.join(df, "term", "left").withColumn("idf", F.log((1 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1))
    lengths = known.groupBy("template").agg(F.sqrt(F.sum(F.pow(F.col("template_tf") * F.col("idf"), 2))).alias("template_norm"))
    side = F.broadcast(known.join(F.broadcast(lengths), "template").select(
        "template", "licence", "term", (F.col("template_tf") * F.col("idf")).alias("template_weight"), "template_norm"))
    weighted = tf.join(df, "term").select(
        "sentence", "term", (F.col("tf") * (F.log((1 + total) / (1 + F.col("df"))) + 1)).alias("weight"))
    norms = weighted.groupBy("sentence").agg(F.sqrt(F.sum(F.pow("weight", F.lit(2)))).alias("norm"))
    dots = (weighted.join(side, "term").groupBy("sentence", "template", "licence", "template_norm")
            .agg(F.sum(F.col("weight") * F.col("template_weight")).alias("dot")))
    cosines = dots.join(norms, "sentence").select(
        "sentence", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6).alias("score"))
    best = cosines.where(F.col("score") >= threshold).groupBy("sentence").agg(
        F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("best"))
    return best.select("sentence", F.col("best.licence").alias("licence"), (-F.col("best.order")).alias("score"))


def units(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``unit`` by id: whole text, opening comment, paragraphs and sentences, without comment marks and line breaks."""
    def bare(lines: Column) -> Column:
        return F.transform(lines, lambda line: F.regexp_replace(line, MARKS, ""))

    def flat(text: Column) -> Column:
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    lines = F.split(text_col, "\n")
    code = F.array_position(F.transform(lines, lambda line: line.rlike(COMMENT)), F.lit(False)).cast("int")
    top = F.when(code > 1, F.slice(lines, F.lit(1), code - 1)).otherwise(F.array().cast("array<string>"))
    opening = F.split(F.regexp_extract(text_col, OPENING, 1), "\n")
    cut = (files.where(F.lower(F.col(text_col)).rlike(NOTICE_CUE)).select(
        id_col, bare(lines).alias("lines"), F.array(*(F.array_join(bare(x), " ") for x in (top, opening))).alias("heads"))
        .withColumn("paragraphs", F.transform(F.split(F.array_join("lines", "\n"), r"\n[ \t]*\n"), flat)))
    parts = F.flatten(F.transform("paragraphs", lambda p: F.split(p, r"(?<=[.!?;]) ")))
    every = F.concat(F.array(F.array_join("lines", " ")), F.col("heads"), F.col("paragraphs"), parts)
    return (cut.select(id_col, F.explode(F.array_distinct(F.transform(every, flat))).alias("unit"))
            .where(F.lower("unit").rlike(NOTICE_CUE)))


def notices(files: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``licence`` and ``score`` by id, of the units that match a notice and of the names in SPDX tags."""
    spark = files.sparkSession
    tags = F.regexp_extract_all(text_col, F.lit(SPDX_TAG), F.lit(1))
    names = F.regexp_extract_all(F.lower(F.array_join(tags, " ")), F.lit(r"[a-z0-9][a-z0-9.-]*"), F.lit(0))
    listed = ", ".join(f"('{x.lower()}', '{x}')" for x in SPDX)
    tagged = (files.where(F.lower(F.col(text_col)).rlike("spdx-license-identifier")).select(id_col, F.explode(names).alias("name"))
              .withColumn("name", F.regexp_replace("name", "-(only|or-later)$", ""))
              .join(F.broadcast(spark.sql(f"select * from values {listed} as names(name, licence)")), "name")
              .select(id_col, "licence", F.lit(1.0).alias("score")))
    bodies = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(NOTICES))
    fixed = (spark.sql(f"select * from values {bodies} as bodies(template, licence, body)")
             .select("template", "licence", F.explode(terms(F.col("body"))).alias("term"))
             .groupBy("template", "licence", "term").agg(F.count("*").alias("tf")))
    rarity = F.log((1 + F.lit(len(NOTICES))) / (1 + F.coalesce("df", F.lit(0)))) + 1
    df = stored(fixed.groupBy("term").agg(F.count("*").alias("df")))
    known = stored(fixed.join(df, "term").select("template", "licence", "term", (F.col("tf") * rarity).alias("template_weight")))
    sizes = known.groupBy("template").agg(F.sqrt(F.sum(F.pow("template_weight", F.lit(2)))).alias("template_norm"))
    # a digest stands for the unit, so rows of terms do not carry its text
    found = stored(units(files, id_col, text_col).withColumn("key", F.md5("unit")))
    tf = (found.dropDuplicates(["key"]).select("key", F.explode(terms(F.col("unit"))).alias("term"))
          .groupBy("key", "term").agg(F.count("*").alias("tf")))
    weighted = stored(tf.join(F.broadcast(df), "term", "left").select("key", "term", (F.col("tf") * rarity).alias("weight")))
    norms = weighted.groupBy("key").agg(F.sqrt(F.sum(F.pow("weight", F.lit(2)))).alias("norm"))
    dots = (weighted.join(F.broadcast(known), "term").groupBy("key", "template", "licence")
            .agg(F.sum(F.col("weight") * F.col("template_weight")).alias("dot")))
    cosines = dots.join(F.broadcast(sizes), "template").join(norms, "key").select(
        "key", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6).alias("score"))
    best = cosines.where(F.col("score") >= threshold).groupBy("key").agg(
        F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("best"))
    matched = found.select(id_col, "key").join(best, "key")
    return matched.select(id_col, F.col("best.licence").alias("licence"), (-F.col("best.order")).alias("score")).unionByName(tagged)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan_licences(files: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                  path_col: str = "path", speaks: Column | None = None) -> DataFrame:
    """Per file its own licence and score, the licence that holds for it, where from, and the directory inherited from."""
    found = stored(candidates(files, id_col, text_col))
    matched = licence_of_sentences(found, threshold)
    sentences = found.join(matched, "sentence").select(id_col, "licence", "score").unionByName(
        notices(files, threshold, id_col, text_col))
    own = sentences.groupBy(id_col).agg(F.min(F.struct((-F.col("score")).alias("order"), F.col("licence"))).alias("best"))
    own = own.select(id_col, F.col("best.licence").alias("own_licence"), (-F.col("best.order")).alias("own_score"))
    allowed = F.lit(True) if speaks is None else speaks
    rows = stored(files.select(id_col, F.col(path_col).alias("path"), parent(F.col(path_col)).alias("dir"),
                               allowed.alias("speaks")).join(own, id_col, "left"))
    spoken = (rows.where("speaks and own_licence is not null and dir <> ''").groupBy("dir")
              .agg(F.min(F.struct(F.col(id_col), F.col("own_licence"))).alias("first"))
              .select(F.col("dir").alias("from_dir"), F.col("first.own_licence").alias("inherited")))
    # every different directory once, with itself and all its ancestors
    parts = F.split("dir", "/")
    directories = rows.where("own_licence is null and dir <> ''").select("dir").distinct().select(
        "dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)),
                                     lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("from_dir"))
    nearest = (directories.join(spoken, "from_dir").groupBy("dir")
               .agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "inherited")).alias("near"))
               .select("dir", F.col("near.from_dir").alias("near_dir"), F.col("near.inherited").alias("near_licence")))
    joined = rows.join(nearest, "dir", "left")
    has = F.col("own_licence").isNotNull()
    return joined.select(
        id_col, "path", "own_licence", "own_score",
        F.when(has, F.col("own_licence")).otherwise(F.col("near_licence")).alias("licence"),
        F.when(has, "own").when(F.col("near_licence").isNotNull(), "inherited").alias("origin"),
        F.when(~has, F.col("near_dir")).alias("from_dir"))


#: The same in DuckDB's SQL over ``documents``, with the query's paths.
ORACLE = f"""
with files as (
  select doc_id, text, source || case when doc_id % 100 = 0 then '' when doc_id % 10 = 0 then '/' || (doc_id // 5000)
         else '/' || (doc_id // 5000) || '/' || (doc_id // 50) end as dir from documents),
split as (select doc_id, unnest(string_split_regex(text, '{SENTENCE}')) as sentence
          from files where regexp_matches(lower(text), '{CUE}')),
found as (select * from split where regexp_matches(lower(sentence), '{CUE}')),
different as (select sentence, count(*) as copies from found group by 1),
tf as (select sentence, copies, term, count(*) as tf from
       (select sentence, copies, unnest(regexp_extract_all(lower(sentence), '{TERM}')) as term from different) group by all),
total as (select coalesce(sum(copies), 0) as total from different),
df as (select term, sum(copies) as df from tf group by 1),
bodies(template, licence, body) as (values
  {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))}),
fixed as (select template, licence, term, count(*) as tf from
          (select template, licence, unnest(regexp_extract_all(lower(body), '{TERM}')) as term from bodies) group by all),
known as (select template, licence, f.term, f.tf * (ln((1.0 + total) / (1 + coalesce(df, 0))) + 1) as w
          from fixed f left join df using (term), total),
weighted as (select sentence, tf.term, tf * (ln((1.0 + total) / (1 + df)) + 1) as w from tf join df using (term), total),
cosines as (
  select w.sentence, k.template, k.licence,
         round(sum(w.w * k.w) / (any_value(n.norm) * any_value(m.norm)), 6) as score
  from weighted w join known k using (term)
  join (select sentence, sqrt(sum(w * w)) as norm from weighted group by 1) n on n.sentence = w.sentence
  join (select template, sqrt(sum(w * w)) as norm from known group by 1) m on m.template = k.template group by 1, 2, 3),
best as (select sentence, licence, score from cosines where score >= {THRESHOLD}
         qualify row_number() over (partition by sentence order by score desc, licence) = 1),
own as (select doc_id, first(licence order by score desc, licence) as own_licence, max(score) as own_score from found join best using (sentence) group by 1),
marked as (select * from files left join own using (doc_id)),
spoken as (select dir as from_dir, first(own_licence order by doc_id) as inherited from marked
           where own_licence is not null group by 1),
near as (select doc_id, from_dir, inherited from marked m join spoken s on m.dir = s.from_dir or starts_with(m.dir, s.from_dir || '/')
         where own_licence is null qualify row_number() over (partition by doc_id order by length(from_dir) desc) = 1)
select doc_id, dir || '/' || doc_id as path, own_licence, own_score, coalesce(own_licence, inherited) as licence,
       case when own_licence is not null then 'own' when inherited is not null then 'inherited' end as origin, from_dir
from marked left join near using (doc_id)
"""
