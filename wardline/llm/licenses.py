"""Operator 2 (native): licences of documents by TF-IDF cosine to templates, inherited along directories.

1. Passages: the whole text, and of what has a word that licence statements use every line, every paragraph and every sentence of
   a paragraph (comment marks taken off, lines joined).  An SPDX identifier counts by itself, if SPDX has it.
2. A passage's sparse TF-IDF vector meets the templates' by a join on the term; the best cosine of CUTOFF or more wins
   (ties: the template's name).  Terms that no template has only lengthen the passage's vector.
3. A document whose whole text matches is a licence file and speaks for its directory; another matching passage is a header and speaks
   for its own document only.
4. Documents without a licence of their own get that of the nearest ancestor directory with a licence file: the distinct
   directories are joined with all their ancestors, once for each directory and not for each document.

Only DataFrame functions are used.  The templates are a fixed table of a few rows, so their terms may be broadcast.

Null and empty texts have no licence of their own but inherit; a null path is no directory's member and inherits nothing.
Repeated rows give repeated rows, a null id stays null; an empty table gives none; further columns are ignored, also those whose names
differ only in case.  Of several licence files in a
directory the best cosine wins, then the licence's name, then the path.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Statements and short full texts of public licences (fixed values); read_templates() adds a folder of longer ones.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction. The Software is provided as is, without warranty of any kind",
    "MIT/short": "Released under the MIT License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "MIT/full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause/full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.",
    "ISC/full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Public domain dedication CC0 1.0",
}
CUE = r"(?i)licen[cs]|copyright|spdx|public domain|permission is hereby|redistribution and use|free software"
TERM = r"[a-z0-9]+(?:[.][0-9]+)?"
CUTOFF, FILE_CUTOFF = 0.55, 0.6
#: SPDX identifiers (lower case) and their licences; others, also other versions, have none.
SPDX = {x.lower(): x for x in ("Apache-2.0", "MIT", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0")} | {x: "GPL-3.0" for x in ("gpl-3.0", "gpl-3.0+", "gpl-3.0-only", "gpl-3.0-or-later")}
SPDX_MARK = r"(?i)(SPDX-License-Identifier:[ \t]*\(?([a-z0-9.+-]*[a-z0-9+]))"
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|%+|--+|<!--)?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$"
_SENTENCE = r"(?<=[.!?])\s+(?=[A-Z])"


def unknown_idf(templates: dict[str, str]) -> float:
    """Weight of a term that no template has."""
    return math.log(1 + len(templates)) + 1


def weights(templates: dict[str, str]) -> tuple[list[tuple[str, str, float]], dict[str, float]]:
    """Rows (term, template, weight of the unit vector) and each term's idf."""
    terms = {name: Counter(re.findall(TERM, text.lower())) for name, text in templates.items()}
    df = Counter(t for own in terms.values() for t in own)
    idf = {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for name, own in terms.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items()))
        rows += [(t, name, n * idf[t] / norm) for t, n in sorted(own.items())]
    return rows, idf


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """TEMPLATES and the texts of a folder of licence files, such as full licences, by file name (without the suffix .txt)."""
    files = spark.read.format("text").option("wholetext", True).load(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value")
    return TEMPLATES | {f"{r['name']}/file": r["value"] for r in files.collect()}  # a few hundred licences


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Rows doc_id, path, license (null: none), method (header, file, inherited, none), score, evidence (a passage or a directory)."""
    spark = docs.sparkSession
    found, idf = weights(templates)
    values = ", ".join(f"('{t}', '{n}', {w!r}D, {idf[t]!r}D)" for t, n, w in found)
    terms = spark.sql(f"SELECT * FROM VALUES {values} AS t(term, template, weight, idf)")
    unknown = unknown_idf(templates)
    docs = c.distinct_names(docs, id_col, text_col, path_col).select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    cued = lambda parts: F.filter(F.transform(parts, lambda part: F.trim(part)), lambda part: part.rlike(CUE))
    lines = cued(F.split("text", "\n"))
    paragraphs = cued(F.transform(F.split(F.regexp_replace("text", MARKS, ""), r"\n\s*\n"), lambda part: F.regexp_replace(part, r"\s+", " ")))
    sentences = cued(F.flatten(F.transform(paragraphs, lambda part: F.split(part, _SENTENCE))))
    headers = F.transform(F.concat(lines, paragraphs, sentences), lambda part: F.struct(F.lit("header").alias("method"), part.alias("passage")))
    whole = F.array(F.struct(F.lit("file").alias("method"), F.col("text").alias("passage")))
    passages = docs.where(F.col("text").rlike(CUE)).select("doc_id", "path", F.explode(F.array_distinct(F.concat(whole, headers))).alias("p")).select("doc_id", "path", "p.*")
    # passages may be long: their terms go by a key; repeated rows scale a vector, which leaves its cosine
    key = F.md5(F.concat_ws("\x00", "method", F.col("doc_id").cast("string"), F.coalesce("path", F.lit("\x01")), "passage").cast("binary"))
    passages = passages.select(key.alias("key"), "*")
    counted = (
        passages.select("key", F.explode(F.regexp_extract_all(F.lower("passage"), F.lit(TERM), F.lit(0))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    )
    known = F.broadcast(terms.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "weight")).alias("in_templates")))
    weighted = counted.join(known, "term", "left").select("key", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("q"), "in_templates")
    norms = F.sqrt(F.sum(F.col("q") * F.col("q")))
    dots = weighted.select("key", "q", F.explode("in_templates").alias("t")).groupBy("key", "t.template").agg(F.sum(F.col("q") * F.col("t.weight")).alias("dot"))
    cosines = dots.join(weighted.groupBy("key").agg(norms.alias("norm")), "key").select("key", F.substring_index("template", "/", 1).alias("license"), F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    near = cosines.where(F.col("score") >= min(CUTOFF, FILE_CUTOFF)).join(passages, "key").select("doc_id", "path", "method", "passage", "license", "score")
    strong = near.where(F.col("score") >= F.when(F.col("method") == "file", FILE_CUTOFF).otherwise(CUTOFF))
    said = docs.where(F.col("text").rlike(SPDX_MARK)).select("doc_id", "path", F.explode(F.regexp_extract_all("text", F.lit(SPDX_MARK), F.lit(1))).alias("passage"))
    named = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])[F.lower(F.regexp_extract("passage", SPDX_MARK, 2))]
    strong = strong.unionByName(said.select("doc_id", "path", F.lit("header").alias("method"), "passage", named.alias("license"), F.lit(1.0).alias("score")).where("license is not null"))
    best = F.min_by(F.struct("license", "method", "score", "passage"), F.struct(-F.col("score"), "method", "license", "passage")).alias("b")
    own = strong.groupBy("doc_id", "path").agg(best).select("doc_id", "path", "b.license", F.col("b.method").alias("method"), "b.score", F.col("b.passage").alias("evidence"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    files = (
        strong.where("method = 'file' and path is not null").withColumn("dir", folder)
        .groupBy("dir").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), "license", "path")).alias("b")).select("dir", "b.license", "b.score")
    )
    dirs = docs.where("path is not null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/").alias("ancestor"))
    inherited = (
        above.join(files.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir")
        .agg(F.max_by(F.struct("license", "score", "ancestor"), "depth").alias("b")).select("dir", F.col("b.license").alias("d_license"), F.col("b.score").alias("d_score"), F.col("b.ancestor").alias("d_from"))
    )
    same = F.col("o.doc_id").eqNullSafe(F.col("x.doc_id")) & F.col("o.path").eqNullSafe(F.col("x.path"))
    rows = docs.select("doc_id", "path", folder.alias("dir")).alias("x").join(own.alias("o"), same, "left").select("x.doc_id", "x.path", "x.dir", "o.license", "o.method", "o.score", "o.evidence")
    rows = rows.join(inherited, "dir", "left")
    return rows.select(
        "doc_id", "path", F.coalesce("license", "d_license").alias("license"),
        F.when(F.col("license").isNotNull(), F.col("method")).when(F.col("d_license").isNotNull(), "inherited").otherwise("none").alias("method"),
        F.coalesce("score", "d_score").alias("score"), F.when(F.col("license").isNotNull(), F.col("evidence")).otherwise(F.col("d_from")).alias("evidence"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents with a path from their source and id: 512 rows to a folder, 64 to a folder within it."""
    shard = lambda n: F.expr(f"cast(floor(doc_id / {n}) as string)")
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("none")), shard(512), shard(64), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
