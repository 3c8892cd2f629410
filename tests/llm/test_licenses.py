import math
import re
from collections import Counter

from wardline.llm import licenses

APACHE = "Licensed under the Apache License, Version 2.0."
GPL = "This work is licensed under the GNU General Public License, version 3."


def cosine(a, b, idf, unknown):
    va, vb = ({t: n * idf.get(t, unknown) for t, n in Counter(re.findall(licenses.TERM, x.lower())).items()} for x in (a, b))
    return sum(va[t] * vb.get(t, 0) for t in va) / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))


def test_headers_files_and_inheritance(spark):
    prose = "Some words of prose that say nothing. " * 3
    rows = [
        (1, "r/a/LICENSE", APACHE), (2, "r/a/b/one.txt", prose), (3, "r/a/b/two.txt", prose + "\n" + GPL), (4, "r/c/x.txt", prose), (5, "LICENSE", "Released under the MIT License."),
        (6, "r/a/b/c/LICENSE", GPL), (7, "r/a/b/c/d/y.txt", None), (8, None, prose), (9, "r/c/z.txt", "a licence is a word here"), (9, "r/c/z.txt", "a licence is a word here"), (10, "r/q.txt", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 as term", "2 as dir")
    found = licenses.scan_licenses(df).collect()
    assert len(found) == len(rows)
    have = {r.doc_id: (r.license, r.method) for r in found}
    assert have == {
        1: ("Apache-2.0", "file"), 2: ("Apache-2.0", "inherited"), 3: ("GPL-3.0", "header"), 4: ("MIT", "inherited"), 5: ("MIT", "file"), 6: ("GPL-3.0", "file"),
        7: ("GPL-3.0", "inherited"), 8: (None, "none"), 9: ("MIT", "inherited"), 10: ("MIT", "inherited"),
    }
    weights, idf = licenses.weights(licenses.TEMPLATES)
    want = cosine(GPL, licenses.TEMPLATES["GPL-3.0/short"], idf, math.log(1 + len(licenses.TEMPLATES)) + 1)
    assert abs(next(r.score for r in found if r.doc_id == 3) - want) < 1e-8
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_wrapped_headers_identifiers_and_long_files(spark):
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n\nint main;"
    prose = "Gardens and rivers say nothing about it. " * 20
    names = ["MIT", "Apache-2.0", "GPL-3.0-only", "GPL-2.0-only", "ISC"]
    rows = [(1, "a/x.c", mpl), (2, "b/y.txt", prose + GPL + " " + prose), (3, "c/LICENSE", (APACHE + "\n") * 100), (4, "c/z.txt", "prose"), (5, None, GPL)]
    rows += [(10 + i, f"s/{i}.c", f"// SPDX-License-Identifier: {x}\nint x;") for i, x in enumerate(names)]
    have = {r.doc_id: (r.license, r.method) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert have == {
        1: ("MPL-2.0", "header"), 2: ("GPL-3.0", "header"), 3: ("Apache-2.0", "file"), 4: ("Apache-2.0", "inherited"), 5: ("GPL-3.0", "file"),
        10: ("MIT", "header"), 11: ("Apache-2.0", "header"), 12: ("GPL-3.0", "header"), 13: (None, "none"), 14: (None, "none"),
    }


def test_full_texts_null_ids_and_clashing_names(spark, tmp_path):
    own = "Own licence. Everybody may use this software and its documentation for any purpose under the terms of this licence. " * 400
    (tmp_path / "Own-1.0.txt").write_text(own)
    templates = licenses.read_templates(spark, str(tmp_path))
    rows = [(1, "a/LICENSE", own), (None, "a/b/x.txt", "no word of it"), (None, "a/b/x.txt", None), (2, "c/LICENSE", licenses.TEMPLATES["MIT/full"] + "\n" + licenses.TEMPLATES["MIT/full"]), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'no' as TEXT", "1 as key", "2 as license")
    have = sorted((tuple(r[:4]) for r in licenses.scan_licenses(df, templates=templates).collect()), key=str)
    assert have == sorted([(1, "a/LICENSE", "Own-1.0", "file"), (None, "a/b/x.txt", "Own-1.0", "inherited"), (None, "a/b/x.txt", "Own-1.0", "inherited"), (2, "c/LICENSE", "MIT", "file"), (3, None, None, "none")], key=str)
