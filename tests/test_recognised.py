"""Notices and known texts: chains of phrases, alignment against brute force, two texts in a file, altered texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from attestry.functions import spdx
from attestry.operators import detection, names, notices, spans

GNU = "# {0} is free software; you can redistribute it and/or\n# modify it under the terms of the {1} as published\n# by the Free Software Foundation; {2}\n"
TEXTS = [
    (GNU.format("Frob", "GNU General Public License", "either version 2 of the License, or (at your option) any later version."), [("GPL-2.0", "GPL-2.0-or-later", 1.0)]),
    (GNU.format("A B C", "GNU Lesser General Public License", "version 2.1 of the License."), [("LGPL-2.1", "LGPL-2.1-only", 1.0)]),
    (GNU.format("It", "GNU Library General Public License", "either version 2 of the License, or any later version."), [("LGPL-2.0", "LGPL-2.0-or-later", 1.0)]),
    (GNU.format("Odd", "GNU General Public License", "version 4 of the License."), []),
    ("// under the GNU GPL v2 or later", [("GPL-2.0", "GPL-2.0-or-later", 1.0)]),
    ("// under the GNU GPL v2", [("GPL-2.0", "GPL-2.0-only", 0.75)]),
    ("// GNU GPL, said somebody; and a long time after that a person of another mind altogether, one who had read no licence but the first, wrote v2", []),
    (GNU.format("Skel", "GNU General Public License", "either version 3 of the License, or any later version.") + "# words " * 60 + "As a special exception, you may use the Bison parser skeleton.", [("GPL-3.0-with-bison-exception", "GPL-3.0-or-later WITH Bison-exception-2.2", 1.0)]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\n" + GNU.format("Or", "GNU General Public License", "version 2 of the License."), [("GPL-2.0", "GPL-2.0-only", 1.0), ("MPL-2.0", None, None)]),
    (None, []), ("", []), ("Copyright 2020 Someone. All rights reserved.", []), ("x" * 200_000, []),
]


def test_headers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "k int, text string")
    got: dict = {}
    for r in notices.identify_headers(df, ["k"], notices.headers(spark)).orderBy("k", "rank").collect():
        got.setdefault(r["k"], []).append((r["name"], r["variant"], r["confidence"]))
    for i, (_, want) in enumerate(TEXTS):
        have = got.get(i, [])
        assert [n for n, _, _ in have] == [n for n, _, _ in want], i
        for (n, v, c), (_, grant, confidence) in zip(have, want):
            assert spdx.VOCABULARY.header_grants.get(f"{n}/{v}") == grant and (confidence is None or c == confidence), i


def test_every_grant_has_a_wording():
    known = spdx.VOCABULARY.header_grants
    made = {known.get(f"{n}/{v}") for n, v, _, _ in notices.standard_headers()}
    assert made - {None} == set(known.values())


def test_forbidden_and_optional_phrases(spark):
    own = notices.headers(spark, [("A", "x", 3, "alpha beta | [gamma] | delta | !omega"), ("B", "y", 3, "alpha beta gamma delta epsilon")])
    texts = ["alpha beta gamma delta", "alpha beta delta", "alpha beta one two three four delta", "alpha beta delta one omega", "alpha beta gamma delta epsilon", "delta alpha beta", "alpha beta x delta alpha beta gamma delta"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = sorted((r["k"], r["name"], r["first"], r["last"]) for r in notices.identify_headers(df, ["k"], own).collect())
    assert got == [(0, "A", 0, 4), (1, "A", 0, 3), (4, "B", 0, 5), (6, "A", 4, 8)]


def test_a_tag_comes_before_a_notice(spark):
    rows = [("c", "a.c", "// SPDX-License-Identifier: MIT\n" + TEXTS[0][0], 1), ("c", "b.c", TEXTS[0][0], 2), ("c", "d.c", TEXTS[0][0], 3)]
    got = sorted(tuple(r) for r in detection.grants(spark.createDataFrame(rows, "component_id string, path string, text string, nth long")).collect())
    assert got == [("c", "GPL-2.0-or-later", "header", "b.c", 2), ("c", "MIT", "spdx-tag", "a.c", 1)]


def least_edits(file, known):
    """Of the known text against any stretch of the file, by the plain table."""
    row = [0] * (len(file) + 1)
    for i, w in enumerate(known, 1):
        below = [i]
        for j, v in enumerate(file, 1):
            below.append(min(row[j - 1] + (v != w), row[j] + 1, below[-1] + 1))
        row = below
    return min(row)


def test_alignment_is_the_least(n=120):
    rng = random.Random(2)
    for _ in range(n):
        v = rng.choice([30, 400])
        known = [rng.randrange(v) for _ in range(rng.randrange(6, 90))]
        body = list(known)
        for _ in range(rng.randrange(0, len(body) // 6 + 1)):
            at = rng.randrange(len(body))
            match rng.randrange(3):
                case 0:
                    body[at] = rng.randrange(v)
                case 1 if len(body) > 3:
                    del body[at]
                case _:
                    body.insert(at, rng.randrange(v))
        file = [rng.randrange(1000, 2000) for _ in range(rng.randrange(80))] + body + [rng.randrange(1000, 2000) for _ in range(rng.randrange(80))]
        found = spans.place(np.array(file, np.int64), np.array(known, np.int64))
        if found is None:  # no three words in a row are left
            assert least_edits(file, known) > len(known) / 5
        else:
            first, last, edits = found
            assert edits == least_edits(file, known) and edits >= least_edits(file[first:last], known)


@pytest.mark.parametrize("values", [[], [3], [3, 1, 2], [1, 5, 2, 3, 9, 4], list(range(50))[::-1]])
def test_increasing(values):
    run = spans.increasing(np.array(values))
    picked = [values[i] for i in run]
    assert run == sorted(run) and picked == sorted(set(picked))
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert len(run) == max(best, default=0)


def test_two_texts_of_one_file_and_an_altered_one(spark):
    words = lambda a, n=60: [f"{a}{i}" for i in range(n)]
    longer = words("b", 40) + words("extra", 10) + words("b", 60)[40:]
    corpus = spark.createDataFrame([("A", " ".join(words("a"))), ("B", " ".join(words("b"))), ("B-long", " ".join(longer)), ("never", None)], "id string, text string")
    altered = words("a")
    altered[20:22] = ["some", "other", "words"]
    files = [(1, " ".join(["x", "y"] + words("a") + ["z"] + words("b"))), (2, " ".join(longer)), (3, " ".join(["p"] * 7 + altered)), (4, "Copyright (c) 2026 Example Corp. All rights reserved."), (5, None), (6, "")]
    got = sorted(tuple(r) for r in spans.identify(spark.createDataFrame(files, "k int, text string"), ["k"], corpus).collect())
    assert [r[:6] for r in got] == [(1, "A", 2, 62, 0, 60), (1, "B", 63, 123, 0, 60), (2, "B-long", 0, 70, 0, 70), (3, "A", 7, 68, 3, 60)]
    assert got[-1][6] == pytest.approx(1 - 3 / 60)


def test_names_by_dimension_are_those_of_the_plan(spark):
    """Whatever a vocabulary in the plan answers the dimension answers too, in the same order of precedence."""
    from pyspark.sql import functions as F

    from attestry.functions.vocabulary import CLASSIFIER_NAMES, SYNONYMS, UNLISTED, Vocabulary

    entries = [
        ("MIT", "MIT License", False, ["https://opensource.org/licenses/MIT"]), ("GPL-2.0-only", "GNU General Public License v2.0 only", False, ["https://www.gnu.org/licenses/old-licenses/gpl-2.0.html"]), ("GPL-2.0-or-later", "GNU General Public License v2.0 or later", False, ["https://www.gnu.org/licenses/old-licenses/gpl-2.0.html"]),
        ("GPL-2.0", "GNU General Public License v2.0 only", True, ["https://x.org/gone"]), ("PNG", "A name that a classifier uses too", False, []), ("Zed", None, None, None),
    ]
    vocabulary = Vocabulary.from_list([{"licenseId": i, "name": n or "", "isDeprecatedLicenseId": d, "seeAlso": s or ()} for i, n, d, s in entries])
    asked = ["mit", " MIT ", "GPL-2.0", "gpl-2.0", "GNU General Public License v2.0 only", "https://www.gnu.org/licenses/old-licenses/gpl-2.0.html", "http://x.org/gone", "PNG", "png", "zed", "", "  ", None, "nobody", "MIT License!", *CLASSIFIER_NAMES, *UNLISTED[:9], *SYNONYMS]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, said string")
    listed = spark.createDataFrame(entries, "licenseId string, name string, isDeprecatedLicenseId boolean, seeAlso array<string>")
    plan = df.select("i", spdx.normalize(F.col("said"), vocabulary).alias("r")).collect()
    want = {r["i"]: r["r"] for r in plan}
    for dim in (names.dimension(listed), names.built_in(spark, vocabulary)):
        got = {r["i"]: r["resolved"] for r in names.resolve(df, "said", dim).collect()}
        for i, a in enumerate(asked):
            assert a is None and (got[i] is None or not any(got[i])) or got[i] == want[i], (a, got[i], want[i])


def test_words_of_notices_are_looked_at_once(spark):
    """Not once for each length of phrase; wordings that lack a phrase are dropped before they are chained."""
    from attestry.operators import notices

    df = spark.createDataFrame([(1, "Part of it, under the GNU GPL v3 only."), (2, "GNU GPL, as in gnu gpl"), (3, None)], "k int, text string")
    found = notices.identify_headers(df, ["k"], notices.headers(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "array_except(must" in plan
    assert [(r["k"], r["name"], r["variant"]) for r in found.collect()] == [(1, "GPL-3.0", "b.txt")]
