"""Column functions against the cases of their specifications."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import digests, paths, purl, spdx
from attestry.functions.vocabulary import Vocabulary
from attestry.plans import queries as q
from tests.conftest import one_column

LICENSE_NAMES = {
    "LICENSE": True, "LICENCE": True, "UNLICENSE": True, "LICENSE.md": True, "COPYING.txt": True, "COPYRIGHT": True, "LICENSE-APACHE": True, "MIT-COPYING": True, "OFL": True, "PATENTS.txt": True,
    "README.md": False, "copyme": False, "COPY": False, "license.go": False, "LICENSE.gemspec": False, "LICENSE.spdx": False, "src/LICENSE": True, "vendor/LICENSE": True, "LICENSE\n": False, "LICENSE.GO": True,
}
WEIGHTS = {"LICENSE": 1.0, "LICENSE.md": 0.95, "COPYING": 0.9, "LICENSE.textile": 0.8, "LICENSE-MIT": 0.7, "PATENTS": 0.35}
BUILT = paths.BUILD_OUTPUT[0]
EXCLUDED = {
    "COPYING": "", "manual/LICENSE.txt": "", "vendor/left/COPYING": "vendored", "a/third_party/right/LICENSE": "vendored", "Node_Modules/q/LICENSE": "vendored", "vendors/LICENSE": "", "pkg/fixtures/LICENSE": "test-fixture", "a/spec/b/COPYING": "test-fixture",
    "specials/LICENSE": "", "deps/a/samples/LICENSE": "vendored", f"{BUILT}/a/share/NOTICE": "build-output", "NOTICE": "supplementary", "deep/down/AUTHORS": "supplementary", "LICENCE": "", "external/x/CREDITS": "vendored",
    "rustc-1.80.2-src/vendor.txt/COPYING": "vendored", "envelope/COPYING": "", "lib/rust-srcs/COPYING": "", "demo/d/NOTICE": "supplementary",
}


def test_names_of_files(spark):
    assert one_column(spark, list(LICENSE_NAMES), paths.is_terms_file) == list(LICENSE_NAMES.values())
    assert one_column(spark, list(WEIGHTS), paths.terms_weight) == list(WEIGHTS.values())


def test_exclusion(spark):
    assert one_column(spark, list(EXCLUDED), paths.exclusion) == list(EXCLUDED.values())
    assert one_column(spark, ["authors", ".", f"src/{BUILT}s", "node_modules/left-pad"], paths.dir_exclusion) == ["", "", "", "vendored"]


def test_ancestors_and_members(spark):
    assert one_column(spark, ["a/b/c", "x"], paths.ancestors) == [["a", "a/b"], []]
    assert one_column(spark, ["./a//b", "/etc/x", "a/../b", "C:\\x", "a\\b"], paths.sanitize_member) == ["a/b", None, None, None, "a/b"]


GOLDEN = [
    ([("LICENSE", "sha256:a"), ("COPYING", "sha256:b")], None),
    ([], "v1-e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
]


def test_content_hash_ignores_order_and_covers_the_empty_set(spark):
    rows = [("a/LICENSE", "sha256:1"), ("COPYING", "sha256:2"), ("ä", "sha256:3"), ("COPYING", "sha256:2")]
    kind = "array<struct<path:string,digest:string>>"
    shuffled = random.Random(3).sample(rows, len(rows))
    one, two, empty = one_column(spark, [rows, shuffled, []], digests.content_hash, kind)
    assert one == two and empty == GOLDEN[1][1]
    import hashlib

    framed = b"".join(f"{len(p.encode())}:{p}{len(d.encode())}:{d}".encode() for p, d in sorted(rows, key=lambda r: (r[0].encode(), r[1].encode())))
    assert one == "v1-" + hashlib.sha256(framed).hexdigest()


def test_reference_golden(spark):
    assert one_column(spark, ["End User License Agreement\n", "", "End User License Agreement\r\n"], digests.license_ref) == ["LicenseRef-v1-8bae776427bb3b18", "", "LicenseRef-v1-8bae776427bb3b18"]


def test_lone_carriage_return_counts(spark):
    a, b, c = one_column(spark, ["x\r\ny", "x\ny", "x\ry"], digests.file_digest)
    assert a == b != c


def test_tag(spark):
    given = ["/* SPDX-License-Identifier: LGPL-2.1-or-later */", "# SPDX-License-Identifier: Apache-2.0", "// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "// SPDX-License-Identifier: MIT OR Apache-2.0", "/* just a copyright header */"]
    assert one_column(spark, given, spdx.tag) == ["LGPL-2.1-or-later", "Apache-2.0", "Apache-2.0 WITH LLVM-exception", "MIT OR Apache-2.0", None]


@pytest.mark.parametrize("expr", ["MIT", "MIT OR Apache-2.0", "MIT OR Apache-2.0 AND BSD-3-Clause", "(MIT OR Apache-2.0) AND BSD-3-Clause", "A OR (B OR C) AND (D AND E)"])
def test_rendering_is_stable(spark, expr):
    once = one_column(spark, [expr], lambda c: spdx.render(spdx.parse(c)))[0]
    assert one_column(spark, [once], lambda c: spdx.render(spdx.parse(c)))[0] == once
    same = one_column(spark, [expr, once], lambda c: spdx.operands(spdx.parse(c)))
    assert same[0] == same[1]


def test_random_expressions_evaluate_like_python(spark):
    rng = random.Random(5)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice("abcd")
        return f"({make(depth - 1)} {rng.choice(['AND', 'OR'])} {make(depth - 1)})"

    exprs = [make(4) for _ in range(60)]
    got = one_column(spark, exprs, lambda c: spdx.satisfies(spdx.parse(c), F.array(F.lit("a"), F.lit("c"))))
    want = [eval(e.replace("AND", "and").replace("OR", "or"), {"a": True, "b": False, "c": True, "d": False}) for e in exprs]
    assert got == want


def test_vocabulary_from_list(spark):
    v = Vocabulary.from_list([{"licenseId": "Foo-1.0", "name": "Foo License 1.0", "seeAlso": ["https://foo.org/l.txt", "https://shared.org/x"]}, {"licenseId": "Bar", "name": "Bar", "seeAlso": ["https://shared.org/x"]}, {"licenseId": "Old", "name": "Old", "isDeprecatedLicenseId": True}])
    assert one_column(spark, ["foo license, 1.0", "http://www.foo.org/l", "https://shared.org/x", "foo-1.0", "Old"], lambda c: spdx.from_text(c, v)) == ["Foo-1.0", "Foo-1.0", None, "Foo-1.0", None]


def test_purls(spark):
    assert one_column(spark, ["@scope/left pad", "left-pad"], lambda c: purl.npm(c, F.lit("1.0"))) == ["pkg:npm/@scope/left%20pad@1.0", "pkg:npm/left-pad@1.0"]
    assert one_column(spark, ["A._b-C"], purl.normalize_pypi) == ["a-b-c"]
    assert one_column(spark, ["py3.13-requests", "py3-Requests"], lambda c: purl.is_own_distribution(F.lit("requests"), c)) == [True, True]


CASES = [n for n in q.QUERIES if "from part join (values" in q.ORACLES.get(n, "")]


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Parts enough for every case to come more than once."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("parts")
    pq.write_table(pa.table({"p_partkey": pa.array(range(1, 71), pa.int64())}), folder / "part.parquet")
    return str(folder)


def test_there_are_cases():
    assert len(CASES) >= 14


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, parts, name):
    import duckdb

    got = q.QUERIES[name](spark, parts)
    part = duckdb.sql(f"select * from '{parts}/part.parquet'")  # noqa: F841 - read by name
    want = duckdb.sql(q.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted((tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall()), key=key)


def test_source_addresses(spark):
    got = lambda repo, commit: one_column(spark, [repo], lambda c: purl.source(F.lit("x"), F.lit("1"), c, F.lit(commit)))[0]
    assert got("https://github.com/a/b.git", "abc") == got("ssh://git@github.com/a/b.git", "abc") == "pkg:generic/github.com/a/b@abc"
    assert got("https://github.com/a/b/", "") == "pkg:generic/github.com/a/b@1" and got("", "abc") == "pkg:apk/x@1"


def test_refs(spark):
    assert one_column(spark, ["KUKA", " LicenseRef-x ", ""], spdx.ref) == ["LicenseRef-KUKA", "LicenseRef-x", ""]
    assert one_column(spark, ["gpl-2.0", "MIT"], spdx.is_deprecated) == [True, False]


def test_canonical_numbers_and_texts(spark):
    """Against the standard library, whose floats are the shortest and whose escapes are the same but for the exponent's form."""
    import json
    import random
    import struct

    from pyspark.sql import functions as F

    from attestry.functions import canonical

    rng = random.Random(1)
    floats = [0.0, 1.0, -1.0, 0.1, 1 / 3, 0.95, 2e-3, 1e-6, 9.5e-7, 1e-7, 123456789.0, 1e20, 1e21, 1.5e300, 5e-324, 2.2250738585072014e-308, 0.30000000000000004, 100.0, 12.5, 1e15 + 0.5, -0.0007]
    floats += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(300)) if x == x and abs(x) < 1e308] + [rng.random() for _ in range(300)]

    def plain(x):
        if x == int(x) and abs(x) < 1e21:
            digits = repr(abs(x)).split("e")[0].replace(".", "").rstrip("0") or "0"
            return ("-" if x < 0 else "") + digits.ljust(len(str(abs(int(x)))), "0")
        if 1e-6 <= abs(x) < 1e-4:
            return _positional(repr(x))
        s = repr(x)
        if "e" in s:
            m, e = s.split("e")
            return f"{m}e{'-' if e[0] == '-' else '+'}{abs(int(e))}"
        return s

    def _positional(s):
        m, e = s.split("e")
        sign, digits = ("-" if m[0] == "-" else ""), m.lstrip("-").replace(".", "")
        return f"{sign}0.{'0' * (-int(e) - 1)}{digits}"

    got = [r["o"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(floats)], "i int, v double").select("i", canonical.number(F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == [plain(x) for x in floats]
    texts = ["", "a", 'say "hi"', "back\\slash", "\\u001B literal", "\x1b[0m\x00\x0f\x1f", "\n\r\t\b\f", "é\u2028\u2029\U0001f600\x7f", "/</script>&", "\\\x1a\\\\\x1a"]
    want = [json.dumps(t, ensure_ascii=False).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029") for t in texts]
    got = [r["o"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, v string").select("i", canonical.text(F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == want
    bad = spark.createDataFrame([(bytearray(b"caf\xe9"),)], "v binary").select(canonical.text(F.col("v").cast("string")).alias("o")).first()["o"]
    assert bad == '"caf\ufffd"'
