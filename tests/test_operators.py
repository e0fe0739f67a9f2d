"""Operators over small trees and archives."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from attestry.operators import classify, components, detection, ownership
from attestry.plans import evidence
from attestry.sources import archives
from attestry.sources.trees import files_of, read_trees
from attestry.streaming.incremental import undetermined, watch


def files(spark, rows):
    return files_of(spark.createDataFrame(rows, "component_id string, path string, content string"))


def test_project_scope_order(spark):
    names = ["LICENSE", "COPYING", "LICENSE-MIT", "OFL.md", "PATENTS", "docs/LICENSE", "vendor/LICENSE", "a/b/c/LICENSE", "main.go", "README.md", "license.go"]
    found = detection.ordered(detection.discover(files(spark, [("c", n, "x") for n in names]), "project")).orderBy("ord")
    assert [r["path"] for r in found.collect()] == ["LICENSE", "COPYING", "LICENSE-MIT", "OFL.md", "docs/LICENSE", "PATENTS"]


def test_notice_stride(spark):
    rows = [("c", f"s/f{i:03}.c", "x") for i in range(100)] + [("d", f"f{i}.c", "" if i == 0 else "y") for i in range(3)]
    got = [(r["component_id"], r["path"]) for r in detection.notice_sample(files(spark, rows)).orderBy("component_id", "nth").collect()]
    assert [p for c, p in got if c == "c"] == [f"s/f{i:03}.c" for i in range(0, 96, 4)]
    assert [p for c, p in got if c == "d"] == ["f1.c", "f2.c"]


def test_nested_roots(spark):
    tree = files(spark, [("c", p, "t" + p) for p in ("LICENSE", "vendor/a/LICENSE", "vendor/a/vendor/b/LICENSE", "vendor/ab/LICENSE", "testdata/x/LICENSE")])
    roots = spark.createDataFrame([("c", "vendor/a"), ("c", "vendor/a/vendor/b")], "component_id string, root string")
    owned = {r["path"]: r["root"] for r in ownership.owners(tree, roots).collect()}
    assert owned["vendor/a/LICENSE"] == "vendor/a" and owned["vendor/a/vendor/b/LICENSE"] == "vendor/a/vendor/b" and owned["vendor/ab/LICENSE"] is None
    assert [r["path"] for r in ownership.own_files(tree, roots).collect()] == ["LICENSE"]


def test_verify(spark):
    local = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("q", "a", "1")], "purl string, path string, digest string")
    published = spark.createDataFrame([("p", "a", "0", 0), ("p", "a", "1", 1), ("p", "c", "9", 0), ("q", "a", "1", 0)], "purl string, path string, digest string, ord int")
    got = {r["purl"]: (r["verdict"], r["reason"]) for r in ownership.verify(local, published).collect()}
    assert got == {"p": ("diverged", "b is not published"), "q": ("pristine", "")}


def test_classify_two_texts_in_one_file(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    corpus = spark.createDataFrame([("A", words("a")), ("B", words("b")), ("C", words("c"))], "id string, text string")
    given = spark.createDataFrame([(1, "Copyright (c) 2020 someone\n" + words("a") + ".\n" + words("B") + "\n" + words("c")[:60]), (2, "Copyright 2020"), (3, None)], "k int, text string")
    assert sorted((r["k"], r["id"]) for r in classify.identify(given, ["k"], corpus).collect()) == [(1, "A"), (1, "B")]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in members:
            z.writestr(n, c)
    return out.getvalue()


def tarred(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n, c in members:
            i = tarfile.TarInfo(n)
            i.size = len(c)
            t.addfile(i, io.BytesIO(c))
    return out.getvalue()


@pytest.mark.parametrize("pack, name", [(zipped, "x.zip"), (tarred, "x.tar.gz")])
def test_archives(pack, name):
    body = pack([("x-1/LICENSE", b"l"), ("x-1/src/a.py", b"p"), ("../LICENSE", b"bad"), ("other/COPYING", b"o"), ("x-1/LICENSE", b"l")])
    assert archives.expand(name, body, "x-1") == {"LICENSE": b"l"}
    assert set(archives.expand(name, body, "wrong")) == {"x-1/LICENSE", "other/COPYING"}
    with pytest.raises(archives.Refused):
        archives.expand(name, pack([("LICENSE", b"1"), ("LICENSE", b"2")]))


def test_archive_errors_are_rows(spark):
    df = spark.createDataFrame([("a", "x.zip", bytearray(b"no zip"), ""), ("b", "y.whl", bytearray(zipped([("METADATA", b"Name: y")])), "")], "component_id string, name string, content binary, prefix string")
    got = {r["component_id"]: (r["path"], r["read_error"]) for r in archives.expand_all(df).collect()}
    assert got["a"][1] and got["b"] == ("METADATA", None)


def test_jars(spark):
    jar = zipped([("META-INF/maven/g/a/pom.properties", b"groupId=g\nartifactId=a\nversion=1\n"), ("META-INF/maven/h/b/pom.properties", b"version=2\ngroupId=h\nartifactId=b\n")])
    tree = spark.createDataFrame([("c", "lib/x.JAR", bytearray(jar), len(jar), None)], "component_id string, path string, content binary, size_bytes long, read_error string")
    assert sorted(r["purl"] for r in components.enumerate_java(tree).collect()) == ["pkg:maven/g/a@1", "pkg:maven/h/b@2"]


def test_collect(spark):
    mit = " ".join(f"mit{i}" for i in range(50))
    tree = files(spark, [("c", "LICENSE", mit), ("c", "vendor/github.com/a/b/LICENSE", "other terms"), ("c", "go.mod", "module x"), ("c", "go.sum", "github.com/a/b v1.0.0 h1:q="), ("c", "package.json", '{"license": "MIT"}'), ("e", "README.md", "no mention")])
    corpus = spark.createDataFrame([("MIT", mit)], "id string, text string")
    out = evidence.collect(tree.select("component_id").distinct(), tree, corpus)
    row = {r["component_id"]: r for r in out.collect()}
    assert row["c"]["expression"] == "MIT" and row["c"]["score"] == 1.0 and row["c"]["purls"] == ["pkg:golang/github.com/a/b@v1.0.0"] and row["c"]["flags"] == ""
    assert row["e"]["reason"] == "no-license-text" and row["e"]["terms_content_hash"].startswith("v1-e3b0c442")
    bundle = evidence.bundles(out).where("component_id = 'c'").first()
    assert bundle["bundle"].startswith('{"schema_version":1,"subject"') and bundle["bundle"].endswith("\n")


def test_every_kind_of_gap_and_note(spark):
    mit = " ".join(f"mit{i}" for i in range(50))
    rows = [
        ("c", "LICENSE", mit.encode(), None), ("c", "COPYING", None, "denied"), ("c", "deep/", None, "no permission"), ("c", "package-lock.json", b'{"packages": {"node_modules/a b": {"version": "1", "resolved": "https://r.org/x"}, "node_modules/d": {"dev": true}}}', None),
        ("c", "big/LICENSE", b"long " * 40_000, None), ("c", "README", b"x\nLicensed \xff as you like\n", None), ("c", "Cargo.lock", b"package = 1", None), ("c", "go.mod", b"module x", None),
    ]
    files = spark.createDataFrame([(c, p, b, len(b or b""), e) for c, p, b, e in rows], "component_id string, path string, content binary, size_bytes bigint, read_error string")
    subjects = spark.createDataFrame([("c", "1.0", None, "denied"), ("lost", None, "no tree", None), ("bare", None, None, None)], "component_id string, version string, source_error string, installed_error string")
    corpus = spark.createDataFrame([("MIT", mit)], "id string, text string")
    said = spark.createDataFrame([("c", "LICENSE", "MIT", 0, "ISC"), ("c", "TERMS", "Own", 1, None), ("c", "src/notes.c", " MIT ", 2, None), ("c", None, "MIT", 3, None)], "component_id string, path string, license string, ord int, override string")
    collected = evidence.collect(subjects, files, corpus, declarations=said)
    got = {r["component_id"]: r for r in collected.collect()}
    gaps = {c: [(g["kind"], g["detail"]) for g in r["gaps"]] for c, r in got.items()}
    assert gaps["c"] == [
        ("unreadable-tree", "deep: could not be read"), ("installed", "denied"), ("dependencies", "cargo: Cargo.lock: doesn't parse: package is of another kind"), ("license-file", "COPYING: denied"),
        ("license-file", "TERMS: declared, but not in the tree"), ("license-file", "src/notes.c: declared, but not in the tree"),
    ]
    assert [k for k, _ in gaps["lost"]] == ["source", "no-installed-trees"] and [k for k, _ in gaps["bare"]] == ["no-installed-trees"] and got["lost"]["unknown"]
    assert got["c"]["notes"] == [
        "1 texts cut at 131072 bytes", "1 component identities dropped for blanks or control characters", "go: no list and no checksums of modules beside go.mod; none is enumerated", "npm: 1 development dependencies excluded; they are not shipped"
    ]
    assert got["c"]["declared_expression"] == "MIT AND Own" and got["c"]["subject"]["version"] == "1.0" and [p["excerpt"] for p in got["c"]["prose"]] == ["Licensed � as you like"]
    made = {r["component_id"]: r["bundle"] for r in evidence.bundles(collected).collect()}
    assert '"declared":[{"license":"MIT","path":"LICENSE","override":"ISC"},{"license":"Own","path":"TERMS"},{"license":" MIT ","path":"src/notes.c"},{"license":"MIT"}]' in made["c"]
    assert '"license":"MIT","confidence":1,"declared":"MIT","override":"ISC","size_bytes"' in made["c"] and '"path":"TERMS","weight":0,"license":"NOASSERTION","confidence":0,"declared":"Own"' in made["c"]
    assert '"relationship"' not in made["lost"] and '"gaps":[{"kind":"source","detail":"no tree"}' in made["lost"]


def test_the_account_is_one_fold(spark):
    rows = spark.createDataFrame([("c", "LICENSE", "x")], "component_id string, path string, content string")
    tree = files_of(rows)
    corpus = spark.createDataFrame([("MIT", "permission is hereby granted")], "id string, text string")
    plan = evidence.collect(tree.select("component_id").distinct(), tree, corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") < 20 and plan.count("Union") < 8, (plan.count("Scan parquet"), plan.count("Union"))


def test_read_trees(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "LICENSE").write_text("x")
    (tmp_path / "one" / "src" / "COPYING").write_text("yy")
    got = sorted((r["component_id"], r["path"], r["size_bytes"]) for r in read_trees(spark, str(tmp_path)).collect())
    assert got == [("one", "LICENSE", 1), ("one", "src/COPYING", 2)]


def test_incremental(spark, tmp_path):
    hashes = spark.createDataFrame([("a", "h1"), ("b", "h2")], "component_id string, terms_content_hash string")
    known = spark.createDataFrame([("h1",)], "terms_content_hash string")
    assert [r["component_id"] for r in undetermined(hashes, known).collect()] == ["b"]
    hashes.write.parquet(str(tmp_path / "in"))
    seen = []
    arrivals = spark.readStream.schema(hashes.schema).parquet(str(tmp_path / "in"))
    watch(arrivals, lambda: known, lambda df, i: seen.extend(r["terms_content_hash"] for r in df.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert seen == ["h2"]


def test_content_keys_follow_changes(spark, tmp_path):
    """Late, repeated and removed: after each batch the keys are those of the files that are there."""
    from attestry.functions import digests
    from attestry.streaming import incremental

    batches = [
        [("a", "LICENSE", "1", False, 1), ("a", "COPYING", "2", False, 1), ("b", "LICENSE", "3", False, 1), ("b", "main.c", "x", False, 1)],
        [("a", "COPYING", "", True, 5), ("a", "LICENSE", "4\r\n", False, 5), ("a", "LICENSE", "0", False, 4)],
        [("a", "COPYING", "2", False, 3), ("b", "LICENSE", "", True, 6), ("b", "LICENSE", "", True, 6)],
        [("a", "LICENSE", "4\n", False, 9), ("c", "LICENSE", "5", False, 1)],
    ]
    want = [{"a": {"LICENSE": "1", "COPYING": "2"}, "b": {"LICENSE": "3"}}, {"a": {"LICENSE": "4\n"}}, {"b": {}}, {"c": {"LICENSE": "5"}}]
    schema = "component_id string, path string, content string, removed boolean, seq long"
    seen = []
    for rows in batches:
        incremental.changes_of(spark.createDataFrame(rows, schema).withColumn("content", F.col("content").cast("binary"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        out = []
        arrivals = spark.readStream.schema(incremental.CHANGE).parquet(str(tmp_path / "feed"))
        query = incremental.content_keys(arrivals).writeStream.outputMode("update").foreachBatch(lambda df, _, out=out: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        seen.append({r["component_id"]: (r["terms_content_hash"], r["files"]) for r in out})
    for got, components in zip(seen, want):
        sets = [(c, [{"path": p, "digest": d} for p, d in files.items()]) for c, files in components.items()]
        df = spark.createDataFrame(sets, "c string, f array<struct<path:string,digest:string>>")
        hashed = F.transform("f", lambda x: F.struct(x["path"].alias("path"), digests.file_digest(x["digest"]).alias("digest")))
        assert got == {r["c"]: (r["h"], len(components[r["c"]])) for r in df.select("c", digests.content_hash(hashed).alias("h")).collect()}


def test_plans_stay_in_the_jvm(spark):
    tree = files(spark, [("c", "LICENSE", "x")])
    plan = ownership.component_hashes(tree.select("component_id").distinct(), tree)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert detection.discover(tree)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert F is not None


def test_lost_lockfiles_are_gaps(spark):
    rows = [
        ("a", "Cargo.lock", b"not = = toml", 12, None), ("b", "package-lock.json", b"{", 1, None), ("c", "Cargo.lock", None, 9, "denied"), ("d", "package-lock.json", b"{}", (64 << 20) + 1, None),
        ("e", "Cargo.lock", b"version = 3", 11, None), ("f", "go.mod", b"module x", 8, None), ("f", "go.sum", None, 5, "denied"),
    ]
    files = spark.createDataFrame(rows, "component_id string, path string, content binary, size_bytes bigint, read_error string")
    from attestry.operators import components

    got = sorted((r["component_id"], r["detail"]) for r in components.lockfile_gaps(files).collect())
    assert [(c, d.split(": ")[:3]) for c, d in got] == [
        ("a", ["cargo", "Cargo.lock", "doesn't parse"]), ("b", ["npm", "package-lock.json", "doesn't parse"]), ("c", ["cargo", "Cargo.lock", "denied"]), ("d", ["npm", "package-lock.json", f"is larger than the {64 << 20} byte limit"]), ("f", ["golang", "go.sum", "denied"])
    ]
    from attestry.plans import evidence

    corpus = spark.createDataFrame([("MIT", "permission is hereby granted")], "id string, text string")
    gaps = {r["component_id"]: [g["kind"] for g in r["gaps"]] for r in evidence.collect(files.select("component_id").distinct(), files, corpus).collect()}
    assert all(("dependencies" in gaps[c]) == (c != "e") for c in "abcdef")


def test_verify_without_either_side(spark):
    local = spark.createDataFrame([("p", "a", "1")], "purl string, path string, digest string")
    published = spark.createDataFrame([("q", "a", "1", 0)], "purl string, path string, digest string, ord int")
    asked = spark.createDataFrame([("p",), ("q",), ("r",)], "purl string")
    got = {r["purl"]: (r["verdict"], r["reason"]) for r in ownership.verify(local, published, asked).collect()}
    assert got == {"p": ("diverged", "nothing is published to compare with"), "q": ("pristine", ""), "r": ("pristine", "")}


def test_unreadable_files_leave_no_key(spark):
    rows = [("a", "LICENSE", b"x", 1, None), ("a", "COPYING", None, 0, "denied"), ("b", "LICENSE", b"x", 1, None), ("c", "main.c", None, 0, "denied")]
    tree = spark.createDataFrame(rows, "component_id string, path string, content binary, size_bytes bigint, read_error string")
    got = {r["component_id"]: (r["terms_content_hash"], r["error"]) for r in ownership.component_hashes(tree.select("component_id").distinct(), tree).collect()}
    assert got["a"] == (None, "COPYING: denied") and got["b"][0].startswith("v1-") and got["b"][1] is None and got["c"][0].startswith("v1-e3b0c442")


def test_archives_of_several_members_and_damaged_ones(spark):
    import bz2
    import gzip

    whole = tarred([("x/LICENSE", b"l" * 2000)])
    plain = gzip.decompress(whole)
    assert archives.expand("x.tgz", gzip.compress(plain[:700]) + gzip.compress(plain[700:]), "x") == {"LICENSE": b"l" * 2000}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("LICENSE", b"some text of a file " * 500)
    body = bytearray(out.getvalue())
    at = body.find(b"BZh") + 20
    body[at : at + 30] = b"\xff" * 30
    assert bz2 is not None
    df = spark.createDataFrame([("a", "x.zip", body, ""), ("b", "x.tgz", bytearray(whole[:60]), "")], "component_id string, name string, content binary, prefix string")
    assert all(r["read_error"] for r in archives.expand_all(df).collect())


def test_prose_is_trimmed_of_all_white_space(spark):
    tree = files(spark, [("c", "README.md", "\t\u00a0License: MIT\u2003\t\r\nnothing\n \x0blicence\x0c ")])
    assert [(r["line"], r["excerpt"]) for r in detection.prose_hints(tree).orderBy("line").collect()] == [(1, "License: MIT"), (3, "licence")]


def test_setup_cfg_across_lines(spark):
    from attestry.operators.manifests import setup_cfg_terms
    from tests.conftest import one_column

    assert one_column(spark, ["[metadata]\nlicense =\n    MIT\nname = x", "license = File: x", "LICENSE= BSD \r\n", "license_expression = MIT", "license = file: x", "other = 1"], setup_cfg_terms) == ["MIT", "File: x", "BSD", "MIT", "", ""]


def test_last_line_of_a_checksum_file_holds(spark):
    tree = files(spark, [("c", "go.mod", "module x"), ("c", "go.sum", "a.org/b v1.0.0 h1:one=\na.org/c v1.0.0 h1:q=\na.org/b v1.0.0 h1:two=")])
    assert sorted((r["purl"], r["digest"]) for r in components.enumerate_go(tree).collect()) == [("pkg:golang/a.org/b@v1.0.0", "h1:two="), ("pkg:golang/a.org/c@v1.0.0", "h1:q=")]


def test_whole_record(spark):
    """Declared-only and missing files, weak matches, vendored copies, lost jars and metadata, notes; the source component leads."""
    import json

    mit, isc = (" ".join(f"{w}{i}" for i in range(50)) for w in ("mit", "isc"))
    half = " ".join(f"isc{i}" for i in range(24))
    tree = files(spark, [
        ("c", "LICENSE", mit), ("c", "odd-terms.rst", half), ("c", "vendor/a.org/b/LICENSE", isc), ("c", "go.mod", "module x"), ("c", "go.sum", "a.org/b v1.0.0 h1:q="), ("c", "vendor/modules.txt", "# a.org/b v1.0.0\n"), ("c", "README.md", "Dual licensed, see the license files"),
        ("c", "package.json", '{"license": "MIT"}'), ("c", "package-lock.json", '{"packages": {"node_modules/d": {"version": "1", "dev": true}, "node_modules/l": {"link": true}}}'), ("c", "src/a.c", "// SPDX-License-Identifier: MIT\nint x;"),
    ])
    installed = spark.createDataFrame([("c", "lib/x.jar", bytearray(b"no jar"), 6, None), ("c", "p/y-1.dist-info/RECORD", bytearray(b""), 0, None), ("c", "p/z-1.dist-info/METADATA", bytearray(b"Name: z\nVersion: 1\n"), 20, None)], "component_id string, path string, content binary, size_bytes long, read_error string")
    declared = spark.createDataFrame([("c", "odd-terms.rst", "ISC", 0), ("c", "gone.txt", "MIT", 1)], "component_id string, path string, license string, ord int")
    subjects = spark.createDataFrame([("c", "thing", "1.2"), ("empty", None, None)], "component_id string, name string, version string")
    out = evidence.collect(subjects, tree, spark.createDataFrame([("MIT", mit), ("ISC", isc)], "id string, text string"), installed, declared)
    records = {r["component_id"]: json.loads(r["bundle"]) for r in evidence.bundles(out).collect()}
    r = records["c"]
    listed = {f["path"]: f for f in r["files"]}
    assert [f["path"] for f in r["files"]][0] == "LICENSE" and listed["odd-terms.rst"]["declared"] == "ISC" and 0.4 < listed["odd-terms.rst"]["confidence"] < 0.5 and listed["gone.txt"]["error"]
    assert listed["LICENSE"]["text"] == mit and listed["vendor/a.org/b/LICENSE"]["excluded"] == "vendored"
    assert [p["purl"] for p in r["components"]] == ["pkg:apk/thing@1.2", "pkg:golang/a.org/b@v1.0.0", "pkg:pypi/z@1"] and r["components"][0]["kind"] == "package-source"
    assert r["components"][1]["license_content_hash"].startswith("v1-") and "license_content_hash" in r["components"][0] and r["components"][1]["license_content_hash"] != r["license_content_hash"]
    assert r["vendor_root"] == "vendor" and r["vendored_copies"] == [{"purl": "pkg:golang/a.org/b@v1.0.0", "root": "vendor/a.org/b"}]
    assert r["manifests"] == [{"path": "go.mod", "ecosystem": "golang", "license": ""}, {"path": "package.json", "ecosystem": "npm", "license": "MIT"}] and r["prose"][0]["line"] == 1 and r["notices_sampled"] == 1 and r["grants"][0]["expression"] == "MIT"
    assert [g["kind"] for g in r["gaps"]] == ["dependencies", "dependencies", "license-file"] and "1 of 1 jars" in r["gaps"][0]["detail"] and "1 dist-info" in r["gaps"][1]["detail"] and "gone.txt" in r["gaps"][2]["detail"]
    assert len(r["notes"]) == 3 and r["assessment"]["rationale"].startswith("project ") and "declared-conflict" in r["assessment"]["flags"]
    assert records["empty"]["files"] == [] and records["empty"]["conclusion"]["reason"] == "no-license-text" and len(records["empty"]["components"]) == 1


def test_gzip_files_cut_anywhere():
    """Whatever a cut leaves whole, an archive that ends too soon is refused; what follows the last member is left out."""
    import gzip

    whole = tarred([("x/LICENSE", b"l"), ("x/src/main.c", b"int x;"), ("x/docs/README.md", b"read me")])
    for n in range(20, len(whole)):
        with pytest.raises(archives.DAMAGED):
            archives.expand("c.tgz", whole[:n], "x")
    assert set(archives.expand("c.tgz", whole + b"more", "x")) == {"LICENSE", "docs/README.md"}
    # A piece of nothing but zeros within a member isn't its end.
    stored = gzip.compress(gzip.decompress(tarred([("LICENSE", bytes(400_000)), ("COPYING", b"c")])), 0)
    assert {p: len(c) for p, c in archives.expand("s.tgz", stored).items()} == {"LICENSE": 400_000, "COPYING": 1}


def test_manifests_that_declare_nothing_are_no_evidence(spark):
    tree = files(spark, [("silent", "go.mod", "module x"), ("silent", "package.json", "{}"), ("says", "package.json", '{"license": "MIT"}'), ("points", "Cargo.toml", '[package]\nlicense-file = "T"\n')])
    corpus = spark.createDataFrame([("MIT", "one two three four five six")], "id string, text string")
    out = evidence.collect(tree.select("component_id").distinct(), tree, corpus).select("component_id", "unknown", F.size("manifests").alias("n"))
    assert {r["component_id"]: (r["unknown"], r["n"]) for r in out.collect()} == {"silent": (True, 2), "says": (False, 1), "points": (False, 1)}
