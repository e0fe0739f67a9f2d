"""Readers of staged artifacts, copies and their verification, functions by name in SQL."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

import attestry.plans.recorded  # noqa: F401 - registers its queries
from attestry.functions import digests, purl, registry, spdx
from attestry.sources import maven, published, staged
from attestry.sources.trees import files_of
from tests.test_operators import tarred

STAGED = "purl string, ecosystem string, name string, version string, recorded string, file_name string, content binary"


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in members:
            z.writestr(n, c)
    return out.getvalue()


def test_refusals_and_digests(spark):
    crate = tarred([("a-1/LICENSE", b"l")])
    rows = [
        ("p1", "cargo", "a", "1", None, "a-1.crate", bytearray(crate)), ("p2", "cargo", "a", "1", "", "a-1.zip", bytearray(crate)), ("p3", "cargo", "", "1", "", "a-1.crate", bytearray(crate)), ("p4", "cargo", "a", "1", "", "a-1.crate", None),
        ("p5", "gem", "a", "1", "", "a.gem", bytearray(crate)), ("p6", None, "a", "1", "", "a", bytearray(crate)), ("p7", "npm", "a", "1", "md5-x", "a-1.tgz", bytearray(crate)), ("p8", "golang", "a", "1", "", "1.zip", bytearray(b"no zip")), ("p9", "cargo", "a", "1", "", "a-1.crate", bytearray(b"x" * 5000)),
    ]
    df = spark.createDataFrame(rows, STAGED)
    got = {r["purl"]: r for r in published.artifacts(df, max_bytes=4000).collect()}
    errors = {k: r["error"] for k, r in got.items()}
    assert errors == {"p1": None, "p2": "not an archive of its kind: a-1.zip", "p3": "a name and a version are needed", "p4": "nothing is staged", "p5": "no reader for gem", "p6": "no reader for an unnamed ecosystem", "p7": "it can't be hashed", "p8": "it can't be hashed", "p9": "larger than the bound"}
    assert not any(r["matched"] for r in got.values()) and len(got["p1"]["digest"]) == 64
    read = published.published_files(df, max_bytes=4000)
    assert sorted((r["component_id"], r["path"]) for r in read.where("read_error is null").collect()) == [("p1", "LICENSE"), ("p7", "a-1/LICENSE")]
    assert read.where("read_error is not null").select("component_id").distinct().count() == 7
    assert published.artifacts(df.limit(0)).count() == 0 and published.published_files(df.limit(0)).count() == 0


def test_a_later_reader_replaces_an_earlier_one(spark):
    mine = published.Reader("gem", "sha256", lambda c, r: F.sha2(c, 256), lambda n, v, f: F.lit("data"), (".gem.zip",))
    other = published.Reader("gem", "sha1", lambda c, r: F.sha1(c), lambda n, v, f: F.lit("data"), (".gem.zip",))
    by = published.readers(mine, other)
    assert by["gem"] is other and len(by) == 6
    df = spark.createDataFrame([("g", "gem", "x", "1", "", "x.gem.zip", bytearray(zipped([("data/LICENSE", b"l")])))], STAGED)
    assert [r["digest_algo"] for r in published.artifacts(df, by).collect()] == ["sha1"]
    assert [(r["path"], r["read_error"]) for r in published.published_files(df, by).collect()] == [("LICENSE", None)]


def test_module_hash_of_a_zip_is_that_of_its_files(spark):
    members = [("m@v1/b", b"bb"), ("m@v1/a.go", b"code"), ("m@v1/LICENSE", b"")]
    df = spark.createDataFrame([(bytearray(zipped(members)), [(n, bytearray(c)) for n, c in members])], "z binary, files array<struct<path:string,content:binary>>")
    r = df.select(published.zip_dirhash("z").alias("a"), staged.go_dirhash(F.col("files")).alias("b")).first()
    assert r["a"] == r["b"] and r["a"].startswith("h1:")


def test_copies_without_what_deeper_ones_own(spark):
    tree = files_of(spark.createDataFrame([("c", "vendor/a/LICENSE", "x"), ("c", "vendor/a/b/LICENSE", "y"), ("c", "vendor/a/main.c", "z"), ("d", "vendor/a/LICENSE", "other")], "component_id string, path string, content string"))
    roots = spark.createDataFrame([("c", "pa", "vendor/a"), ("c", "pb", "vendor/a/b")], "component_id string, purl string, root string")
    assert sorted((r["purl"], r["path"]) for r in published.local_files(tree, roots).collect()) == [("pa", "LICENSE"), ("pb", "LICENSE")]
    crates = spark.createDataFrame([("pa", "cargo", "a", "1", "", "a-1.crate", bytearray(tarred([("a-1/LICENSE", b"x")]))), ("pb", "cargo", "b", "1", "", "b-1.crate", bytearray(b"broken"))], STAGED)
    got = {r["purl"]: (r["verdict"], r["reason"]) for r in published.verified_copies(tree, roots, crates).collect()}
    assert got == {"pa": ("pristine", ""), "pb": ("diverged", "nothing is published to compare with")}


def test_text_that_was_not_retained(spark):
    rows = [("a", "LICENSE", 1.5, "", 9, None, None, "text"), ("b", "LICENSE", 1.5, "", 9, None, None, None), ("c", "LICENSE", 1.5, "", 9, None, ["MIT"], "text")]
    df = spark.createDataFrame(rows, "component_id string, path string, weight double, excluded string, size_bytes long, read_error string, names array<string>, text string")
    got = {r["component_id"]: (r["text"], r["error"]) for r in published.unrecognised_text(df).collect()}
    assert got == {"a": ("text", None), "b": (None, "the text of LICENSE wasn't retained")}


def test_corpus_folder_and_roles(spark, tmp_path):
    (tmp_path / "One-1.0.txt").write_text("first")
    (tmp_path / "notes.md").write_text("no")
    assert [tuple(r) for r in published.corpus_of(spark, str(tmp_path)).collect()] == [("One-1.0", "first")]
    source, installed = published.by_role(spark.createDataFrame([("a", "source"), ("b", "installed"), ("c", "source")], "component_id string, tree_role string"))
    assert source.count() == 2 and installed.count() == 1 and "tree_role" not in source.columns


def test_sql_functions_equal_the_columns(spark):
    names = registry.register(spark)
    assert registry.register(spark) == names
    texts = ["a\r\nb\rc\n", "", "  Apache License, Version 2.0\t", "LicenseRef-x", " LicenseRef-y ", "A__b.-C ", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    df.createOrReplaceTempView("registry_cases")
    c = F.col("s")
    pairs = {
        "att_normalized_hex(s)": digests.normalized_hex(c), "att_file_digest(s)": digests.file_digest(c), "att_text_ref(s)": digests.license_ref(c), "att_plain_text(s)": spdx.normalize_text(c), "att_pypi_name(s)": purl.normalize_pypi(c), "att_is_ref(s)": spdx.is_ref(c),
        "att_purl_golang(s, '')": purl.golang(c, F.lit("")), "att_purl_cargo(s, '1')": purl.cargo(c, F.lit("1")), "att_purl_pypi(s, null)": purl.pypi(c, F.lit(None)), "att_purl_maven(s, s, '2')": purl.maven(c, c, F.lit("2")),
    }
    for sql, column in pairs.items():
        assert spark.sql(f"select s, {sql} as o from registry_cases").exceptAll(df.select("s", column.alias("o"))).count() == 0, sql
    out = zipped([("x/LICENSE", b"abc"), ("x/a.c", b"")])
    spark.createDataFrame([("x.zip", bytearray(out)), ("y.zip", bytearray(b"bad"))], "name string, content binary").createOrReplaceTempView("registry_archives")
    got = spark.sql("select a.name, t.path, t.size_bytes, t.error is null as good from registry_archives a, lateral att_expand_archive(a.name, a.content, 'x') t").collect()
    assert sorted(tuple(r) for r in got) == [("x.zip", "LICENSE", 3, True), ("y.zip", "y.zip", 0, False)]


def _pom(inner):
    return f"<project>{inner}</project>".encode()


def _up(artifact, group="org.e", version="1"):
    return f"<parent><groupId>{group}</groupId><artifactId>{artifact}</artifactId><version>{version}</version></parent>"


SAYS = "<licenses><license><name>Terms</name></license></licenses>"


def test_maven_components(spark):
    jar = zipped([("META-INF/LICENSE.txt", b"t"), ("a/B.class", b"x"), ("pom.xml", b"inner")])
    poms = [
        ("org.e", "own", "1", _pom(SAYS + _up("root"))), ("org.e", "root", "1", _pom(SAYS)), ("org.e", "child", "1", _pom(_up("mid", " ", ""))), ("org.e", "mid", "1", _pom(_up("root"))), ("org.e", "loop", "1", _pom(_up("loop2"))), ("org.e", "loop2", "1", _pom(_up("loop"))),
        ("org.e", "orphan", "1", _pom(_up("nowhere"))), ("org.e", "broken", "1", b"<project><parent>"), ("org.e", "latin", "1", "<project><name>é</name></project>".encode("latin-1")), *[("org.e", f"deep{i}", "1", _pom(_up(f"deep{i + 1}"))) for i in range(12)],
    ]
    names = ["own", "child", "loop", "orphan", "broken", "latin", "deep0", "jar-only", "neither"]
    staged = [(f"p:{n}", "maven", f"org.e:{n}", "1", hashlib.sha1(jar).hexdigest() + "  file", "x.jar", jar if n in ("own", "jar-only") else None) for n in names]
    staged += [("p:bad", "maven", "no-colon", "1", None, None, jar), ("p:blank", "maven", ":x", "1", None, None, jar), ("p:other", "npm", "x", "1", None, None, jar)]
    arts, files = maven.resolve(spark.createDataFrame(staged, STAGED), spark.createDataFrame(poms, "group_id string, artifact_id string, version string, content binary"))
    got = {r["purl"][2:]: r for r in arts.collect()}
    held = {}
    for r in files.collect():
        held.setdefault(r["component_id"][2:], set()).add(r["path"])
    assert held["own"] == {"pom.xml", "META-INF/LICENSE.txt"} and got["own"]["matched"] and got["own"]["notes"] == []
    assert held["child"] == {"pom.xml", "pom-parent-1.xml", "pom-parent-2.xml"} and got["child"]["notes"] == [maven.NO_JAR] and not got["child"]["matched"]
    assert held["loop"] == {"pom.xml", "pom-parent-1.xml"} and held["orphan"] == held["broken"] == held["latin"] == {"pom.xml"}
    assert len(held["deep0"]) == 8 and held["jar-only"] == {"META-INF/LICENSE.txt"} and got["jar-only"]["notes"] == [maven.NO_POM]
    assert got["neither"]["error"].startswith("gone") and "neither" not in held and "bad" not in held and "needed" in got["bad"]["error"] and "needed" in got["blank"]["error"] and "other" not in got


def test_tree_source(spark, tmp_path):
    """Directories that can't be listed, links that lead away, filters that reach the source."""
    import os

    from attestry.sources import tree_source

    for name, text in (("a/LICENSE", "one"), ("a/src/x/deep.c", "int x;"), ("a/src/y/COPYING", "two"), ("b/README", "three"), ("outside.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "a" / "LICENSE", tmp_path / "a" / "src" / "LICENSE")
    os.symlink(tmp_path / "outside.txt", tmp_path / "a" / "LICENSE-out")
    os.symlink(tmp_path / "a" / "nothing", tmp_path / "a" / "LICENSE-gone")
    os.symlink(tmp_path / "a", tmp_path / "a" / "src" / "loop")
    (tmp_path / "b" / "pipe").symlink_to("/proc/self/mem")
    (tmp_path / "c").write_text("a file where a tree should be")
    root = str(tmp_path)
    files = tree_source.read_directories(spark, root, ["a", "b", "c", "d"])
    got = {(r["component_id"], r["path"]): (bytes(r["content"]).decode() if r["content"] is not None else None, r["size_bytes"]) for r in files.where("read_error is null").collect()}
    assert got == {("a", "LICENSE"): ("one", 3), ("a", "src/x/deep.c"): ("int x;", 6), ("a", "src/y/COPYING"): ("two", 3), ("a", "src/LICENSE"): ("one", 3), ("b", "README"): ("three", 5)}
    lost = {r["component_id"]: r["source_error"] for r in tree_source.subjects_of(files).collect()}
    assert lost["a"] is None and lost["b"] is None and lost["c"] and lost["d"]
    names = tree_source.read_directories(spark, root, names="COPYING*")
    assert sorted(r["path"] for r in names.where("content is not null").collect()) == ["src/y/COPYING"] and names.count() == 5

    reader = tree_source.TreeReader({"path": root, "split": "3"})
    list(reader.pushFilters([tree_source.EqualTo(("component_id",), "a"), tree_source.StringStartsWith(("path",), "src/y")]))
    plan = reader.partitions()
    assert {(p.component, p.directory) for p in plan} == {("a", ""), ("a", "src"), ("a", "src/y")}
    assert [r["path"] for b in map(reader.read, plan) for batch in b for r in batch.to_pylist()] == ["src/y/COPYING"]
    assert [r["path"] for r in files.where("component_id = 'a' and path like '%COPYING'").collect()] == ["src/y/COPYING"]

    broken = tree_source.TreeReader({"path": root})
    whole = broken.listed

    def listed(at):
        if at.endswith("/src/x"):
            raise PermissionError(13, "Permission denied", at)
        return whole(at)

    broken.listed = listed
    rows = [r for b in map(broken.read, broken.partitions()) for batch in b for r in batch.to_pylist()]
    assert [(r["path"], r["read_error"]) for r in rows if r["read_error"]] == [("src/x/", "Permission denied")] and len(rows) == 6 - 1 + 0


def test_archives_by_ranges(spark, tmp_path):
    """The same members as from whole contents, whatever an archive is packed with; refused archives are one row."""
    from attestry.sources import archives, ranges

    def packed(kind, members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", kind) as z:
            for n, c in members:
                z.writestr(n, c)
        return out.getvalue()

    members = [("x-1/LICENSE", b"one" * 50_000), ("x-1/a/COPYING", b""), ("x-1/src/m.c", b"int"), ("other/LICENSE", b"no"), ("../LICENSE", b"up"), ("x-1/LICENSE", b"one" * 50_000)]
    bodies = {
        "s.zip": packed(zipfile.ZIP_STORED, members), "d.jar": packed(zipfile.ZIP_DEFLATED, members), "l.whl": packed(zipfile.ZIP_LZMA, members), "t.tar.gz": tarred(members), "late.tgz": tarred([("other/LICENSE", b"no"), *members]), "none.tgz": tarred(members[3:4]),
        "cut.zip": packed(zipfile.ZIP_DEFLATED, members)[:400], "cut.tgz": tarred(members)[:100], "two.zip": packed(zipfile.ZIP_DEFLATED, [("LICENSE", b"1"), ("LICENSE", b"2")]), "odd.rar": b"x", "plain.zip": b"", "empty.zip": packed(zipfile.ZIP_STORED, []),
    }
    damaged = bytearray(packed(zipfile.ZIP_STORED, [("LICENSE", b"terms of use")]))
    damaged[45] ^= 1
    bodies["bit.zip"] = bytes(damaged)
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    staged_ = spark.createDataFrame([(n, n, f"file://{tmp_path}/{n}", "x-1") for n in [*bodies, "gone.zip"]], "component_id string, name string, uri string, prefix string")
    got = {}
    for r in ranges.expand_ranges(staged_).collect():
        got.setdefault(r["component_id"], {})[r["path"]] = bytes(r["content"]) if r["read_error"] is None else "!"
    for name, body in bodies.items():
        try:
            want = archives.expand(name, body, "x-1")
        except archives.DAMAGED:
            want = {name: "!"}
        assert got.get(name, {}) == want, name
    assert got["gone.zip"] == {"gone.zip": "!"} and got["bit.zip"] == {"bit.zip": "!"} and set(got["late.tgz"]) == {"LICENSE", "a/COPYING"}


def test_streamed_archives_cut_anywhere(tmp_path):
    """A tar.gz that ends too soon is refused, though all that was met before is whole."""
    from attestry.sources import archives, ranges

    whole = tarred([("x/LICENSE", b"l"), ("x/src/main.c", b"int x;"), ("x/docs/README.md", b"read me")])
    for n in range(20, len(whole)):
        (tmp_path / "c.tgz").write_bytes(whole[:n])
        with pytest.raises(archives.DAMAGED):
            list(ranges._streamed(f"file://{tmp_path}/c.tgz", "x"))


def against_sql(spark, folder, name, documents):
    """(rows of the query, rows of its SQL) over documents(doc_id, source, text)."""
    import duckdb

    from attestry.plans.queries import ORACLES, QUERIES

    spark.createDataFrame(documents, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    ran = QUERIES[name](spark, str(folder))
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
        want = con.execute(f"select {', '.join(ran.columns)} from ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, ran.collect())), sorted(want)


def test_grants_of_sources_without_tags(spark, tmp_path):
    """Sources (doc_id 240 to 279) that state a licence in words, at the end of the sampled head and behind it."""
    said = "Licensed under the GNU General Public License, version 3.\n"
    texts = {241: said, 242: "x " * 900 + said, 244: "é " * 662 + "x" * 10 + said, 245: "x " * 1100 + said, 261: said, 262: "none"}
    rows = [(k, f"src{k % 3}" if k < 260 else "one", texts.get(k, said)) for k in range(240, 280)]
    got, want = against_sql(spark, tmp_path, "spdx_tag_grants", rows)
    assert got == want and any(r[2] == "header" for r in got)


def parts_table(spark, folder, n=24):
    names = [(k, f"part {k}", f"Brand#{k % 3}") for k in range(n)]
    spark.createDataFrame(names, "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_staged_artifacts_are_made_and_read_once(spark, tmp_path):
    """One pass, however many readers there are; a row that isn't read reaches neither reader nor archive."""
    from attestry.plans.queries import QUERIES

    folder = parts_table(spark, tmp_path)
    assert python_steps(QUERIES["staged_artifacts"](spark, folder)) == 1
    rows = [("p1", "cargo", "a", "1", "a-1.crate", bytearray(tarred([("a-1/LICENSE", b"l")]))), ("p2", "gem", "b", "1", "b.gem", bytearray(b"x")), ("p3", "cargo", "c", "1", None, bytearray(b"y"))]
    df = spark.createDataFrame(rows, "purl string, ecosystem string, name string, version string, file_name string, content binary").withColumn("recorded", F.lit(""))
    assert {r["purl"]: (r["digest_algo"], r["error"]) for r in published.artifacts(df).collect()} == {"p1": ("sha256", None), "p2": (None, "no reader for gem"), "p3": (None, "not an archive of its kind: ")}


def test_staged_files_are_read_in_one_pass(spark, tmp_path):
    from attestry.plans import formed
    from attestry.plans.queries import QUERIES

    folder = parts_table(spark, tmp_path)
    assert python_steps(QUERIES["staged_files"](spark, folder)) == 2  # made, expanded
    spread = formed._spread(spark.range(3 * formed._TASK_ROWS).coalesce(1), "id")
    assert spread.rdd.getNumPartitions() == 4


def test_poms_are_made_once(spark, tmp_path):
    from attestry.plans.queries import QUERIES

    out = QUERIES["maven_resolution"](spark, parts_table(spark, tmp_path))
    assert python_steps(out) == 0 and out.count() == 24


def test_changes_are_written_by_many_tasks(spark, tmp_path):
    import glob

    from attestry.sources import scratch

    base = scratch.folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{base}/keys-*"))
    rows = [(k, f"src{k % 3}", f"text {k}") for k in range(400)]
    got, want = against_sql(spark, tmp_path, "content_keys_by_change", rows)
    (mine,) = set(glob.glob(f"{base}/keys-*")) - before
    assert got == want and len(glob.glob(f"{mine}/feed/*.parquet")) > 3


def test_tree_batches_are_small(tmp_path):
    from attestry.sources import tree_source

    (tmp_path / "c").mkdir()
    for i in range(8):
        (tmp_path / "c" / f"f{i}").write_bytes(bytes(1 << 20))
    reader = tree_source.TreeReader({"path": str(tmp_path)})
    sizes = [b.nbytes for p in reader.partitions() for b in reader.read(p)]
    assert len(sizes) > 2 and max(sizes) < 4 << 20
