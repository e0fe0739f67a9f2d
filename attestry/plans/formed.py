"""Queries whose forms are spread over the driver's tables: manifests, lockfiles, archives, expressions and addresses made of their rows.

The SQL gives what the forms' specifications demand of the same rows; it knows nothing of how the engine reads them."""

from __future__ import annotations

import base64
import hashlib
import io
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import digests, registry, spdx
from attestry.operators import components, conclude, manifests, ownership
from attestry.plans.queries import _DIGEST, _FINE, _TREE, _fine_files, _q, query, table, tree
from attestry.sources import archives, published, staged
from attestry.sources.trees import files_of


def _pick(values: tuple, k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def _sql_pick(values: tuple, k: str) -> str:
    return f"[{', '.join(map(_q, values))}][1 + cast({k} as int)]"


def _mod(c: str, n: int, by: int = 1) -> Column:
    return F.pmod(F.floor(F.col(c) / by), F.lit(n))


#: Rows of a table for each task that makes their forms; a few files or row groups would be as few tasks.
_TASK_ROWS = 5000


def _spread(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(1 + rows.count() // _TASK_ROWS, key)


_NAMES = ("MIT", "Apache-2.0", "ISC", "Zlib", "BSD-3-Clause")


# Expressions: three names, four shapes, two sets of accepted names.
@query(f"""with e as (select p_partkey, {_sql_pick(_NAMES, 'p_partkey % 5')} as a, {_sql_pick(_NAMES, '(p_partkey // 5) % 5')} as b, {_sql_pick(_NAMES, '(p_partkey // 25) % 5')} as c, (p_partkey // 125) % 4 as form,
  case when p_partkey % 2 = 0 then ['MIT', 'ISC'] else ['Apache-2.0', 'Zlib', 'BSD-3-Clause'] end as ok from part),
t as (select *, list_contains(ok, a) as ta, list_contains(ok, b) as tb, list_contains(ok, c) as tc from e)
select p_partkey, case form when 0 then ta or (tb and tc) when 1 then (ta or tb) and tc when 2 then (ta and tb) or tc else ta and (tb or tc) end as satisfied, array_to_string(list_sort(list_distinct([a, b, c])), '|') as names,
  case form when 0 then a || ' OR ' || b || ' AND ' || c when 1 then '(' || a || ' OR ' || b || ') AND ' || c when 2 then a || ' AND ' || b || ' OR ' || c else a || ' AND (' || b || ' OR ' || c || ')' end as rendered from t""")
def expression_algebra(spark, sf_dir):
    a, b, c = (_pick(_NAMES, _mod("p_partkey", 5, n)) for n in (1, 5, 25))
    form = _mod("p_partkey", 4, 125)
    text = F.when(form == 0, F.concat(a, F.lit(" or  "), b, F.lit(" AND "), c)).when(form == 1, F.concat(F.lit("( "), a, F.lit(" OR "), b, F.lit(") and "), c)).when(form == 2, F.concat(F.lit("(("), a, F.lit(" And "), b, F.lit(")) OR "), c)).otherwise(F.concat(a, F.lit(" AND ("), b, F.lit(" OR "), c, F.lit(")")))
    ok = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.array(F.lit("MIT"), F.lit("ISC"))).otherwise(F.array(F.lit("Apache-2.0"), F.lit("Zlib"), F.lit("BSD-3-Clause")))
    df = spdx.parse_column(table(spark, sf_dir, "part").select("p_partkey", text.alias("e"), ok.alias("ok")), "e", "p")
    return df.select("p_partkey", spdx.satisfies(F.col("p"), F.col("ok")).alias("satisfied"), F.array_join(spdx.operands(F.col("p")), "|").alias("names"), spdx.render(F.col("p")).alias("rendered"))


_FAMILY, _SUFFIX = ("GPL", "LGPL", "AGPL", "MPL", "CC-BY", "OLDAP"), ("", "-only", "-or-later", "+")


@query(f"""with i as (select p_partkey, {_sql_pick(_FAMILY, 'p_partkey % 6')} as f, '-' || (1 + p_size % 3) || '.0' as v, {_sql_pick(_SUFFIX, '(p_partkey // 6) % 4')} as s, case when (p_partkey // 24) % 3 = 0 then ' WITH Some-exception-2.0' else '' end as w from part)
select p_partkey, f as family, f || v || case when s = '+' then '+' else '' end || w as bare, false as reference, 'LicenseRef-' || f || v || s || w as as_reference from i""")
def identifier_forms(spark, sf_dir):
    w = F.when(_mod("p_partkey", 3, 24) == 0, " WITH Some-exception-2.0").otherwise("")
    i = F.concat(_pick(_FAMILY, _mod("p_partkey", 6)), F.lit("-"), (1 + F.pmod("p_size", F.lit(3))).cast("string"), F.lit(".0"), _pick(_SUFFIX, _mod("p_partkey", 4, 6)), w)
    return table(spark, sf_dir, "part").select("p_partkey", spdx.family(i).alias("family"), spdx.without_grant(i).alias("bare"), spdx.is_ref(i).alias("reference"), spdx.ref(F.concat(F.lit("\t"), i)).alias("as_reference"))


_OLD = ("GPL-2.0", "GPL-2.0-only", "LGPL-3.0", "MIT", "AGPL-3.0", "Apache-2.0", "GPL-3.0-or-later")
_HOSTS = ("https://www.apache.org/", "http://apache.org/", " HTTPS://WWW.Apache.org/", "apache.org/")
_TAILS = ("", ".txt", ".html", "/")


@query(f"""select p_partkey, {_sql_pick(('Apache-2.0', 'Apache-2.0', None), 'p_partkey % 3')} as id, {_sql_pick(_OLD, 'p_partkey % 7')} in ('GPL-2.0', 'LGPL-3.0', 'AGPL-3.0') as deprecated,
{_sql_pick(_OLD, 'p_partkey % 7')} as name, case when p_partkey % 7 in (0, 2, 4) then null else {_sql_pick(_OLD, 'p_partkey % 7')} end as resolved, case when p_partkey % 7 in (0, 2, 4) then {_sql_pick(_OLD, 'p_partkey % 7')} || '-only' end as only_form from part""")
def name_resolution(spark, sf_dir):
    """Addresses of one licence as people write them, names in any case, names of families that resolve to nothing."""
    k = _mod("p_partkey", 3)
    address = F.concat(_pick(_HOSTS, _mod("p_partkey", 4, 3)), F.lit("licenses/LICENSE-2.0"), _pick(_TAILS, _mod("p_partkey", 4, 12)))
    said = F.when(k == 0, address).when(k == 1, F.concat(F.lit("Apache License,  Version 2.0 "), F.lit("\t"))).otherwise("Terms of the house")
    name = _pick(_OLD, _mod("p_partkey", 7))
    df = table(spark, sf_dir, "part").select("p_partkey", spdx.from_text(said).alias("id"), spdx.is_deprecated(F.concat(F.lit(" "), F.lower(name))).alias("deprecated"), name.alias("name"), spdx.normalize(F.concat(name, F.lit("\n"))).alias("r"))
    return df.select("p_partkey", "id", "deprecated", "name", F.col("r.id").alias("resolved"), F.col("r.only").alias("only_form"))


# Manifests: each part is a component with one manifest of its own kind.
@query(f"""with k as (select 'p' || p_partkey as component_id, p_partkey % 7 as k, {_sql_pick(_NAMES, '(p_partkey // 7) % 5')} as a, {_sql_pick(_NAMES, '(p_partkey // 35) % 5')} as b from part)
select component_id, ['package.json', 'package.json', 'Cargo.toml', 'pyproject.toml', 'setup.cfg', 'METADATA', 'pom.xml'][k + 1] as path, ['npm', 'npm', 'cargo', 'pypi', 'pypi', 'pypi', 'maven'][k + 1] as ecosystem,
  case when k = 1 or k = 6 then a || ' OR ' || b else a end as license, '' as license_file from k""")
def manifests_of_parts(spark, sf_dir):
    return manifests.manifests(_part_manifests(spark, sf_dir))


def _part_manifests(spark, sf_dir) -> DataFrame:
    k, a, b = _mod("p_partkey", 7), _pick(_NAMES, _mod("p_partkey", 5, 7)), _pick(_NAMES, _mod("p_partkey", 5, 35))
    shapes = (
        ("package.json", F.format_string('{"name": "x", "license": "%s"}', a)), ("package.json", F.format_string('{"licenses": [{"type": "%s"}, {"type": "%s"}]}', a, b)), ("Cargo.toml", F.format_string('[package]\nname = "x"\nlicense = "%s"\n', a)),
        ("pyproject.toml", F.format_string("[project]\nlicense = {text = '%s'}\n", a)), ("setup.cfg", F.format_string("[metadata]\nname = x\nlicense =\n    %s\n", a)), ("METADATA", F.format_string("Name: x\nLicense: other\nLicense-Expression: %s\n\nLicense: body\n", a)),
        ("pom.xml", F.format_string("<project><licenses><license><name>%s</name></license><license><name> </name><url>%s</url></license></licenses></project>", a, b)),
    )
    path, content = (F.coalesce(*(F.when(k == i, F.lit(s[j]) if j == 0 else s[j]) for i, s in enumerate(shapes))) for j in (0, 1))
    return files_of(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("component_id"), path.alias("path"), content.alias("content")))


@query(f"""with k as (select p_brand as component_id, p_partkey, {_sql_pick(_NAMES, 'p_partkey % 5')} as a from part), m as (select component_id, arg_min(a, p_partkey) as a, min(p_partkey) as k from k group by 1)
select component_id, 'maven' as ecosystem, case when k % 2 = 0 then a else 'Parent-' || a end as license from m union all select component_id, 'pypi', a from m""")
def declared_by_ecosystem(spark, sf_dir):
    """A POM that may declare nothing with two parents, the nearer of which does; two Python manifests that agree."""
    first = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("component_id")).agg(F.min("p_partkey").alias("k")).withColumn("a", _pick(_NAMES, _mod("k", 5)))
    pom = lambda name: F.concat(F.lit("<project><licenses><license><name>"), name, F.lit("</name></license></licenses></project>"))
    a = F.col("a")
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"))
    rows = F.array(
        file("pom.xml", F.when(F.pmod("k", F.lit(2)) == 0, pom(a)).otherwise("<project/>")), file("pom-parent-1.xml", pom(F.concat(F.lit("Parent-"), a))), file("pom-parent-2.xml", pom(F.lit("Far"))),
        file("PKG-INFO", F.concat(F.lit("License: "), a, F.lit("\n"))), file("setup.cfg", F.concat(F.lit("license = "), a)),
    )
    return manifests.declared_terms(manifests.manifests(files_of(first.select("component_id", F.explode(rows).alias("r")).select("component_id", "r.*"))))


# Lockfiles: each brand's parts are the dependencies of one component, in one of four kinds of lockfile.
@query("""with p as (select p_brand as component_id, p_partkey as k, cast(substr(sha256(p_brand), 1, 1) in ('0', '1', '2', '3') as int) + 2 * cast(substr(sha256(p_brand), 2, 1) in ('0', '1', '2', '3', '4', '5', '6', '7') as int) as kind from part)
select component_id, case kind when 0 then 'pkg:golang/a.org/m' || k || '@v1.0.' || k when 1 then 'pkg:cargo/c' || k || '@1.0.' || k when 2 then 'pkg:npm/@s/n' || k || '@2.0.' || k else 'pkg:golang/a.org/m' || k || '@v1.0.' || k end as purl,
  case when kind in (0, 3) then 'h1:d' || k || '=' when kind = 1 then sha256(cast(k as varchar)) else 'sha512-' || k end as digest, case kind when 0 then 'go.sum' when 1 then 'Cargo.lock' when 2 then 'package-lock.json' else 'vendor/modules.txt' end as discovered_from
from p where not (kind = 1 and k % 5 = 0) and not (kind = 2 and k % 4 = 0)""")
def lockfiles_of_brands(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    brand = F.sha2("p_brand", 256)
    kind = F.substring(brand, 1, 1).isin(*"0123").cast("int") + 2 * F.substring(brand, 2, 1).isin(*"01234567").cast("int")
    lines = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("component_id"), kind.alias("kind"),
        F.format_string("a.org/m%s v1.0.%s h1:d%s=\na.org/m%s v1.0.%s/go.mod h1:other=\n", k, k, k, k, k).alias("sums"), F.format_string("# a.org/m%s v1.0.%s\n## explicit\na.org/m%s\n", k, k, k).alias("listed"),
        F.concat(F.format_string('[[package]]\nname = "c%s"\nversion = "1.0.%s"\n', k, k), F.when(F.pmod("p_partkey", F.lit(5)) == 0, "\n").otherwise(F.format_string('source = "registry+https://r"\nchecksum = "%s"\n\n', F.sha2(k, 256)))).alias("cargo"),
        F.format_string('"node_modules/@s/n%s": {"version": "2.0.%s", "resolved": "https://r.org/%s.tgz", "integrity": "sha512-%s"%s}', k, k, k, k, F.when(F.pmod("p_partkey", F.lit(4)) == 0, ', "dev": true').otherwise("")).alias("npm"),
    )
    whole = lines.groupBy("component_id", "kind").agg(*(F.array_join(F.array_sort(F.collect_list(c)), ", " if c == "npm" else "").alias(c) for c in ("sums", "listed", "cargo", "npm")))
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"))
    go = (file("go.mod", F.lit("module a.org/x\n")), file("go.sum", F.col("sums")))
    held = F.when(F.col("kind") == 0, F.array(*go)).when(F.col("kind") == 1, F.array(file("Cargo.lock", F.col("cargo")))).when(F.col("kind") == 2, F.array(file("package-lock.json", F.concat(F.lit('{"packages": {'), F.col("npm"), F.lit("}}"))))).otherwise(F.array(*go, file("vendor/modules.txt", F.col("listed"))))
    found = components.finalize(components.enumerate_source(files_of(whole.select("component_id", F.explode(held).alias("f")).select("component_id", "f.*"))))
    return found.select("component_id", "purl", "digest", "discovered_from")


# Archives: packed by the standard library, row by row, to be read by the engine.
def _zipped(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in members:
            z.writestr(zipfile.ZipInfo(n), c)
    return out.getvalue()


def _tarred(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n, c in members:
            i = tarfile.TarInfo(n)
            i.size = len(c)
            t.addfile(i, io.BytesIO(c))
    return out.getvalue()


def _documents_packed(batches):
    """(component_id, name, content, prefix): a document and its surroundings as an archive; each eleventh one is cut short."""
    for b in batches:
        rows = []
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            members = [(f"x-{k}/LICENSE", (text or "").encode()), (f"x-{k}/src/main.c", b"int x;"), (f"x-{k}/docs/README.md", b"read me"), ("../up/LICENSE", b"no"), ("elsewhere/COPYING", b"another root")]
            name, body = (f"x-{k}.zip", _zipped(members)) if k % 3 == 0 else (f"x-{k}.tar.gz" if k % 3 == 1 else f"x-{k}.crate", _tarred(members))
            rows.append((str(k), name, body[: len(body) // 2] if k % 11 == 0 else body, f"x-{k}"))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary(), pa.string()))], ["component_id", "name", "content", "prefix"])


@query("""select cast(doc_id as varchar) as component_id, 'LICENSE' as path, strlen(coalesce(text, '')) as size_bytes, sha256(coalesce(text, '')) as digest, false as failed from documents where doc_id % 11 <> 0
union all select cast(doc_id as varchar), 'docs/README.md', 7, sha256('read me'), false from documents where doc_id % 11 <> 0
union all select cast(doc_id as varchar), 'x-' || doc_id || ['.zip', '.tar.gz', '.crate'][1 + cast(doc_id % 3 as int)], 0, null, true from documents where doc_id % 11 = 0""")
def archive_members(spark, sf_dir):
    packed = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_documents_packed, "component_id string, name string, content binary, prefix string")
    return archives.expand_all(packed).select("component_id", "path", "size_bytes", F.sha2("content", 256).alias("digest"), F.col("read_error").isNotNull().alias("failed"))


def _jars(batches):
    for b in batches:
        rows = []
        for k, brand in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            one = lambda a: (f"META-INF/maven/org.p/{a}/pom.properties", f"#made\ngroupId=org.p\nartifactId = {a}\nversion=1.{k}\n".encode())
            rows.append((brand, f"usr/share/j{k}.{'JAR' if k % 2 else 'jar'}", b"no jar" if k % 13 == 0 else _zipped([one(f"a{k}"), ("x.class", b""), *([one(f"shaded{k}")] if k % 5 == 0 else [])])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], ["component_id", "path", "content"])


@query("""select p_brand as component_id, 'pkg:maven/org.p/a' || p_partkey || '@1.' || p_partkey as purl, 'usr/share/j' || p_partkey || case when p_partkey % 2 = 1 then '.JAR' else '.jar' end as discovered_from from part where p_partkey % 13 <> 0
union all select p_brand, 'pkg:maven/org.p/shaded' || p_partkey || '@1.' || p_partkey, 'usr/share/j' || p_partkey || case when p_partkey % 2 = 1 then '.JAR' else '.jar' end from part where p_partkey % 13 <> 0 and p_partkey % 5 = 0""")
def jar_components(spark, sf_dir):
    jars = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").mapInArrow(_jars, "component_id string, path string, content binary")
    return components.finalize(components.enumerate_java(files_of(jars))).select("component_id", "purl", "discovered_from")


_KINDS = ("golang", "cargo", "pypi", "maven", "npm", "gem")


def _staged(batches):
    """One artifact a part, by turns of the six ecosystems, with a digest of our own making: right, wrong or absent."""
    for b in batches:
        rows = []
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            eco, name, version, body = _KINDS[k % 6], f"n{k}", "1.0", text.encode()
            inside = (f"n{k}@1.0/", f"n{k}-1.0/", f"N_{k}-1.0/" if k % 4 == 0 else "", "META-INF/", "package/", "")[k % 6]
            members = [(inside + "LICENSE", body), (inside + "main.x", b"code")]
            file = ("1.0.zip", f"n{k}-1.0.crate", f"N_{k}-1.0.tar.gz" if k % 4 == 0 else f"n{k}.whl", f"n{k}-1.0.jar", f"n{k}-1.0.tgz", "x.gem")[k % 6]
            packed = _tarred(members) if file.endswith((".crate", ".tar.gz", ".tgz")) else _zipped(members)
            lines = "".join(f"{hashlib.sha256(c).hexdigest()}  {n}\n" for n, c in sorted(members))
            sri = ("sha512", "sha1", "sha256")[k % 3]
            digest = (
                "h1:" + base64.b64encode(hashlib.sha256(lines.encode()).digest()).decode(), hashlib.sha256(packed).hexdigest(), hashlib.sha256(packed).hexdigest(), hashlib.sha1(packed).hexdigest().upper(),
                f"{sri}-" + base64.b64encode(hashlib.new(sri, packed).digest()).decode(), "",
            )[k % 6]
            recorded = digest if (k // 6) % 3 == 0 else "" if (k // 6) % 3 == 1 else digest[:-2]
            rows.append((f"pkg:{eco}/n{k}", eco, name, version if k % 17 else "", recorded, file, packed))
        if rows:
            types = (*[pa.string()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["purl", "ecosystem", "name", "version", "recorded", "file_name", "content"])


def _staged_parts(spark, sf_dir) -> DataFrame:
    return _spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").mapInArrow(_staged, "purl string, ecosystem string, name string, version string, recorded string, file_name string, content binary")


@query(f"""with k as (select p_partkey as k, {_sql_pick(_KINDS, 'p_partkey % 6')} as ecosystem from part)
select 'pkg:' || ecosystem || '/n' || k as purl, ecosystem, case when k % 6 = 5 then null when k % 17 = 0 then null else ['h1', 'sha256', 'sha256', 'sha1', 'npm-integrity'][1 + cast(k % 6 as int)] end as digest_algo,
  k % 6 <> 5 and k % 17 <> 0 and (k // 6) % 3 = 0 as matched, case when k % 6 = 5 then 'no reader for gem' when k % 17 = 0 then 'a name and a version are needed' end as error from k""")
def staged_artifacts(spark, sf_dir):
    return published.artifacts(_staged_parts(spark, sf_dir)).select("purl", "ecosystem", "digest_algo", "matched", "error")


@query(f"""with k as (select p_partkey as k, p_name, {_sql_pick(_KINDS, 'p_partkey % 6')} as ecosystem from part), g as (select * from k where k % 6 <> 5 and k % 17 <> 0)
select 'pkg:' || ecosystem || '/n' || k as purl, case when k % 6 = 3 then 'META-INF/LICENSE' else 'LICENSE' end as path, 'sha256:' || sha256(p_name) as digest from g""")
def staged_files(spark, sf_dir):
    return published.published_files(_staged_parts(spark, sf_dir)).where("read_error is null").select(F.col("component_id").alias("purl"), "path", digests.file_digest(F.col("content")).alias("digest"))


@query(f"""with {_TREE}, l as (select component_id, 'pkg:cargo/' || component_id || '-m' || doc_id || '@1' as purl, path, text, doc_id from tree where path = 'vendor/m' || doc_id || '/LICENSE')
select component_id, purl, 'LICENSE' as path, {_DIGEST} as digest from l""")
def vendored_copies(spark, sf_dir):
    """Vendored roots of components that a lockfile names, and the files below each as the published ones name them."""
    files = tree(spark, sf_dir)
    return published.local_files(files, _vendored(files)).select("component_id", "purl", "path", "digest")


def _vendored(files: DataFrame) -> DataFrame:
    """Every document names a module; only those that the tree holds are copies."""
    name = F.concat(F.lit("m"), F.col("doc_id").cast("string"))
    named = files.select("component_id", F.concat(F.lit("pkg:cargo/"), "component_id", F.lit("-"), name, F.lit("@1")).alias("purl"), name.alias("name"), F.lit("vendor/").alias("vendor_root"))
    return ownership.vendored_roots(named, files)


def _crates(batches):
    for b in batches:
        rows = []
        for purl_, k, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            body = b"changed" if k % 9 == 0 else text
            rows.append((purl_, "cargo", f"m{k}", "1", "", f"m{k}-1.crate", _tarred([(f"m{k}-1/LICENSE", body)] if k % 4 else [(f"m{k}-1/README", b"r")])))
        if rows:
            types = (*[pa.string()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["purl", "ecosystem", "name", "version", "recorded", "file_name", "content"])


@query(f"""with {_TREE}, l as (select 'pkg:cargo/' || component_id || '-m' || doc_id || '@1' as purl, doc_id from tree where path = 'vendor/m' || doc_id || '/LICENSE')
select purl, case when doc_id % 4 = 0 or doc_id % 9 = 0 then 'diverged' else 'pristine' end as verdict, case when doc_id % 4 = 0 then 'nothing is published to compare with' when doc_id % 9 = 0 then 'LICENSE differs' else '' end as reason from l""")
def verified_copies(spark, sf_dir):
    """From the trees' copies and the staged crates to verdicts, contents read from the archives."""
    files = tree(spark, sf_dir)
    copies = files.where(F.col("path") == F.concat(F.lit("vendor/m"), F.col("doc_id").cast("string"), F.lit("/LICENSE")))
    address = F.concat(F.lit("pkg:cargo/"), "component_id", F.lit("-m"), F.col("doc_id").cast("string"), F.lit("@1"))
    crates = copies.select(address.alias("purl"), "doc_id", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(_crates, "purl string, ecosystem string, name string, version string, recorded string, file_name string, content binary")
    return published.verified_copies(files, _vendored(files), crates)


@query(f"""with {_FINE}, w as (select component_id, path, weight, text from pref where id is null and text <> ''), f as (select component_id, arg_min(text, (-weight, path)) as text, arg_min(path, (-weight, path)) as path from w group by 1)
select component_id, path, 'LicenseRef-v1-' || substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 16) as reference from f""")
def unrecognised_texts(spark, sf_dir):
    """The name of the first text, in discovery order, that nothing recognised."""
    files = _fine_files(spark, sf_dir)
    named = conclude.reference_of(files).withColumnRenamed("license_ref", "reference")
    return published.unrecognised_text(files).where("error is null").join(named, "component_id").select("component_id", "path", "reference")


_REPOSITORIES = ("https://code.org/s/", "http://code.org/s/", "git+https://code.org/s/", "ssh://code.org/s/", "git@code.org/s/", "")


@query("""select s_suppkey, case when s_suppkey % 6 = 5 then 'pkg:apk/' || s_name || '@1.' || s_nationkey else 'pkg:generic/code.org/s/' || s_suppkey || '@' || case when s_suppkey % 4 = 0 then 'c' || s_suppkey else '1.' || s_nationkey end end as purl,
case when s_suppkey % 3 = 0 then '' else 'sha256:' || sha256(strlen('a.patch') || ':a.patch' || strlen(s_name) || ':' || s_name) end as digest from supplier where not contains(case when s_suppkey % 6 = 5 then s_name else '' end, ' ')""")
def source_addresses(spark, sf_dir):
    """The component's own address, from its repository in any spelling, or its name; the digest of its patches."""
    k = F.col("s_suppkey").cast("string")
    base = _pick(_REPOSITORIES, _mod("s_suppkey", 6))
    repository = F.when(base == "", "").otherwise(F.concat(base, k, F.when(_mod("s_suppkey", 2, 6) == 0, ".git").otherwise("")))
    patches = F.when(_mod("s_suppkey", 3) == 0, F.array().cast("array<struct<path:string,digest:string>>")).otherwise(F.array(F.struct(F.lit("a.patch").alias("path"), F.col("s_name").alias("digest"))))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", k.alias("component_id"), F.col("s_name").alias("name"), F.concat(F.lit("1."), F.col("s_nationkey").cast("string")).alias("version"), repository.alias("repository"), F.when(_mod("s_suppkey", 4) == 0, F.concat(F.lit("c"), k)).otherwise("").alias("commit"), patches.alias("patches"))
    made = components.source_components(s).where(~F.contains("purl", F.lit(" ")))
    return made.select(F.col("component_id").cast("long").alias("s_suppkey"), "purl", "digest")


@query("select 'g' || p_partkey as gav, case when p_partkey % 12 <= 7 then 'L' || (p_partkey - p_partkey % 12) else '' end as license from part")
def pom_chains(spark, sf_dir):
    """Chains of up to twelve POMs, of which only the last declares: eight are followed."""
    k = F.col("p_partkey")
    top = F.pmod(k, F.lit(12)) == 0
    name = lambda n: F.concat(F.lit("g"), n.cast("string"))
    return staged.inherited_terms(table(spark, sf_dir, "part").select(name(k).alias("gav"), F.when(~top, name(k - 1)).alias("parent"), F.when(top, F.concat(F.lit("L"), k.cast("string"))).alias("license")))


@query("select page_id, page_id % 7 in (0, 6) as valid from pages")
def page_addresses(spark, sf_dir):
    k = F.col("page_id").cast("string")
    forms = ("https://h%s.example.net/a", "http://h%s.example.net/a", "https://u%s@example.net/a", "https://10.0.%s.1/a", "https://h%s.internal/a", "ftp://h%s.example.net/", "https://h%s.example.net:8443/a?b#c")
    url = F.coalesce(*(F.when(_mod("page_id", 7) == i, F.format_string(f, k)) for i, f in enumerate(forms)))
    return table(spark, sf_dir, "pages").select("page_id", staged.valid_url(url).alias("valid"))


@query("""select doc_id, 'sha256:' || sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) as digest, 'v1-' || sha256('7:LICENSE' || 71 || ':sha256:' || sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)))) as one_file,
'pkg:pypi/a-' || doc_id || '@1' as address, 'MIT|Zlib|OR' as postfix from documents""")
def sql_functions(spark, sf_dir):
    """The registered functions, called from SQL text."""
    registry.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("attestry_documents")
    return spark.sql("""select doc_id, att_file_digest(coalesce(text, '')) as digest, att_content_hash(array(named_struct('path', 'LICENSE', 'digest', att_file_digest(coalesce(text, ''))))) as one_file,
        att_purl_pypi(concat('A_.', doc_id), '1') as address, array_join(att_parse_expression(if(doc_id < 0, '', 'MIT or Zlib')), '|') as postfix from attestry_documents""")

