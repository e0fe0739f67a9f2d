"""The whole account of components over trees made of documents, with things planted that go wrong, and readers of broken files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import locks, manifests, ownership
from attestry.plans import evidence
from attestry.plans.formed import _mod, _pick, _spread, _sql_pick
from attestry.plans.queries import _DEPTH, _DIGEST, _FINE, _HASH, _MANIFEST, _PROSE, _TOK, _TREE, _excluded, _fine_files, _q, _weight, query, table, tree
from attestry.sources import maven, published, records, scratch
from attestry.sources.trees import TEMPLATES, document_trees, files_of

# A component is a source's documents in runs of 320. Its number decides what else its tree holds and what of it can't be read.
_COMPONENT = "source || '-' || cast(doc_id // 320 as varchar)"
_NUMBER = "(cast(substr(regexp_extract(component_id, 'src[0-9]+'), 4) as int) + cast(regexp_extract(component_id, '[0-9]+$') as int))"
_BROKEN = b'[package]\nname = "x"\n'
_FLAT = b'{"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1", "resolved": "https://r.org/a.tgz"}, "node_modules/b": {"version": "1", "resolved": "https://r.org/b.tgz", "dev": true}}}'
_LATIN = '{"packages": {"node_modules/café": {"version": "1", "resolved": "https://r.org/c.tgz"}}}'.encode("latin-1")


def _number() -> Column:
    return F.regexp_extract("component_id", "src([0-9]+)", 1).cast("int") + F.regexp_extract("component_id", "([0-9]+)$", 1).cast("int")


def _trees(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(subjects, files, corpus, installed): every fifth document ends with a passage."""
    passages = table(spark, sf_dir, "benchmark")
    n = passages.count()
    docs = table(spark, sf_dir, "documents")
    ends = docs.where(F.pmod("doc_id", F.lit(5)) == 0).withColumn("item_id", F.pmod(F.floor(F.col("doc_id") / 5), F.lit(n))).join(passages.withColumnRenamed("text", "passage"), "item_id").select("doc_id", "passage")
    given = docs.join(ends, "doc_id", "left").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit("\n"), "passage"), F.lit("")))).drop("passage")
    files = document_trees(given).withColumn("component_id", F.concat("component_id", F.lit("-"), F.floor(F.col("doc_id") / 320).cast("string")))
    whole = files.groupBy("component_id").agg(F.array_sort(F.collect_list(F.when(F.col("path") == F.concat(F.lit("vendor/m"), F.col("doc_id").cast("string"), F.lit("/LICENSE")), F.concat(F.lit("# m"), F.col("doc_id").cast("string"), F.lit(" v1\n"))))).alias("listed"))
    k = F.pmod(_number(), F.lit(6))
    file = lambda path, content, error=None: F.struct(F.lit(path).alias("path"), content.alias("content"), F.lit(error).cast("string").alias("read_error"))
    none = F.lit(None).cast("binary")
    planted = (
        F.when(k == 0, F.array(file("Cargo.lock", F.lit(_BROKEN)))).when(k == 1, F.array(file("package-lock.json", F.lit(_FLAT)), file("package.json", F.lit(b'{"license": "MIT"}')))).when(k == 2, F.array(file("LICENSE-lost", none, "denied")))
        .when(k == 3, F.array(file("sealed/", none, "denied"))).when(k == 4, F.array(file("package-lock.json", F.lit(_LATIN))))
        .otherwise(F.array(file("go.mod", F.lit(b"module x\n")), file("vendor/modules.txt", F.array_join("listed", "").cast("binary"))))
    )
    extra = whole.select("component_id", F.explode(planted).alias("f")).select("component_id", "f.*").withColumn("size_bytes", F.coalesce(F.octet_length("content").cast("bigint"), F.lit(0).cast("bigint")))
    every = files.drop("doc_id").unionByName(extra)
    known = whole.select("component_id", F.when(F.pmod(_number(), F.lit(3)) == 0, "the image is gone").alias("installed_error"), F.lit(None).cast("string").alias("source_error"))
    lost = spark.createDataFrame([("gone", None, "no such tree")], "component_id string, installed_error string, source_error string")
    installed = whole.where(F.pmod(_number(), F.lit(3)) == 1).select("component_id", F.lit("lib/one-1.dist-info/METADATA").alias("path"), F.lit(b"Name: one\nVersion: 1\n").alias("content"))
    corpus = passages.select(F.concat(F.lit("passage-"), F.col("item_id").cast("string")).alias("id"), "text")
    return known.unionByName(lost), every, corpus, files_of(installed)


_NORMAL = f"' ' || array_to_string({_TOK}, ' ') || ' '"
_NO_TREES = "no-installed-trees: no installed tree supplied; pypi, maven components were not enumerated"


@query(f"""with n as (select count(*) as n from benchmark), d0 as (select doc_id, source, coalesce(text, '') || case when doc_id % 5 = 0 then chr(10) || (select any_value(b.text) from benchmark b where b.item_id = (doc_id // 5) % n) else '' end as text from documents, n),
tree as (select {_COMPONENT} as component_id, doc_id, text, replace([{', '.join(map(_q, TEMPLATES))}][1 + cast((doc_id // 20) % {len(TEMPLATES)} as int)], '{{}}', cast(doc_id as varchar)) as path, null as err from d0),
c as (select component_id, k % 6 as k, k % 3 as i, vendored from (select component_id, any_value({_NUMBER}) as k, count(*) filter (where path = 'vendor/m' || doc_id || '/LICENSE') as vendored from tree group by 1)),
lost as (select component_id, -1 as doc_id, '' as text, 'LICENSE-lost' as path, 'denied' as err from c where k = 2),
found as (select *, {_weight()} + case when {_DEPTH} = 0 then 0.5 else 0 end as weight, {_excluded()} as excluded, {_DIGEST} as digest from (select * from tree union all select * from lost) where ({_weight()}) is not null),
p as (select 'passage-' || item_id as id, {_NORMAL} as t from benchmark), x as (select *, {_NORMAL} as t from found where excluded = '' and err is null),
m as (select component_id as mc, path as mp, list_sort(list(distinct id)) as ids from x join p on contains(x.t, p.t) group by 1, 2),
scoped as (select f.*, coalesce(ids, []) as ids, {_DEPTH} = 0 as root, max(case when {_DEPTH} = 0 then 1 else 0 end) over (partition by f.component_id) as any_root from found f left join m on mc = f.component_id and mp = f.path where excluded = ''),
pref as (select * from scoped where (root or any_root = 0) and err is null),
a as (select component_id, list_sort(list_distinct(flatten(list(ids)))) as ids, bool_or(len(ids) = 0 and text <> '') as open, arg_min('LicenseRef-v1-' || substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 16), (-weight, path)) filter (where len(ids) = 0 and text <> '') as ref from pref group by 1),
s as (select component_id, count(*) as total, count(*) filter (where err is null) as readable, count(*) filter (where len(ids) > 0) as resolved, list_sort(list_distinct(flatten(list(ids)))) as detected from scoped group by 1),
h as (select component_id, {_HASH} as h from found where err is null and excluded not in ('vendored', 'build-output', 'test-fixture') group by 1),
j as (select c.*, coalesce(a.ids, []) as ids, coalesce(open, false) as open, coalesce(ref, '') as ref, coalesce(total, 0) as total, coalesce(readable, 0) as readable, coalesce(resolved, 0) as resolved, coalesce(detected, []) as detected, coalesce(h, 'v1-' || sha256('')) as h
  from c left join a using (component_id) left join s using (component_id) left join h using (component_id)),
t as (select *, readable = 0 and k <> 1 as unknown, case when len(detected) > 0 then 1.0 when k = 1 then 0.8 else 0.0 end as project, case when total = 0 then 1.0 else resolved / total end as resolution, case when len(detected) < 2 then 1.0 else 0.0 end as relation from j)
select component_id, h as terms_content_hash, case when len(ids) = 1 then ids[1] else '' end as expression, case when len(ids) = 0 and open then 'unrecognized-license-text' when len(ids) = 0 then 'no-license-text' when len(ids) > 1 then 'several-licenses' else '' end as reason,
  array_to_string(ids, ',') as identifiers, '' as grant_basis, ref as license_ref, case when unknown and i <> 1 or unknown and k in (0, 2, 3) then 0.0 else round(project * resolution * relation, 9) end as score,
  case when unknown and (i <> 1 or k in (0, 2, 3)) then '' else array_to_string(list_filter([case when k = 1 and len(detected) > 0 then 'declared-conflict' end, case when relation = 0 then 'relationship-ambiguous' end, case when resolved < total then 'unidentified-text' end], lambda f: f is not null), ',') end as flags,
  unknown and (i <> 1 or k in (0, 2, 3)) as unknown, total as license_files,
  array_to_string(list_filter([case when k = 3 then 'unreadable-tree: sealed: could not be read' end, case i when 0 then 'installed: the image is gone' when 2 then '{_NO_TREES}' end,
    case when k = 0 then 'dependencies: cargo: Cargo.lock: doesn''t parse: package is of another kind' end, case when k = 2 then 'license-file: LICENSE-lost: denied' end], lambda g: g is not null), '|') as gaps,
  cast(case k when 1 then 1 when 4 then 1 when 5 then vendored else 0 end + case when i = 1 then 1 else 0 end as bigint) as parts, case when k = 5 then vendored else 0 end as copies from t
union all select 'gone', 'v1-' || sha256(''), '', 'no-license-text', '', '', '', 0.0, '', true, 0, 'source: no such tree|{_NO_TREES}', 0, 0""")
def collect_evidence(spark, sf_dir):
    """The flagship: the evidence of every component, with all kinds of gap."""
    out = evidence.collect(*_trees(spark, sf_dir))
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat(g["kind"], F.lit(": "), g["detail"])), "|")
    counts = (F.size("parts").cast("long").alias("parts"), F.size("vendored_copies").cast("long").alias("copies"))
    return out.select(
        "component_id", "terms_content_hash", "expression", "reason", F.array_join("identifiers", ",").alias("identifiers"), "grant_basis", "license_ref", F.round("score", 9).alias("score"), "flags", "unknown", "license_files", gaps.alias("gaps"), *counts
    )


@query()
def bundle_digest(spark, sf_dir):
    return evidence.bundles(evidence.collect(*_trees(spark, sf_dir))).select("component_id", "bundle_digest")


# Lockfiles of other shapes than their formats: (file, content, what is wrong or None, packages).
_DEEP = b'{"dependencies": ' + b'{"a": {"dependencies": ' * 3000 + b"{}" + b"}}" * 3000 + b"}"
_LOCKS = (
    ("Cargo.lock", b'[[package]]\nname = "a"\nversion = "1"\nsource = "r"\n', None, 1), ("Cargo.lock", b'[package]\nname = "a"\n', "package is of another kind", 0), ("Cargo.lock", b"package = 5\n", "package is of another kind", 0), ("Cargo.lock", b'package = ["a"]\n', "a package is of another kind", 0),
    ("Cargo.lock", b"[[package]]\nname = 1\n", "name is of another kind", 0), ("Cargo.lock", b"a = " + b"[" * 3000 + b"]" * 3000, "it is nested too deeply", 0), ("Cargo.lock", b'[[package]]\nname = "caf\xe9"\n', None, None),
    ("package-lock.json", b'{"packages": []}', "packages is of another kind", 0), ("package-lock.json", b'{"dependencies": []}', "dependencies is of another kind", 0), ("package-lock.json", b'{"packages": {"node_modules/a": {"name": ["x"]}}}', "name is of another kind", 0),
    ("package-lock.json", b'{"packages": {"node_modules/a": {"version": 1}}}', "version is of another kind", 0), ("package-lock.json", b'{"packages": {"node_modules/a": {"dev": "yes"}}}', "dev is of another kind", 0), ("package-lock.json", _DEEP, None, 0), ("package-lock.json", b"[" * 30_000 + b"]" * 30_000, "it is nested too deeply", 0),
    ("package-lock.json", b'{"packages": {"node_modules/a": 3}}', "the entry of node_modules/a is of another kind", 0), ("package-lock.json", b"null", None, 0), ("package-lock.json", b'{"packages": {"node_modules/caf\xe9": {"version": "1", "resolved": "https://r.org/c.tgz"}, "node_modules/n": null}}', None, 1),
)
#: Of these the reason is the decoder's own wording or depends on its depth: only that there is one is compared.
_FAILS = tuple(i for i, x in enumerate(_LOCKS) if x[3] is None)
_DETAIL = tuple(None if x[2] is None else f"{'cargo' if x[0].startswith('C') else 'npm'}: {x[0]}: doesn't parse: {x[2]}" for x in _LOCKS)


@query(f"""with k as (select p_partkey, cast(p_partkey % {len(_LOCKS)} as int) as k from part)
select p_partkey, {'case k ' + ' '.join(f'when {i} then {_q(d)}' for i, d in enumerate(_DETAIL)) + ' end'} as detail, k in ({', '.join(map(str, (i for i, x in enumerate(_LOCKS) if x[2] or i in _FAILS)))}) as failed,
  cast({'case k ' + ' '.join(f'when {i} then {x[3] or 0}' for i, x in enumerate(_LOCKS)) + ' end'} as bigint) as packages from k""")
def broken_lockfiles(spark, sf_dir):
    """One lockfile a part, most of them not what their format says: each is read, or is a failure of its own."""
    k = _mod("p_partkey", len(_LOCKS))
    path, content = (_pick(tuple(x[i] for x in _LOCKS), k) for i in (0, 1))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("component_id"), path.alias("path"), content.alias("content"))
    read = locks.stream(files_of(part.drop("p_partkey")))
    each = read.groupBy("component_id").agg(F.max("failure").alias("f"), F.max("path").alias("path"), F.max("kind").alias("kind"), F.max(F.size(F.coalesce("entries", F.array().cast(f"array<{locks.ENTRY}>")))).alias("packages"))
    known = ~F.pmod(F.col("component_id").cast("long"), F.lit(len(_LOCKS))).isin(*_FAILS)
    return each.select(F.col("component_id").cast("long").alias("p_partkey"), F.when(known, F.concat(locks._ecosystem(F.col("kind")), F.lit(": "), "path", F.lit(": "), "f")).alias("detail"), F.col("f").isNotNull().alias("failed"), F.col("packages").cast("long").alias("packages"))


_TOMLS = (
    ("Cargo.toml", b'[package]\nlicense = "MIT"\n', "MIT"), ("Cargo.toml", b'package = ["x"]\n', ""), ("Cargo.toml", b'[package]\nlicense = 3\n', ""), ("Cargo.toml", b'[package]\nlicense = "caf\xe9"\n', ""), ("Cargo.toml", b"a = " + b"[" * 3000 + b"]" * 3000, ""),
    ("pyproject.toml", b'project = 1\ntool = 2\n', ""), ("pyproject.toml", b'[project.license]\ntext = ["MIT"]\n[tool.poetry]\nlicense = "ISC"\n', "ISC"), ("pyproject.toml", b"\xff\xfe", ""), ("setup.cfg", b"[metadata]\nlicense = caf\xe9\n", "caf�"),
    ("package.json", b'{"license": "caf\xe9"}', "caf�"), ("package.json", b'{"license": ["MIT", 3]}', ""), ("package.json", b'{"license": {"type": 5}}', None), ("METADATA", b"License: MIT\r\nName: caf\xe9\r\n\r\n", "MIT"), ("pom.xml", b"<project><licenses><license><name>MIT</name>", None),
)


@query(f"""select p_partkey, {_q(_TOMLS[0][0])} as path, 'MIT' as license from part where p_partkey % {len(_TOMLS)} = 0
union all {' union all '.join(f"select p_partkey, {_q(p)}, {_q(x)} from part where p_partkey % {len(_TOMLS)} = {i}" for i, (p, _, x) in enumerate(_TOMLS) if i and x is not None)}""")
def broken_manifests(spark, sf_dir):
    """One manifest a part, most of them not what their format says; what can't be read declares nothing. Two kinds have no defined answer and are only read."""
    k = _mod("p_partkey", len(_TOMLS))
    path, content = (_pick(tuple(x[i] for x in _TOMLS), k) for i in (0, 1))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("component_id"), path.alias("path"), content.alias("content"))
    said = manifests.manifests(files_of(part)).select(F.col("component_id").cast("long").alias("p_partkey"), "path", "license")
    return said.where(~F.pmod("p_partkey", F.lit(len(_TOMLS))).isin(*(i for i, x in enumerate(_TOMLS) if x[2] is None)))


# POMs: each part is one of a chain of up to twelve, of which only the first declares; some are missing, some name themselves, every fourth has no jar.
def _maven(batches):
    import pyarrow as pa

    from attestry.plans.formed import _zipped

    for b in batches:
        rows = []
        for k in b.column(0).to_pylist():
            parent = k if k % 100 == 7 else k - 1
            group, version = ("<groupId>org.p</groupId>", "<version>1.0</version>") if k % 2 else ("<groupId> </groupId>", "")
            up = "" if k % 12 == 0 else f"<parent>{group}<artifactId>a{parent}</artifactId>{version}</parent>"
            said = f"<licenses><license><name>L{k}</name></license></licenses>" if k % 12 == 0 else "<licenses><license><name> </name></license></licenses>"
            jar = None if k % 4 == 0 else _zipped([("META-INF/LICENSE", b"terms"), ("pom.xml", b"<project/>"), ("x.class", b"")])
            rows.append((k, None if k % 17 == 5 else (b"<project>" if k % 29 == 3 else f"<project>{up}{said}</project>".encode()), jar, hashlib.sha1(jar).hexdigest().upper() + "  x.jar" if jar and k % 3 else "0"))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.string()))], ["k", "pom", "jar", "recorded"])


@query(f"""with recursive p as (select p_partkey as k, p_partkey % 12 = 0 and p_partkey % 29 <> 3 as declares, case when p_partkey % 12 = 0 or p_partkey % 29 = 3 then null when p_partkey % 100 = 7 then p_partkey else p_partkey - 1 end as up from part where p_partkey % 17 <> 5),
c as (select k, k as at, 1 as n from p union all select c.k, u.k, n + 1 from c join p a on a.k = c.at and not a.declares and a.up <> c.at join p u on u.k = a.up where n < 8),
l as (select c.k, max(n) as n, max(case when p.declares then 'L' || p.k end) as license from c join p on p.k = c.at group by 1),
a as (select p_partkey as k, p_partkey % 4 <> 0 as jar, p_partkey % 11 = 0 as bad from part)
select 'pkg:maven/org.p/a' || a.k || '@1.0' as purl, case when bad then 0 else coalesce(n, 0) end as poms, case when jar and not bad then 1 else 0 end as members, case when not bad then license end as license, jar and not bad and a.k % 3 <> 0 as matched,
  case when bad then '' when jar and n is null then {_q(maven.NO_POM)} when not jar and n is not null then {_q(maven.NO_JAR)} else '' end as notes,
  case when bad then 'group, artifact and version are needed' when not jar and n is null then 'gone: there is neither a POM nor a jar' end as error from a left join l on l.k = a.k""")
def maven_resolution(spark, sf_dir):
    """Components from their POM chains and jars: whatever of the two is there, with a note where one isn't."""
    made = scratch.materialise(_spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").mapInArrow(_maven, "k long, pom binary, jar binary, recorded string"), "made")
    artifact = F.concat(F.lit("a"), F.col("k").cast("string"))
    poms = made.where("pom is not null").select(F.lit("org.p").alias("group_id"), artifact.alias("artifact_id"), F.lit("1.0").alias("version"), F.col("pom").alias("content"))
    name = F.when(F.pmod("k", F.lit(11)) == 0, artifact).otherwise(F.concat(F.lit("org.p:"), artifact))
    staged = made.select(F.concat(F.lit("pkg:maven/org.p/"), artifact, F.lit("@1.0")).alias("purl"), F.lit("maven").alias("ecosystem"), name.alias("name"), F.lit("1.0").alias("version"), "recorded", F.lit("x.jar").alias("file_name"), F.col("jar").alias("content"))
    artifacts, files = maven.resolve(staged, poms)
    files = scratch.materialise(files, "maven-files")
    pom = F.col("path").rlike("^pom")
    held = files.groupBy(F.col("component_id").alias("purl")).agg(F.count_if(pom).alias("poms"), F.count_if(~pom).alias("members"))
    declared = manifests.declared_terms(manifests.manifests(files)).select(F.col("component_id").alias("purl"), "license")
    out = artifacts.join(held, "purl", "left").join(declared, "purl", "left")
    return out.select("purl", F.coalesce("poms", F.lit(0)).alias("poms"), F.coalesce("members", F.lit(0)).alias("members"), "license", "matched", F.array_join("notes", "|").alias("notes"), "error")


def _written(files: DataFrame, folder: str) -> None:
    """The files of a files table below folder/<component>, each by the task that has it."""
    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for component, path, content in zip(*(b.column(i) for i in range(3))):  # no more than one content outside of the batch
                at, content = f"{root}/{component}/{path}", content.as_py()
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at, compression=None) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    files.select("component_id", "path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


@query(f"""with {_TREE}, l as (select component_id, path, {_DIGEST} as digest from tree where ({_weight()}) is not null), h as (select component_id, {_HASH} as terms_content_hash, count(*) as covered from l group by 1),
c as (select component_id, count(*) as files, sum(strlen(text)) as bytes from tree group by 1)
select c.component_id, files, cast(bytes as bigint) as bytes, coalesce(terms_content_hash, 'v1-' || sha256('')) as terms_content_hash, coalesce(covered, 0) as covered, false as missing from c left join h using (component_id)
union all select 'no-' || component_id, 0, 0, 'v1-' || sha256(''), 0, true from c""")
def tree_directories(spark, sf_dir):
    """Trees written as directories and read back by the tree source; as many components are asked for that have none."""
    from uuid import uuid4

    from attestry.sources import tree_source

    files = tree(spark, sf_dir)
    folder = f"{scratch.folder(spark)}/trees-{uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    scratch.passing(spark, folder)
    _written(files, folder)
    names = [r["component_id"] for r in files.select("component_id").distinct().collect()]  # components, asked for by name
    # Read once, by one worker a task; three branches follow.
    read = scratch.materialise(tree_source.read_directories(spark, folder, names + [f"no-{n}" for n in names]), "read")
    subjects = tree_source.subjects_of(read)
    there = read.where("read_error is null")
    hashes = ownership.component_hashes(subjects, there).select("component_id", "terms_content_hash", F.col("files").alias("covered"))
    sizes = there.groupBy("component_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    out = subjects.join(hashes, "component_id").join(sizes, "component_id", "left")
    return out.select("component_id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "terms_content_hash", "covered", F.col("source_error").isNotNull().alias("missing"))


# A feed of three batches: of the documents of each, one in ten is removed and one in ten changed by a later batch; one in twenty that was removed comes back.
@query(f"""with {_TREE}, l as (select component_id, path, doc_id, doc_id % 3 as b, (doc_id // 3) % 20 as k, text from tree where ({_weight()}) is not null),
s as (select component_id, path, case when b < 2 and k in (1, 11) then 'changed ' || doc_id else text end as text from l where not (b < 2 and (k = 10 or k = 0 and b > 0))),
d as (select component_id, path, {_DIGEST} as digest from s), h as (select component_id, {_HASH} as h, count(*) as n from d group by 1)
select component_id, coalesce(h, 'v1-' || sha256('')) as terms_content_hash, coalesce(n, 0) as files from (select distinct component_id from l) left join h using (component_id)""")
def content_keys_by_change(spark, sf_dir):
    """Keys kept up by a stream of changes, whose last ones are those of the trees as they are in the end."""
    from uuid import uuid4

    from attestry.streaming import incremental

    base = f"{scratch.folder(spark)}/keys-{uuid4().hex}"
    scratch.passing(spark, base)
    batch, k = F.pmod("doc_id", F.lit(3)), F.pmod(F.floor(F.col("doc_id") / 3), F.lit(20))
    files = tree(spark, sf_dir).withColumns({"b": batch, "k": k, "removed": F.lit(False), "seq": batch})
    later = files.where("b < 2").withColumn("seq", F.col("b") + 1)
    gone = later.where("k in (0, 10)").withColumn("removed", F.lit(True))
    changed = later.where("k in (1, 11)").withColumn("content", F.concat(F.lit("changed "), F.col("doc_id").cast("string")).cast("binary"))
    # Removed by the second batch, there again with the third.
    back = files.where("b = 0 and k = 0").withColumn("seq", F.lit(2))
    feed = files.unionByName(gone).unionByName(changed).unionByName(back)
    changes = scratch.materialise(incremental.changes_of(feed), "changes")

    def keep(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/keys/batch={batch_id}")

    # All that has come is one batch, in however many files; the next run goes on from the checkpoint.
    for i in range(3):
        changes.where(F.col("seq") == i).write.mode("append").parquet(f"{base}/feed")
        arrivals = spark.readStream.schema(incremental.CHANGE).parquet(f"{base}/feed")
        stream = incremental.content_keys(arrivals).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    kept = spark.read.schema("component_id string, terms_content_hash string, files bigint, batch int").parquet(f"{base}/keys/batch=*")
    return kept.groupBy("component_id").agg(F.max_by(F.struct("terms_content_hash", "files"), "batch").alias("x")).select("component_id", "x.*")


# The canonical form over rows: what is absent, what is escaped, numbers whole and not.
@query(r"""with d as (select doc_id, coalesce(text, '') || chr(9) || '"q" \ ' || lang as text, lang, n_chars, doc_id % 4 as k from documents)
select doc_id, sha256('{"doc_id":' || doc_id || case when k > 0 then ',"lang":' || to_json(lang) else '' end || ',"share":' || case when n_chars % 7 = 0 then cast(n_chars // 7 as varchar) else cast(cast(n_chars as double) / 7 as varchar) end
  || ',"parts":[' || array_to_string(list_transform(range(k), lambda i: '{"i":' || i || ',"text":' || to_json(d.text) || '}'), ',') || ']' || case when k % 2 = 1 then ',"odd":true' else '' end || '}') as record_sha256 from d""")
def canonical_records(spark, sf_dir):
    from attestry.functions import canonical as j

    k = F.pmod("doc_id", F.lit(4))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", F.concat(F.coalesce("text", F.lit("")), F.lit('\t"q" \\ '), "lang").alias("t"), F.when(k > 0, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("parts"))
    whole = j.record(
        ("doc_id", j.integer(F.col("doc_id"))), ("lang", j.unless(k == 0, j.text(F.col("lang")))), ("share", j.number(F.col("n_chars").cast("double") / 7)),
        ("parts", j.listed(F.col("parts"), lambda i: j.record(("i", j.integer(i)), ("text", j.text(F.col("t")))))), ("odd", j.unless(k % 2 == 0, j.flag(k % 2 == 1))),
    )
    return docs.select("doc_id", F.sha2(whole, 256).alias("record_sha256"))


@query(f"""with k as (select p_partkey as k, p_partkey % 5 as e, sha256(p_name) as h from part)
select 'p' || k as purl, case e when 0 then case when k % 2 = 0 then 'h1:' || h else '' end when 1 then case when k % 3 <> 2 then case when k % 3 = 0 then h else '' end end when 2 then h end as recorded,
  case when e = 3 then 'no checksum record for npm' when e = 4 then 'no checksum record for an unnamed ecosystem' when e = 1 and k % 3 = 2 then {_q(records.NO_PARSE)} end as error from k""")
def recorded_digests(spark, sf_dir):
    """Answers of a checksum database, a crate registry and files beside jars: with the digest, without it, and broken."""
    k, h, eco = F.col("p_partkey").cast("string"), F.sha2("p_name", 256), _mod("p_partkey", 5)
    other = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.concat(F.lit("m"), k)).otherwise("another")
    sums = F.format_string("77\nm%s v1/go.mod h1:no\n%s v1\t h1:%s\r\n%s v2 h1:no\n\n-- sig\n", k, other, h, other)
    crate = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.format_string('{"version": {"checksum": "%s", "num": "1"}}', h)).when(F.pmod("p_partkey", F.lit(3)) == 1, '{"version": {"checksum": null}}').otherwise('{"version": ')
    body = F.when(eco == 0, sums).when(eco == 1, crate).otherwise(F.concat(F.lit("\n "), F.upper(h), F.lit("  x.jar\n")))
    name = F.when(eco == 0, F.concat(F.lit("m"), k)).otherwise("x")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("purl"), _pick(("golang", "cargo", "maven", "npm", None), eco).alias("ecosystem"), name.alias("name"), F.lit("v1").alias("version"), body.alias("body"))
    return records.recorded_checksums(rows)


@query(f"""with b as (select p_brand, p_partkey as k, p_size, case when p_partkey % 4 = 0 and ascii(right(p_brand, 1)) % 2 = 0 then 'sdist' when p_partkey % 4 = 3 then 'bdist_egg' else 'bdist_wheel' end as t from part),
f as (select p_brand, arg_min(k, (t <> 'sdist', case when t = 'sdist' then k else p_size end, 'x-' || k || case when t = 'sdist' then '.tar.gz' else '.whl' end)) as k, any_value(t) filter (where t <> 'bdist_egg') as some from b where t <> 'bdist_egg' group by 1)
select p_brand as purl, 'x-' || k || case when k % 4 = 0 and ascii(right(p_brand, 1)) % 2 = 0 then '.tar.gz' else '.whl' end as filename, 'https://f.org/' || k as url, 's' || k as recorded, null as error from f
union all select 'broken-' || p_brand, null, null, null, {_q(records.NO_PARSE)} from f union all select 'empty-' || p_brand, null, null, null, {_q(records.GONE)} from f""")
def release_index(spark, sf_dir):
    """A release's archives as its index lists them: the first source archive, else the smallest wheel; broken and empty entries."""
    k = F.col("p_partkey")
    source = (F.pmod(k, F.lit(4)) == 0) & (F.pmod(F.ascii(F.right("p_brand", F.lit(1))), F.lit(2)) == 0)
    kind = F.when(source, "sdist").when(F.pmod(k, F.lit(4)) == 3, "bdist_egg").otherwise("bdist_wheel")
    suffix = F.when(source, ".tar.gz").when(kind == "bdist_egg", ".egg").otherwise(".whl")
    entry = F.struct(k.alias("k"), F.format_string('{"filename": "x-%d%s", "url": "https://f.org/%d", "packagetype": "%s", "size": %d, "digests": {"sha256": "s%d"}}', k, suffix, k, kind, F.col("p_size"), k).alias("j"))
    listed = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("purl")).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    whole = F.concat(F.lit('{"urls": ['), F.array_join(F.transform("l", lambda x: x["j"]), ", "), F.lit("]}"))
    forms = F.array(F.struct(F.col("purl").alias("purl"), whole.alias("body")), F.struct(F.concat(F.lit("broken-"), "purl").alias("purl"), F.lit('{"urls": [').alias("body")), F.struct(F.concat(F.lit("empty-"), "purl").alias("purl"), F.lit('{"urls": []}').alias("body")))
    return records.release_archives(listed.select(F.explode(forms).alias("r")).select("r.*"))


# Archives in a folder: every two hundred documents of a source are one, a zip or a tar.gz; some end too soon.
@query(f"""with {_TREE}, a as (select component_id || '-' || cast(doc_id // 200 as varchar) as component_id, doc_id // 200 as c, path, text from tree), k as (select *, ({_weight()}) is not null or {_MANIFEST} or {_PROSE} as kept from a)
select component_id, path, strlen(text) as size_bytes, sha256(text) as digest, false as failed from k where kept and c % 7 <> 3
union all select distinct component_id, component_id || case when c % 2 = 0 then '.zip' else '.tar.gz' end, 0, null, true from a where c % 7 = 3""")
def archives_by_range(spark, sf_dir):
    from uuid import uuid4

    import pyarrow as pa
    from pyarrow import fs

    from attestry.plans.formed import _tarred, _zipped
    from attestry.sources import ranges

    folder = f"{scratch.folder(spark)}/archives-{uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    scratch.passing(spark, folder)

    def pack(group: pa.Table) -> pa.Table:
        """At most two hundred documents."""
        name, c = group.column("component_id")[0].as_py(), group.column("c")[0].as_py()
        members = [(f"x-1/{p}", t or b"") for p, t in zip(group.column("path").to_pylist(), group.column("content").to_pylist())] + [("other/LICENSE", b"outside"), ("../LICENSE", b"up")]
        body, file = (_zipped(members), f"{name}.zip") if c % 2 == 0 else (_tarred(members), f"{name}.tar.gz")
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{file}", compression=None) as out:
            out.write(body[: len(body) // 2] if c % 7 == 3 else body)
        return pa.table({"component_id": [name], "name": [file], "uri": [f"{folder}/{file}"], "prefix": ["x-1"]})

    c = F.floor(F.col("doc_id") / 200)
    docs = tree(spark, sf_dir).select(F.concat("component_id", F.lit("-"), c.cast("string")).alias("component_id"), c.alias("c"), "path", "content")
    staged = scratch.materialise(docs.groupBy("component_id").applyInArrow(pack, "component_id string, name string, uri string, prefix string"), "staged")
    return ranges.expand_ranges(staged).select("component_id", "path", "size_bytes", F.sha2("content", 256).alias("digest"), F.col("read_error").isNotNull().alias("failed"))


# The functions by name over what parts are said to be licensed under, against the columns' own specification.
_SAID = ("MIT", " apache license,  Version 2.0", "GPL-2.0", "KUKA", "MIT/Apache-2.0", "zlib or ISC", "(MIT or ISC)", "https://www.apache.org/licenses/LICENSE-2.0.txt", "BSD-0-Clause", "house rules", "", "EPL 2.0 and house rules")
_SAID_ROWS = (  # id, grant_base, only, ref, canonical, satisfied by MIT and Zlib
    ("MIT", None, None, None, "MIT", True), ("Apache-2.0", None, None, None, "Apache-2.0", False), (None, "GPL-2.0", "GPL-2.0-only", None, "GPL-2.0", False), (None, None, None, "KUKA", "KUKA", False), (None, None, None, "MIT/Apache-2.0", "MIT OR Apache-2.0", True),
    (None, None, None, "zlib or ISC", "Zlib OR ISC", True), (None, None, None, "(MIT or ISC)", "(MIT or ISC)", True), ("Apache-2.0", None, None, None, "Apache-2.0", False), ("0BSD", None, None, None, "BSD-0-Clause", False), (None, None, None, "house rules", "house rules", None),
    (None, None, None, None, "", None), (None, None, None, "EPL 2.0 and house rules", "EPL-2.0 AND house rules", None),
)


@query(f"""select p_partkey, {', '.join(f"{_sql_pick(tuple(r[i] for r in _SAID_ROWS), f'p_partkey % {len(_SAID)}')} as {n}" for i, n in enumerate(('id', 'grant_base', 'only_form', 'ref', 'canonical', 'satisfied')))},
case when p_partkey % 2 = 0 then 'GPL-2.0-only WITH Some-exception' end as tag from part""")
def sql_names(spark, sf_dir):
    """Names, expressions and tags resolved from SQL text."""
    from attestry.functions import registry

    registry.register(spark)
    said = _pick(_SAID, _mod("p_partkey", len(_SAID)))
    note = F.when(_mod("p_partkey", 2) == 0, "// SPDX-License-Identifier: GPL-2.0-only WITH Some-exception\nint x;").otherwise("no tag")
    table(spark, sf_dir, "part").select("p_partkey", said.alias("said"), note.alias("note")).createOrReplaceTempView("attestry_said")
    return spark.sql("""with n as (select p_partkey, note, att_normalize(said) as r, att_canonicalize(said) as canonical from attestry_said)
        select p_partkey, r.id, r.grant_base, r.only as only_form, r.ref, canonical, att_satisfies(att_parse_expression(canonical), array('MIT', 'Zlib')) as satisfied, att_tag(note) as tag from n""")


@query(f"""with {_FINE}, w as (select component_id, path, weight, doc_id from pref where id is null and text <> ''), f as (select component_id, arg_min(path, (-weight, path)) as path, arg_min(doc_id, (-weight, path)) as doc_id from w group by 1)
select component_id, path, case when doc_id % 3 = 0 then 'the text of ' || path || ' wasn''t retained' end as error from f""")
def unretained_texts(spark, sf_dir):
    """The first text of each component that nothing recognised, an error where it wasn't kept."""
    files = _fine_files(spark, sf_dir)
    kept = files.withColumn("text", F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("text")))
    return published.unrecognised_text(kept).select("component_id", "path", "error")
