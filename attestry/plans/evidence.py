"""The whole account of every component in one plan: files, declarations, dependencies, keys, conclusion, assessment, gaps, record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import canonical, paths, spdx
from attestry.functions.digests import content_hash, file_digest, license_ref
from attestry.functions.text import head_bytes, trim_space
from attestry.operators import assess as assessing
from attestry.operators import classify, components, conclude, detection, locks, manifests, spans
from attestry.sources.archives import jar_coordinates
from attestry.sources.scratch import materialise

SCHEMA_VERSION = 1
#: Matches below this share of a known text are chance.
WEAK = 0.25
_KEY = ["component_id", "path"]


def is_unread_directory() -> Column:
    """Of a files table: a directory that couldn't be listed; its path ends in a slash."""
    return F.col("path").endswith("/") & F.col("read_error").isNotNull()


def _declared(declarations: DataFrame) -> DataFrame:
    """(component_id, path, license, override, ord), '' for what is absent: override names the match that a declaration knowingly disagrees with."""
    override = F.col("override") if "override" in declarations.columns else F.lit(None).cast("string")
    blank = lambda x: F.coalesce(x, F.lit(""))
    return declarations.select("component_id", blank(F.col("path")).alias("path"), blank(F.col("license")).alias("license"), blank(override).alias("override"), "ord")


def named_files(files: DataFrame, declarations: DataFrame | None = None) -> DataFrame:
    """One pass over contents for all that names decide: licence files and those that are declared only (weight, excluded, digest, text, truncated, declared),
    manifests (manifest), prose (hints), and directories that couldn't be listed. What a row isn't is null. A declared file that isn't there
    is a row with its error."""
    p = F.col("path")
    weight = paths.terms_weight(p) + F.when(paths.depth(p) == 0, F.lit(paths.ROOT_BONUS)).otherwise(0.0)
    rows = files.select(*_KEY, "content", "size_bytes", "read_error", weight.alias("weight"))
    if declarations is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("declared", "override")})
    else:
        # A declaration without a path speaks for the component as a whole.
        of_files = _declared(declarations).where("path <> ''")
        latest = of_files.groupBy(*_KEY).agg(F.max_by(F.struct(F.col("license").alias("declared"), "override"), "ord").alias("d")).select(*_KEY, "d.*")
        # Contents of files that neither names nor declarations ask for stay out of the join.
        there = rows.join(latest, _KEY, "left")
        missing = latest.join(files.select(*_KEY), _KEY, "left_anti").select(*_KEY, F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("size_bytes"), F.lit("declared, but not in the tree").alias("read_error"), F.lit(None).cast("double").alias("weight"), "declared", "override")
        rows = there.unionByName(missing)
    licence = F.col("weight").isNotNull() | F.col("declared").isNotNull()
    rows = rows.where(licence | manifests.is_manifest() | detection.is_prose() | is_unread_directory())
    ok = licence & F.col("read_error").isNull()
    is_manifest = manifests.is_manifest()
    read = rows.select(
        *_KEY, "size_bytes", "read_error", "declared", "override", licence.alias("is_licence"), F.when(licence, F.coalesce("weight", F.lit(0.0))).alias("weight"), F.when(licence, paths.exclusion(p)).alias("excluded"), F.when(ok, file_digest(F.col("content"))).alias("digest"),
        F.when(ok, head_bytes(F.col("content"), detection.MAX_TEXT_BYTES).cast("string")).alias("text"), (ok & (F.col("size_bytes") > detection.MAX_TEXT_BYTES)).alias("truncated"),
        F.when(detection.is_prose(), detection.hints(F.col("content"))).alias("hints"), is_manifest.alias("is_manifest"), manifests.manifest(p, F.when(is_manifest, F.col("content"))).alias("m"),
    )
    said = F.when(F.col("is_manifest") & (F.col("m.license") != ""), spdx.canonicalize(F.col("m.license")))
    parsed = read.withColumn("postfix", spdx.parse(said))
    whole = F.struct("path", "m.ecosystem", "m.license", "m.license_file", F.when(F.col("postfix").isNotNull(), spdx.operands(F.col("postfix"))).alias("names"))
    return parsed.withColumn("manifest", F.when(F.col("is_manifest"), whole)).drop("postfix", "m", "is_manifest")


def chosen_files(files: DataFrame) -> DataFrame:
    """(component_id, kind, path, i, size_bytes, read_error, content): lockfiles whole and sampled sources by their heads, chosen by paths alone and then read
    together; size is null where a chosen file isn't there."""
    p = F.col("path")
    lock = paths.base_name(p).isin(*locks.NAMES)
    content = F.when(lock, locks.payload()).otherwise(head_bytes(F.col("content"), detection.MAX_NOTICE_BYTES))
    held = files.where(lock | paths.is_notice_source(p)).select(*_KEY, "size_bytes", "read_error", content.alias("content"))
    wanted = locks.chosen(files).withColumn("i", F.lit(None).cast("int")).unionByName(detection.notice_paths(files).withColumn("kind", F.lit("notice")))
    return wanted.join(held, _KEY, "left")


def _sorted(rows: str, *order: str) -> Column:
    """The structs of a collected list in the order of some of their fields."""
    keyed = F.transform(rows, lambda x: F.struct(F.struct(*(x[o] for o in order)).alias("o"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def observations(subjects: DataFrame, files: DataFrame, corpus: DataFrame, installed: DataFrame | None, declarations: DataFrame | None) -> DataFrame:
    """All that was seen as rows of (component_id, one column a kind of thing): each reader gives one stream. Four steps are written once."""
    named = materialise(named_files(files, declarations), "named")
    chosen = materialise(chosen_files(files), "chosen")
    notices = materialise(detection.notice_heads(chosen.where("kind = 'notice'").withColumnRenamed("content", "head")), "notices")
    read = materialise(locks.read(chosen.where("kind <> 'notice'")), "locks")

    texts = named.where("is_licence")
    near = spans.identify(texts.select(*_KEY, "text"), _KEY, corpus).where(F.col("confidence") >= WEAK)
    matched = classify.matches_by_file(near, _KEY)
    matches = F.coalesce("matches", F.expr("cast(array() as array<struct<name:string,confidence:double>>)"))
    names = F.transform(F.filter(matches, lambda m: m["confidence"] >= classify.THRESHOLD), lambda m: m["name"])
    ids = F.array_sort(F.array_distinct(F.transform(names, conclude.identifier_of)))
    file = F.struct(
        (-F.col("weight")).alias("w"), "path", "weight", "excluded", matches.alias("matches"), F.coalesce("declared", F.lit("")).alias("declared"), F.coalesce("override", F.lit("")).alias("override"), "size_bytes", F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"),
        "truncated", F.coalesce("read_error", F.lit("")).alias("err"), ids.alias("ids"),
    )
    prose = F.transform("hints", lambda h: F.struct(F.col("path").alias("path"), h["line"].alias("line"), h["excerpt"].alias("excerpt")))
    unlisted = F.when(is_unread_directory() & ~F.col("is_licence"), F.concat(F.regexp_replace("path", "/$", ""), F.lit(": could not be read")))
    seen = named.join(matched, _KEY, "left").select("component_id", F.when(F.col("is_licence"), file).alias("file"), "manifest", prose.alias("prose"), F.when(F.col("hints").isNotNull(), True).alias("is_prose"), unlisted.alias("unlisted"))

    granted = detection.grants(notices).select("component_id", F.struct((-F.col("files")).alias("o"), "expression", "source", "path", "files").alias("granted"))
    sampled = notices.select("component_id", F.struct("nth", "path", "text", "truncated").alias("notice"))
    found = locks.parts(read)
    said = locks.notes(read).unionByName(locks.dropped(found))
    lost = locks.failures(read)
    if installed is not None:
        jars = materialise(jar_coordinates(installed.where("read_error is null")), "jars")
        found, lost = found.unionByName(components.enumerate_installed(installed, jars=jars)), lost.unionByName(components.installed_gaps(installed, jars))
    parts = components.one_each(found).select("component_id", F.struct(*(c for c in components.FIELDS if c != "component_id")).alias("part"))
    streams = [seen, granted, sampled, parts, said, lost.withColumnRenamed("detail", "lost"), read.where("kind = 'vendor-root'").select("component_id", F.col("path").alias("vendor_root"))]
    if installed is not None:
        streams.append(installed.groupBy("component_id").agg(F.lit(True).alias("has_installed")))
    if declarations is not None:
        streams.append(_declared(declarations).select("component_id", F.struct("ord", "license", "path", "override").alias("said")))
    known = [c if c in subjects.columns else F.lit(None).cast("string").alias(c) for c in ("name", "version", "repository", "commit", "origin", "source_error", "installed_error")]
    out = subjects.select("component_id", F.struct(*(F.col(c).cast("string").alias(c) if isinstance(c, str) else c for c in known)).alias("subject"))
    for s in streams:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def collect(subjects: DataFrame, files: DataFrame, corpus: DataFrame, installed: DataFrame | None = None, declarations: DataFrame | None = None) -> DataFrame:
    """One row for each of subjects(component_id and, where known, name, version, repository, commit, origin, source_error, installed_error): the parts of
    its evidence and the record made of them.

    observations() are folded by one aggregate; all that follows is within a row. A row's lists are a component's own licence files,
    manifests, packages and sampled notices."""
    none = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as array<{kind}>)"))
    seen = observations(subjects, files, corpus, installed, declarations)
    for c, kind in (("has_installed", "boolean"), ("said", "struct<ord:int,license:string,path:string,override:string>")):
        if c not in seen.columns:
            seen = seen.withColumn(c, F.lit(None).cast(kind))
    lists = ("file", "manifest", "prose", "granted", "notice", "part", "note", "lost", "unlisted", "said")
    g = seen.groupBy("component_id").agg(
        F.first("subject", ignorenulls=True).alias("subject"), *(F.collect_list(c).alias(c) for c in lists), F.max("is_prose").alias("is_prose"), F.first("vendor_root", ignorenulls=True).alias("vendor_root"), F.max("has_installed").alias("has_installed")
    ).where("subject is not null")
    parts = F.transform(_sorted("part", "purl", "digest"), lambda p: p)
    g = g.select(
        "component_id", "subject", _sorted("file", "w", "path").alias("files"), _sorted("manifest", "path").alias("manifests"), F.array_sort(F.flatten("prose")).alias("prose"), F.array_sort("granted").alias("granted"),
        _sorted("notice", "nth").alias("notices"), parts.alias("parts"), F.array_sort(F.array_distinct("note")).alias("noted"), F.array_sort(F.array_distinct("lost")).alias("lost"), F.array_sort(F.array_distinct("unlisted")).alias("unlisted"),
        F.array_sort("said").alias("said"), F.coalesce("is_prose", F.lit(False)).alias("has_prose"), F.coalesce("vendor_root", F.lit("")).alias("vendor_root"), F.coalesce("has_installed", F.lit(False)).alias("has_installed"),
    )
    return _recorded(_owned(g))


def _owned(g: DataFrame) -> DataFrame:
    """Whose files are whose: a copy of a package under the vendor root, with licence files in it, owns what no deeper copy does."""
    covered = F.filter("files", lambda f: (f["digest"] != "") & paths.is_terms_file(f["path"]))
    g = g.withColumn("covered", F.transform(covered, lambda f: F.struct(f["path"].alias("path"), f["digest"].alias("digest"), f["excluded"].alias("excluded"), paths.ancestors(f["path"]).alias("above"))))
    at = lambda name: F.concat("vendor_root", F.lit("/"), name)
    named = F.transform(F.filter("parts", lambda p: (p["name"] != "") & (F.col("vendor_root") != "")), lambda p: at(p["name"]))
    # Files without a digest mark a copy as being there all the same.
    above = F.flatten(F.transform(F.filter("files", lambda f: paths.is_terms_file(f["path"])), lambda f: paths.ancestors(f["path"])))
    g = g.withColumn("roots", F.array_intersect(named, above))
    owner = lambda c: F.array_max(F.transform(F.array_intersect(c["above"], F.col("roots")), lambda r: F.struct(F.length(r).alias("n"), r.alias("root"))))["root"]
    g = g.withColumn("covered", F.transform("covered", lambda c: F.struct(c["path"].alias("path"), c["digest"].alias("digest"), c["excluded"].alias("excluded"), owner(c).alias("root"))))
    record = lambda path, c: F.struct(path.alias("path"), c["digest"].alias("digest"))
    mine = F.filter("covered", lambda c: c["root"].isNull() & ~paths.belongs_to_another(c["excluded"]))
    below = lambda r: F.transform(F.filter("covered", lambda c: c["root"] == r), lambda c: record(F.substring(c["path"], F.length(r) + 2, F.length(c["path"])), c))
    g = g.withColumns({"terms_content_hash": content_hash(F.transform(mine, lambda c: record(c["path"], c))), "copies": F.transform("roots", lambda r: F.struct(r.alias("root"), content_hash(below(r)).alias("h")))})
    copy_of = lambda p: F.get(F.filter("copies", lambda k: k["root"] == at(p["name"])), F.lit(0))
    fields = [c for c in components.FIELDS if c != "component_id"]
    order = (*fields[:7], "terms_content_hash", *fields[7:])
    whole = lambda p: F.struct(*((F.coalesce(copy_of(p)["h"], F.lit("")) if c == "terms_content_hash" else p[c]).alias(c) for c in order))
    g = g.withColumn("parts", F.transform("parts", whole))
    held = F.filter("parts", lambda p: p["terms_content_hash"] != "")
    return g.withColumn("vendored_copies", F.array_sort(F.array_distinct(F.transform(held, lambda p: F.struct(p["purl"].alias("purl"), at(p["name"]).alias("root")))))).drop("covered", "copies")


def _recorded(g: DataFrame) -> DataFrame:
    """Conclusion, gaps, notes and assessment of a folded row."""
    blank, none = F.lit(""), F.expr("cast(array() as array<string>)")
    # Where a component has an in-scope file at the top, even an unreadable one, only such files count.
    scope = F.filter("files", lambda f: f["excluded"] == "")
    g = g.withColumn("scope", scope).withColumn("top", F.exists("scope", lambda f: ~F.contains(f["path"], F.lit("/"))))
    g = g.withColumn("readable", F.filter("scope", lambda f: (~F.col("top") | ~F.contains(f["path"], F.lit("/"))) & (f["err"] == "")))
    unread = F.filter("readable", lambda f: (F.size(f["ids"]) == 0) & (f["size_bytes"] > 0))
    g = g.withColumns({"identifiers": F.array_sort(F.array_distinct(F.flatten(F.transform("readable", lambda f: f["ids"])))), "unrecognised": unread, "sampled": F.size("notices").cast("long")})
    settled = conclude.settle(F.col("identifiers"), F.size("unrecognised") > 0, F.transform("granted", lambda x: x["expression"]), F.col("sampled"))
    g = g.withColumns({**settled, "license_ref": F.coalesce(license_ref(F.get("unrecognised", F.lit(0))["text"]), blank)})

    gap = lambda kind, details: F.transform(details, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("detail")))
    maybe = lambda kind, detail: gap(kind, F.filter(F.array(detail), lambda d: d.isNotNull()))
    no_trees = F.when(~F.col("has_installed") & F.col("subject.installed_error").isNull(), F.lit("no installed tree supplied; " + ", ".join(components.INSTALLED_ECOSYSTEMS) + " components were not enumerated"))
    unreadable = F.transform(F.filter("files", lambda f: f["err"] != ""), lambda f: F.concat(f["path"], F.lit(": "), f["err"]))
    gaps = F.concat(
        maybe("source", F.col("subject.source_error")), gap("unreadable-tree", F.col("unlisted")), maybe("installed", F.col("subject.installed_error")), maybe("no-installed-trees", no_trees), gap("dependencies", F.col("lost")), gap("license-file", unreadable)
    )
    cut, copies = F.size(F.filter("files", lambda f: f["truncated"])), F.size("vendored_copies")
    made = lambda n, text: F.when(n > 0, F.format_string(text, n))
    notes = F.filter(F.concat(F.array(made(cut, f"%d texts cut at {detection.MAX_TEXT_BYTES} bytes")), F.col("noted"), F.array(made(copies, "%d components have a vendored copy in the tree, hashed for verification"))), lambda n: n.isNotNull())
    declared = F.filter(F.array_distinct(F.transform("said", lambda s: trim_space(s["license"]))), lambda x: x != "")
    stated = F.filter("manifests", lambda m: m["license"] != "")
    g = g.withColumns({
        "gaps": gaps, "notes": notes, "purls": F.array_sort(F.transform("parts", lambda p: p["purl"])), "manifest_terms": F.get(stated, F.lit(0))["license"], "manifest_sets": F.transform(F.filter(stated, lambda m: m["names"].isNotNull()), lambda m: m["names"]),
        # One that declares nothing is no evidence.
        "has_manifest": F.exists("manifests", lambda m: (m["license"] != "") | (m["license_file"] != "")), "states_choice": F.exists("prose", lambda p: detection.is_choice(p["excerpt"])),
        "declared_expression": F.coalesce(F.when(F.size(declared) > 0, F.array_join(declared, " AND ")), F.get(stated, F.lit(0))["license"], blank), "unreadable": unreadable,
        "grants": F.transform("granted", lambda x: F.struct(*(x[c].alias(c) for c in ("expression", "source", "path", "files")))), "notices": F.transform("notices", lambda n: F.struct(*(n[c].alias(c) for c in ("path", "text", "truncated")))),
    })
    g = g.withColumns({"incomplete": F.size("gaps"), "canonical": F.when(F.col("declared_expression") != "", spdx.canonicalize(F.col("declared_expression")))})
    g = g.withColumn("postfix", spdx.parse(F.col("canonical")))
    g = g.withColumn("declared", F.when(F.col("canonical").isNotNull(), spdx.lenient_operands(F.col("canonical"), F.col("postfix"))).otherwise(none))
    first = lambda f: F.get(f["matches"], F.lit(0))
    rest = lambda f: F.slice(f["matches"], F.lit(2), F.greatest(F.size(f["matches"]) - 1, F.lit(0)))
    listed = lambda f: F.struct(
        *(f[c].alias(c) for c in ("path", "weight", "excluded")), F.coalesce(first(f)["name"], F.lit(assessing.NO_ASSERTION)).alias("license"), F.coalesce(first(f)["confidence"], F.lit(0.0)).alias("confidence"), rest(f).alias("additional_licenses"),
        *(f[c].alias(c) for c in ("declared", "override", "size_bytes", "digest", "text", "truncated", "err", "ids")),
    )
    g = g.withColumn("files", F.transform("files", listed))
    kept = ("subject", "said", "files", "manifests", "prose", "notices", "sampled", "grants", "parts", "purls", "vendor_root", "vendored_copies", "terms_content_hash", "expression", "reason", "identifiers", "grant_basis", "license_ref", "declared_expression", "unreadable", "gaps", "notes")
    done = assessing.assess(g, kept)
    s = lambda c: F.coalesce(F.col(f"subject.{c}"), blank).alias(c)
    about = F.struct(F.coalesce("subject.name", "component_id").alias("package"), s("version"), s("repository"), s("commit"), s("origin"), F.col("said").alias("declared"))
    done = done.withColumn("subject", about).drop("said")
    names = done.select("*", F.col("subject.package").alias("name"), "subject.version", "subject.repository", "subject.commit", F.expr("cast(array() as array<struct<path:string,digest:string>>)").alias("patches"))
    own = components.source_of()
    return names.withColumn("source", own).drop("name", "version", "repository", "commit", "patches")


def encoded() -> Column:
    """A collected row as canonical JSON with a newline at the end. The source component leads the list of components."""
    c, j = F.col, canonical
    texts = lambda x, *names: [(n, j.text(x[n])) for n in names]
    source = j.record(("name", j.text(c("subject.package"))), *((n, j.optional(c(f"subject.{n}"))) for n in ("version", "repository", "commit")))
    said = lambda d: j.record(("license", j.text(d["license"])), ("path", j.optional(d["path"])), ("override", j.optional(d["override"])))
    subject = j.record(("package", j.text(c("subject.package"))), ("version", j.optional(c("subject.version"))), ("source", source), ("declared", j.some(c("subject.declared"), said)), ("origin", j.optional(c("subject.origin"))))
    # The names of these two fields begin with capitals, unlike all others.
    match = lambda m: j.record(("Name", j.text(m["name"])), ("Confidence", j.number(m["confidence"])))
    file = lambda f: j.record(
        ("path", j.text(f["path"])), ("weight", j.number(f["weight"])), ("excluded", j.optional(f["excluded"])), ("license", j.text(f["license"])), ("confidence", j.number(f["confidence"])), ("additional_licenses", j.some(f["additional_licenses"], match)),
        ("declared", j.optional(f["declared"])), ("override", j.optional(f["override"])), ("size_bytes", j.integer(f["size_bytes"])), ("digest", j.text(f["digest"])), ("text", j.optional(f["text"])), ("truncated", j.unless(~f["truncated"], j.flag(f["truncated"]))), ("error", j.optional(f["err"])),
    )
    manifest = lambda m: j.record(*texts(m, "path", "ecosystem", "license"), ("license_file", j.optional(m["license_file"])))
    prose = lambda p: j.record(("path", j.text(p["path"])), ("line", j.integer(p["line"])), ("excerpt", j.text(p["excerpt"])))
    notice = lambda n: j.record(*texts(n, "path", "text"), ("truncated", j.unless(~n["truncated"], j.flag(n["truncated"]))))
    grant = lambda g: j.record(*texts(g, "expression", "source", "path"), ("files", j.integer(g["files"])))

    def component(p, terms_content_hash):
        return j.record(
            *texts(p, "purl", "name"), ("version", j.optional(p["version"])), *texts(p, "ecosystem", "kind"), ("digest", j.optional(p["digest"])), ("digest_algo", j.optional(p["digest_algo"])), ("license_content_hash", j.text(terms_content_hash)), ("discovered_from", j.text(p["discovered_from"])),
            ("linkage", j.optional(p["linkage"])),
        )

    own = component(c("source"), c("terms_content_hash"))
    parts = F.concat(F.lit("["), F.concat_ws(",", F.array(own), F.transform("parts", lambda p: component(p, p["terms_content_hash"]))), F.lit("]"))
    conclusion = j.record(*((n, j.optional(c(n))) for n in ("expression", "reason")), ("identifiers", j.some(c("identifiers"), j.text)), *((n, j.optional(c(n))) for n in ("grant_basis", "license_ref")))
    flags = F.when(c("flags") == "", F.expr("cast(array() as array<string>)")).otherwise(F.array_sort(F.split("flags", ",")))
    assessment = j.record(
        ("score", j.number(c("score"))), ("unknown", j.unless(~c("unknown"), j.flag(c("unknown")))), ("flags", j.some(flags, j.text)), ("relationship", j.optional(c("relationship"))), ("identifiers", j.some(c("detected"), j.text)), ("license_files", j.integer(c("license_files"))),
        ("rationale", j.text(c("rationale"))), *((n, j.number(c(n))) for n in ("project_license", "text_resolution", "relation")),
    )
    whole = j.record(
        ("schema_version", F.lit(str(SCHEMA_VERSION))), ("subject", subject), ("files", j.listed(c("files"), file)), ("manifests", j.some(c("manifests"), manifest)), ("prose", j.some(c("prose"), prose)), ("notices", j.some(c("notices"), notice)), ("notices_sampled", j.integer(c("sampled"))),
        ("grants", j.some(c("grants"), grant)), ("components", parts), ("vendor_root", j.optional(c("vendor_root"))), ("vendored_copies", j.some(c("vendored_copies"), lambda v: j.record(*texts(v, "purl", "root")))), ("license_content_hash", j.text(c("terms_content_hash"))), ("conclusion", conclusion),
        ("assessment", assessment), ("gaps", j.some(c("gaps"), lambda g: j.record(*texts(g, "kind", "detail")))), ("notes", j.some(c("notes"), j.text)),
    )
    return F.concat(whole, F.lit("\n"))


def bundles(collected: DataFrame) -> DataFrame:
    """(component_id, bundle, bundle_digest): the canonical record and its address by content, in the JVM from end to end."""
    return collected.select("component_id", encoded().alias("bundle")).withColumn("bundle_digest", file_digest(F.col("bundle")))


def complete(collected: DataFrame) -> DataFrame:
    """(component_id, complete): nothing that was looked for is missing."""
    return collected.select("component_id", (F.size("gaps") == 0).alias("complete"))


__all__ = ["collect", "bundles", "complete", "content_hash"]
