"""Lockfiles as one stream: each is found, read and parsed once, and gives its entries, its failure and what it leaves out on purpose.

A lockfile that can't be read, isn't text or has another shape than its format is a row with a failure; it never ends the job.
"""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attestry.functions import paths, purl
from attestry.functions.text import is_usable_identifier, trim_space

MAX_LOCKFILE = 64 << 20  # fixed value
#: Lockfiles that are looked for by name; the first two stand beside go.mod.
SUMS, MODULES, CARGO, NPM = "go.sum", "modules.txt", "Cargo.lock", "npm"
SHRINKWRAP, PACKAGE_LOCK, MODULE_FILE = "npm-shrinkwrap.json", "package-lock.json", "go.mod"
NAMES = (SUMS, MODULES, CARGO, SHRINKWRAP, PACKAGE_LOCK)
ECOSYSTEMS = {SUMS: "golang", MODULES: "golang", CARGO: "cargo", NPM: "npm"}
ENTRY = "struct<name:string,version:string,digest:string>"
PARSED = T.StructType().add("entries", T.ArrayType(T.StructType().add("name", "string").add("version", "string").add("digest", "string"))).add("dev", "long").add("local", "long").add("failure", "string")


class Misshapen(ValueError):
    """The file parses, but isn't what its format says."""


def _typed(value, kind, what: str, empty):
    """A field of the format; absent and null are empty, another kind is misshapen."""
    if value is None:
        return empty
    if not isinstance(value, kind) or (kind is str and isinstance(value, bool)):
        raise Misshapen(f"{what} is of another kind")
    return value


def cargo_entries(content: bytes) -> tuple[list[tuple], int, int]:
    """(entries, 0, packages without a source, which are the workspace's own). Checksums of the first version are in a table of their own."""
    doc = tomllib.loads(content.decode("utf-8"))
    table = _typed(doc.get("metadata"), dict, "metadata", {})
    out, local = [], 0
    for p in _typed(doc.get("package"), list, "package", []):
        fields = [_typed(_typed(p, dict, "a package", {}).get(k), str, k, "") for k in ("name", "version", "source", "checksum")]
        name, version, source, checksum = fields
        if source:
            out.append((name, version, checksum or _typed(table.get(f"checksum {name} {version} ({source})"), str, "a checksum", "")))
        else:
            local += 1
    return out, 0, local


def _npm_fields(p, name: str) -> dict:
    p = _typed(p, dict, f"the entry of {name or 'the project'}", {})
    for k in ("version", "resolved", "integrity", "name"):
        _typed(p.get(k), str, k, "")
    for k in ("dev", "link"):
        _typed(p.get(k), bool, k, False)
    return p


def npm_entries(content: bytes) -> tuple[list[tuple], int, int]:
    """(published packages, how many are for development, how many local), of the flat layout, or of the nested one where that is empty."""

    def no_constant(x):
        raise Misshapen(f"{x} isn't JSON")

    doc = _typed(json.loads(content.decode("utf-8", "replace"), parse_constant=no_constant), dict, "the file", {})
    flat, nested, waiting = [], [], [_typed(doc.get("dependencies"), dict, "dependencies", {})]
    for where, p in _typed(doc.get("packages"), dict, "packages", {}).items():
        p = _npm_fields(p, where)
        if where:
            flat.append((p.get("name") or where.rsplit("node_modules/", 1)[-1], p, p.get("link")))
    while waiting:
        for name, p in waiting.pop().items():
            p = _npm_fields(p, name)
            nested.append((name, p, False))
            waiting.append(_typed(p.get("dependencies"), dict, "dependencies", {}))
    found, dev, local = {}, 0, 0
    for name, p, link in flat if doc.get("packages") else nested:
        version = p.get("version") or ""
        if p.get("dev"):
            dev += 1
        elif not name or not version or link or not (p.get("resolved") or "").startswith("https://"):
            local += 1
        else:
            found[(name, version, p.get("integrity") or "")] = None
    return sorted(found), dev, local


def parse(kind: str, content: bytes) -> tuple[list[tuple] | None, int, int, str | None]:
    try:
        return (*(cargo_entries(content) if kind == CARGO else npm_entries(content)), None)
    except RecursionError:
        return None, 0, 0, "doesn't parse: it is nested too deeply"
    except ValueError as e:  # wrong UTF-8, TOML and JSON included
        return None, 0, 0, f"doesn't parse: {str(e)[:200]}"


@F.pandas_udf(PARSED)
def _parsed(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    clean = lambda s: None if s is None else s.encode("utf-8", "replace").decode()  # noqa: E731 - JSON may hold half a surrogate pair
    rows = []
    for k, c in zip(kind, content):
        found, dev, local, failure = (None, 0, 0, None) if c is None else parse(k, bytes(c))
        rows.append((None if found is None else [{"name": clean(n), "version": clean(v), "digest": clean(d)} for n, v, d in found], dev, local, clean(failure)))
    return pd.DataFrame(rows, columns=["entries", "dev", "local", "failure"])


def go_sum_lines(text: Column) -> Column:
    """array<entry> of the lines that speak of content, in order."""
    fields = F.transform(F.split(text, r"\r?\n"), lambda x: F.filter(F.split(x, r"[\t ]+"), lambda f: f != ""))
    zips = F.filter(fields, lambda f: (F.size(f) == 3) & ~F.get(f, F.lit(1)).endswith("/go.mod"))
    return F.transform(zips, lambda f: F.struct(f[0].alias("name"), f[1].alias("version"), f[2].alias("digest")))


def vendor_modules(text: Column) -> Column:
    """array<entry> of a vendored module list; a replaced module keeps its path and has the other's version."""
    lines = F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: x.startswith("# ")), lambda x: trim_space(F.substring(x, F.lit(3), F.length(x))))
    words = lambda s: F.filter(F.split(s, r"[\t ]+"), lambda w: w != "")

    def one(x: Column) -> Column:
        sides = F.split(x, " => ", 2)
        left, right = words(F.get(sides, F.lit(0))), words(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        version = F.when(F.size(sides) == 2, F.try_element_at(right, F.lit(-1))).otherwise(F.get(left, F.lit(1)))
        return F.struct(F.get(left, F.lit(0)).alias("name"), F.coalesce(version, F.lit("")).alias("version"), F.lit("").alias("digest"))

    return F.filter(F.transform(lines, one), lambda m: F.coalesce(m["name"], F.lit("")) != "")


def chosen(files: DataFrame) -> DataFrame:
    """(component_id, kind, path): which file each reader reads, by paths alone and in one aggregate: the one nearest the top in no excluded
    directory, ties by the order of a walk. `vendor-root` is a directory."""
    p, base = F.col("path"), paths.base_name(F.col("path"))
    wanted = (MODULE_FILE, CARGO, SHRINKWRAP, PACKAGE_LOCK)
    named = files.where(base.isin(*wanted) & (paths.dir_exclusion(paths.directory(p)) == ""))
    place = F.struct(F.size(F.split("path", "/")).alias("d"), F.split("path", "/").alias("s"))
    top = named.groupBy("component_id").agg(*(F.min_by("path", F.when(base == n, place)).alias(n) for n in wanted))
    # Names with dots are columns here.
    module, cargo, wrap, lock = (F.col(f"`{n}`") for n in wanted)
    beside = lambda tail: F.when(F.contains(module, F.lit("/")), F.concat(paths.directory(module), F.lit("/" + tail))).otherwise(F.when(module.isNotNull(), F.lit(tail)))
    of = lambda kind, path: F.struct(F.lit(kind).alias("kind"), path.alias("path"))
    every = F.array(of(SUMS, beside("go.sum")), of(MODULES, beside("vendor/modules.txt")), of("vendor-root", beside("vendor")), of(CARGO, cargo), of(NPM, F.coalesce(wrap, lock)))
    return top.select("component_id", F.explode(every).alias("c")).select("component_id", "c.*").where("path is not null")


def payload(limit: int = MAX_LOCKFILE) -> Column:
    return F.when(F.col("read_error").isNull() & (F.col("size_bytes") <= limit), F.col("content"))


def read(contents: DataFrame) -> DataFrame:
    """(component_id, kind, path, entries, dev, local, failure, there, listed) of (component_id, kind, path, size_bytes, read_error, content), one row a
    chosen file, size null where there is none. `listed` says of the component whether its module list is there."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    out = contents.withColumn("r", _parsed("kind", F.when(F.col("kind").isin(CARGO, NPM), F.col("content"))))
    native = F.when(F.col("kind") == SUMS, go_sum_lines(text)).when(F.col("kind") == MODULES, vendor_modules(text))
    unread = F.coalesce(F.col("read_error"), F.when(F.col("size_bytes") > MAX_LOCKFILE, F.format_string("is larger than the %d byte limit", F.lit(MAX_LOCKFILE))))
    readable = F.col("content").isNotNull()
    # A component has at most five such rows.
    listed = F.max((F.col("kind") == MODULES) & readable).over(Window.partitionBy("component_id"))
    return out.select(
        "component_id", "kind", "path", F.coalesce(F.col("r.entries"), native).cast(f"array<{ENTRY}>").alias("entries"), F.col("r.dev").alias("dev"), F.col("r.local").alias("local"), F.coalesce(unread, F.col("r.failure")).alias("failure"),
        F.col("size_bytes").isNotNull().alias("there"), listed.alias("listed"),
    )


def stream(files: DataFrame) -> DataFrame:
    """read() of a whole files table: its paths once, and once the contents of files with such names."""
    held = files.where(paths.base_name(F.col("path")).isin(*NAMES)).select("component_id", "path", "size_bytes", "read_error", payload().alias("content"))
    return read(chosen(files).join(held, ["component_id", "path"], "left"))


def parts(locks: DataFrame) -> DataFrame:
    """(component_id, purl, name, version, ecosystem, kind, digest, digest_algo, discovered_from, linkage): the packages of the stream. Of Go the
    vendored list where there is one, else the checksum file; checksums join by module and version, of lines that repeat a key the last holds."""
    each = locks.where("entries is not null and kind <> 'vendor-root'").select("component_id", F.col("kind").alias("file"), "path", "listed", F.posexplode("entries").alias("line", "x")).select("component_id", "file", "path", "listed", "line", "x.*")
    golang = F.col("file").isin(SUMS, MODULES)
    # A sum and a listed module of one key meet in one group; packages of other files are groups of their own.
    key = F.when(golang, F.concat("name", F.lit("@"), "version")).otherwise(F.concat_ws("\n", "path", "line"))
    row = F.struct("file", "path", "name", "version", "digest")
    met = each.groupBy("component_id", "listed", golang.alias("go"), key.alias("key")).agg(F.max_by(row, F.when(F.col("file") != SUMS, F.col("line"))).alias("own"), F.max_by(row, F.when(F.col("file") == SUMS, F.col("line"))).alias("sum"))
    kept = met.where("own is not null or not listed").withColumn("x", F.coalesce("own", "sum"))
    digest = F.coalesce(F.when(F.col("go"), F.col("sum.digest")).otherwise(F.col("x.digest")), F.lit(""))
    eco = F.when(F.col("go"), "golang").when(F.col("x.file") == CARGO, "cargo").otherwise("npm")
    name, version = F.col("x.name"), F.coalesce(F.col("x.version"), F.lit(""))
    address = F.when(F.col("go"), purl.golang(name, version)).when(F.col("x.file") == CARGO, purl.cargo(name, version)).otherwise(purl.npm(name, version))
    algorithm = F.when(F.col("go"), "h1").when(F.col("x.file") == CARGO, "sha256").otherwise("npm-integrity")
    return kept.select(
        "component_id", address.alias("purl"), name.alias("name"), version.alias("version"), eco.alias("ecosystem"), F.lit("ecosystem").alias("kind"), digest.alias("digest"),
        F.when(digest != "", algorithm).otherwise("").alias("digest_algo"), F.col("x.path").alias("discovered_from"), F.when(eco == "npm", "bundled").otherwise("static").alias("linkage"),
    )


def _ecosystem(kind: Column) -> Column:
    return F.when(kind == CARGO, "cargo").when(kind == NPM, "npm").otherwise("golang")


def failures(locks: DataFrame) -> DataFrame:
    """(component_id, detail): lockfiles whose packages are missing. A module list that can't be read has the checksum file to stand for it."""
    return locks.where((F.col("failure").isNotNull()) & (F.col("kind") != MODULES)).select("component_id", F.concat(_ecosystem(F.col("kind")), F.lit(": "), "path", F.lit(": "), "failure").alias("detail"))


def notes(locks: DataFrame) -> DataFrame:
    """(component_id, note): what was left out on purpose, and how far a list goes."""
    said = lambda test, text, *n: F.when(test, F.format_string(text, *n) if n else F.lit(text))
    kind, n = F.col("kind"), F.array_size(F.coalesce("entries", F.array().cast(f"array<{ENTRY}>")))
    distinct = F.array_size(F.array_distinct(F.transform("entries", lambda x: F.concat(x["name"], F.lit("@"), x["version"]))))
    every = F.array(
        said((kind == NPM) & (F.col("dev") > 0), "npm: %d development dependencies excluded; they are not shipped", F.col("dev")), said((kind == NPM) & (F.col("local") > 0), "npm: %d workspace or non-registry entries covered by the package source", F.col("local")),
        said((kind == CARGO) & (F.col("local") > 0), "cargo: %d workspace-local crates covered by the package source", F.col("local")),
        said((kind == SUMS) & ~F.col("listed") & (n > 0), "go: %d module identities from go.sum, which may include modules that the build prunes", distinct), said((kind == SUMS) & ~F.col("listed") & (n == 0), "go: no list and no checksums of modules beside go.mod; none is enumerated"),
    )
    return locks.select("component_id", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("note"))


def dropped(found: DataFrame) -> DataFrame:
    """(component_id, note): identities that are no use, counted."""
    bad = found.where(~(is_usable_identifier(F.col("purl")) & is_usable_identifier(F.col("name"))))
    return bad.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).select("component_id", F.format_string("%d component identities dropped for blanks or control characters", "n").alias("note"))
