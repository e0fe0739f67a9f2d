"""Package identities from lockfiles and installed trees, over all components at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.functions import digests, paths, purl
from attestry.functions.text import is_usable_identifier
from attestry.operators import locks
from attestry.operators.manifests import metadata_headers
from attestry.sources.archives import jar_coordinates

FIELDS = ("component_id", "purl", "name", "version", "ecosystem", "kind", "digest", "digest_algo", "discovered_from", "linkage")
SOURCE_ECOSYSTEMS, INSTALLED_ECOSYSTEMS = ("golang", "cargo", "npm"), ("pypi", "maven")


def shallowest(files: DataFrame, name: Column | str) -> DataFrame:
    """(component_id, path): the file of that name nearest the top in no excluded directory; ties go to the first on a walk."""
    p = F.col("path")
    named = files.where((paths.base_name(p) == name) & (paths.dir_exclusion(paths.directory(p)) == ""))
    return named.groupBy("component_id").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")).alias("d"), F.split("path", "/").alias("s"))).alias("path"))


def _component(df: DataFrame, address: Column, ecosystem: str, algorithm: Column | str, linkage: str) -> DataFrame:
    """Digest and algorithm are set together or not at all."""
    digest = F.coalesce(F.col("digest"), F.lit(""))
    algorithm = F.lit(algorithm) if isinstance(algorithm, str) else algorithm
    return df.select(
        "component_id", address.alias("purl"), F.col("name"), F.coalesce("version", F.lit("")).alias("version"), F.lit(ecosystem).alias("ecosystem"), F.lit("ecosystem").alias("kind"), digest.alias("digest"),
        F.when(digest != "", algorithm).otherwise("").alias("digest_algo"), F.col("path").alias("discovered_from"), F.lit(linkage).alias("linkage"),
    )


def enumerate_go(files: DataFrame) -> DataFrame:
    return locks.parts(locks.stream(files).where(F.col("kind").isin(locks.SUMS, locks.MODULES)))


def enumerate_cargo(files: DataFrame) -> DataFrame:
    """Packages with a source; those without are the workspace's own."""
    return locks.parts(locks.stream(files).where(F.col("kind") == locks.CARGO))


def enumerate_npm(files: DataFrame) -> DataFrame:
    return locks.parts(locks.stream(files).where(F.col("kind") == locks.NPM))


def enumerate_python(installed: DataFrame, own: str = "") -> DataFrame:
    """Distributions of installed trees by their dist-info; the component's own isn't its dependency."""
    meta = installed.where(F.col("path").rlike(r"(^|/)[^/]*\.dist-info/METADATA\z") & ~F.col("path").rlike(r"\.dist-info/.*\.dist-info/") & F.col("read_error").isNull())
    rows = meta.select("component_id", "path", metadata_headers(F.col("content").cast("string")).alias("h")).select("component_id", "path", F.try_element_at("h", F.lit("name")).alias("name"), F.try_element_at("h", F.lit("version")).alias("version"), F.lit(None).cast("string").alias("digest"))
    rows = rows.where("name is not null and name <> ''")
    if own:
        rows = rows.where(~purl.is_own_distribution(F.col("name"), F.lit(own)))
    return _component(rows, purl.pypi(F.col("name"), F.col("version")), "pypi", "sha256", "bundled")


def enumerate_java(installed: DataFrame, jars: DataFrame | None = None) -> DataFrame:
    """`jars` is jar_coordinates() of the trees, where the caller has it already."""
    found = (jar_coordinates(installed) if jars is None else jars).where("group_id is not null")
    rows = found.select("component_id", "path", F.concat("group_id", F.lit(":"), "artifact_id").alias("name"), "group_id", "artifact_id", "version", F.lit(None).cast("string").alias("digest"))
    return _component(rows, purl.maven(F.col("group_id"), F.col("artifact_id"), F.col("version")), "maven", "sha1", "bundled")


def finalize(components: DataFrame) -> DataFrame:
    """Malformed identities dropped, one row for each (component_id, purl, digest); `ord` puts the source component first."""
    return one_each(components).withColumn("ord", F.row_number().over(Window.partitionBy("component_id").orderBy(F.col("kind") != "package-source", "purl", "digest")))


def one_each(components: DataFrame) -> DataFrame:
    """Usable identities, one row for each (component_id, purl, digest): the first by where it was found. Repeats are combined before they travel."""
    usable = components.where(is_usable_identifier(F.col("purl")) & is_usable_identifier(F.col("name")))
    rest = [c for c in FIELDS if c not in ("component_id", "purl", "digest")]
    first = usable.groupBy("component_id", "purl", "digest").agg(F.min_by(F.struct(*rest), F.struct("discovered_from", "linkage", "kind", "name")).alias("x"))
    return first.select("component_id", "purl", "digest", "x.*").select(*FIELDS)


def enumerate_source(files: DataFrame) -> DataFrame:
    return locks.parts(locks.stream(files))


def lockfile_gaps(files: DataFrame) -> DataFrame:
    """(component_id, detail): lockfiles whose dependencies are missing because they can't be read, are too large or don't parse."""
    return locks.failures(locks.stream(files))


def installed_gaps(installed: DataFrame, jars: DataFrame | None = None) -> DataFrame:
    """(component_id, detail): how many jars give no coordinates, and how many distributions no readable metadata."""
    read = jar_coordinates(installed.where("read_error is null")) if jars is None else jars
    # A jar is one name here however many coordinates it has; one that wasn't read at all still counts.
    named = read.select("component_id", "path", F.col("group_id").isNotNull().cast("int").alias("good"))
    every = installed.where(F.lower("path").endswith(".jar")).select("component_id", "path", F.lit(0).alias("good")).unionByName(named)
    lost = every.groupBy("component_id", "path").agg(F.max("good").alias("good")).groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).where("good < n")
    of_jars = lost.select("component_id", F.format_string("maven: %d of %d jars carry no coordinates", F.col("n") - F.col("good"), "n").alias("detail"))
    inside = F.regexp_extract("path", r"^((?:.*/)?[^/]*\.dist-info)/", 1)
    # A directory is known by the files in it.
    dirs = installed.select("component_id", inside.alias("dir"), (F.col("path") == F.concat(inside, F.lit("/METADATA"))).alias("meta"), F.col("read_error").isNull().alias("ok")).where("dir <> '' and not dir rlike '[.]dist-info/'")
    poor = dirs.groupBy("component_id", "dir").agg(F.max(F.col("meta") & F.col("ok")).alias("good")).where("not good").groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    return of_jars.unionByName(poor.select("component_id", F.format_string("pypi: %d dist-info directories had no readable METADATA", "n").alias("detail")))


def notes(files: DataFrame) -> DataFrame:
    """(component_id, note): what enumeration left out on purpose, how wide a list without a vendored one is, identities dropped."""
    read = locks.stream(files)
    return locks.notes(read).unionByName(locks.dropped(locks.parts(read)))


def enumerate_installed(installed: DataFrame, own: str = "", jars: DataFrame | None = None) -> DataFrame:
    return enumerate_python(installed, own).unionByName(enumerate_java(installed, jars))


def source_of() -> Column:
    """struct of the component itself, of columns name, version, repository, commit, patches array<struct<path, digest>>. It goes by its repository where that
    is known. Its digest is that of its patches, with the algorithm named even where there are none."""
    address = purl.source(F.col("name"), F.col("version"), F.col("repository"), F.col("commit"))
    return F.struct(
        address.alias("purl"), F.coalesce(F.nullif(F.col("repository"), F.lit("")), F.col("name")).alias("name"), F.col("version").alias("version"), F.lit("generic").alias("ecosystem"), F.lit("package-source").alias("kind"),
        digests.patch_set_digest(F.col("patches")).alias("digest"), F.lit("patch-set").alias("digest_algo"), F.lit("").alias("discovered_from"), F.lit("").alias("linkage"),
    )


def source_components(sources: DataFrame) -> DataFrame:
    """(component_id and the fields of source_of) of sources(component_id, name, version, repository, commit, patches)."""
    return sources.select("component_id", source_of().alias("s")).select("component_id", "s.*")
