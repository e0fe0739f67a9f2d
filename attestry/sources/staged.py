"""Published artifacts that an acquisition job has staged: addresses to fetch, address rules, checksums. The engine itself opens no connection."""

from __future__ import annotations

import ipaddress
from urllib.parse import quote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.digests import subresource_integrity
from attestry.sources.scratch import materialise

#: The most parents of a POM that are followed.
POM_ANCESTRY = 8


def artifact_name(ecosystem: Column, name: Column, version: Column) -> tuple[Column, Column]:
    """(file name, prefix inside the archive) by ecosystem."""
    base = F.substring_index(name, "/", -1)
    file = (
        F.when(ecosystem == "golang", F.concat(version, F.lit(".zip")))
        .when(ecosystem == "cargo", F.concat(name, F.lit("-"), version, F.lit(".crate")))
        .when(ecosystem == "npm", F.concat(base, F.lit("-"), version, F.lit(".tgz")))
        .when(ecosystem == "maven", F.concat(F.substring_index(name, ":", -1), F.lit("-"), version, F.lit(".jar")))
    )
    prefix = F.when(ecosystem == "golang", F.concat(name, F.lit("@"), version)).when(ecosystem == "cargo", F.concat(name, F.lit("-"), version)).when(ecosystem == "npm", F.lit("package")).otherwise("")
    return file, prefix


def valid_url(url: Column) -> Column:
    """Only the text of the address: https, a public host name, no user information, no number for a host."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    local = host.isin("localhost") | host.rlike(r"\.(local|internal|localhost)\z")
    number = host.rlike(r"^[0-9.]+\z") | F.contains(host, F.lit(":")) | host.startswith("[") | host.rlike(r"^0x")
    return url.startswith("https://") & (host != "") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & ~local & ~number


def redact_url(url: Column) -> Column:
    """Without user information, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^([a-z]+://)[^/@]*@", "$1"), r"[?#].*\z", "")


def is_public_address(text: str) -> bool:
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return False
    return ip.is_global and not ip.is_multicast


def path_segments(*values: str) -> list[str]:
    """Escaped segments of an address; a segment that would climb is refused."""
    for v in values:
        if v in ("", ".", "..") or any(s in (".", "..", "") for s in v.split("/")):
            raise ValueError(f"{v!r} is no path segment")
    return [quote(v, safe="/@!") for v in values]


def host_of(url: str) -> str:
    return (urlsplit(url).hostname or "").lower()


def preferred_archive(files: DataFrame) -> DataFrame:
    """Of a release's files (component_id, filename, packagetype, size) one: the first source archive, else the smallest wheel, ties by name."""
    usable = files.where((F.col("packagetype") == "sdist") | F.col("filename").endswith(".whl"))
    rank = F.struct((F.col("packagetype") != "sdist").alias("a"), F.when(F.col("packagetype") == "sdist", F.lit(0)).otherwise(F.col("size")).alias("b"), F.col("filename").alias("c"))
    return usable.groupBy("component_id").agg(F.min_by(F.struct("filename", "packagetype", "size"), rank).alias("f")).select("component_id", "f.*")


def digest_of(content: Column, algorithm: Column) -> Column:
    """The artifact's digest in the recorded algorithm."""
    return (
        F.when(algorithm == "sha256", F.sha2(content, 256))
        .when(algorithm == "sha1", F.sha1(content))
        .when(algorithm.startswith("sha512-"), subresource_integrity(content, "sha512"))
        .when(algorithm.startswith("sha256-"), subresource_integrity(content, "sha256"))
        .when(algorithm.startswith("sha1-"), subresource_integrity(content, "sha1"))
    )


def check_artifacts(artifacts: DataFrame, checksums: DataFrame) -> DataFrame:
    """artifacts with `recorded` and `matched`: a checksum counts only where there is one; Maven's are compared without case."""
    c = checksums.select("purl", F.col("digest").alias("recorded"))
    same = F.when(F.col("purl").startswith("pkg:maven/"), F.lower("recorded") == F.lower("digest")).otherwise(F.col("recorded") == F.col("digest"))
    return artifacts.join(c, "purl", "left").withColumn("matched", F.coalesce(same & (F.col("digest") != ""), F.lit(False)))


def ancestry(docs: DataFrame, most: int = POM_ANCESTRY) -> DataFrame:
    """(gav, chain array<gav>): each POM and its ancestors, nearest first, up to the first that declares, at most `most` of them. Missing ancestors
    and cycles end a chain.

    Pointers are doubled: after each join a chain is twice as long, so `most` takes log2(most) joins. Chains that have ended join by their own name
    behind a mark that no name has, so that they don't meet in one partition; a parent of very many is one row on its side."""
    walk = docs.select("gav", F.array("gav").alias("chain"), F.when(~F.col("declares"), F.col("parent")).alias("next"))
    reach = 1
    while reach < most:
        onward = walk.select(F.col("gav").alias("at"), F.col("chain").alias("further"), F.col("next").alias("then"))
        joined = walk.withColumn("key", F.coalesce("next", F.concat(F.lit("\0"), "gav"))).join(onward, F.col("key") == F.col("at"), "left")
        walk = joined.select("gav", F.when(F.col("at").isNull(), F.col("chain")).otherwise(F.concat("chain", "further")).alias("chain"), F.col("then").alias("next"))
        reach *= 2
        if reach < most:  # each step reads the one before it twice
            walk = materialise(walk, "ancestry")
    # In a cycle the names that come again are all that follow.
    return walk.select("gav", F.slice(F.array_distinct("chain"), 1, most).alias("chain"))


def inherited_terms(poms: DataFrame) -> DataFrame:
    """(gav, license): each POM's own licence, or its nearest ancestor's, '' without one. poms(gav, parent, license)."""
    docs = poms.select("gav", "parent", (F.coalesce("license", F.lit("")) != "").alias("declares"))
    last = ancestry(docs).select("gav", F.element_at("chain", -1).alias("last"))
    return last.join(poms.select(F.col("gav").alias("last"), "license"), "last").select("gav", F.coalesce("license", F.lit("")).alias("license"))


def sink_bundles(bundles: DataFrame, path: str) -> None:
    """Writes encoded records, one line each, with their digests beside them as Parquet."""
    bundles.select("component_id", "bundle", "bundle_digest").write.mode("errorifexists").parquet(path)


def go_dirhash(files: Column) -> Column:
    """h1: of a module's array<struct<path, content>>: SHA-256 over sorted lines of hash and name."""
    lines = F.transform(F.sort_array(F.transform(files, lambda f: F.struct(f["path"].alias("path"), F.sha2(f["content"], 256).alias("h")))), lambda x: F.concat(x["h"], F.lit("  "), x["path"], F.lit("\n")))
    return F.concat(F.lit("h1:"), F.regexp_replace(F.base64(F.unhex(F.sha2(F.array_join(lines, ""), 256))), r"\s", ""))
