"""Maven artifacts from what an acquisition job has staged: POMs with their ancestors beside the jar's own files, either alone if need be.

poms(group_id, artifact_id, version, content): every POM that was fetched. staged(purl, ecosystem, name, version, recorded, file_name, content):
the components, content null where no jar is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import purl
from attestry.functions.text import empty_to_null, trim_space
from attestry.sources.archives import expand_all
from attestry.sources.scratch import materialise
from attestry.sources.staged import ancestry

_POM = "licenses struct<license:array<struct<name:string,url:string>>>, parent struct<groupId:string,artifactId:string,version:string>"
NO_JAR = "no jar is published for these coordinates; the declaration is that of the POMs alone"
NO_POM = "no POM is staged; the licensing is what the jar ships"


def gav(group: Column, artifact: Column, version: Column) -> Column:
    return F.concat_ws(":", group, artifact, version)


def documents(poms: DataFrame) -> DataFrame:
    """(gav, parent, declares, content): parent is null where a POM names none, leaves too much out or doesn't parse. A parent's group and version
    are the child's where they are left blank. Of POMs that share their coordinates one holds."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    read = poms.withColumn("d", F.from_xml(text, _POM))
    said = lambda c: empty_to_null(trim_space(F.coalesce(c, F.lit(""))))
    declares = F.exists(F.coalesce("d.licenses.license", F.array().cast("array<struct<name:string,url:string>>")), lambda x: said(x["name"]).isNotNull() | said(x["url"]).isNotNull())
    group, version = F.coalesce(said(F.col("d.parent.groupId")), said(F.col("group_id"))), F.coalesce(said(F.col("d.parent.version")), said(F.col("version")))
    artifact = said(F.col("d.parent.artifactId"))
    parent = F.when(artifact.isNotNull() & group.isNotNull() & version.isNotNull(), gav(group, artifact, version))
    out = read.select(gav(F.col("group_id"), F.col("artifact_id"), F.col("version")).alias("gav"), parent.alias("parent"), F.coalesce(declares, F.lit(False)).alias("declares"), "content")
    return out.groupBy("gav").agg(F.min(F.struct("content", "parent", "declares")).alias("x")).select("gav", "x.parent", "x.declares", "x.content")


def resolve(staged: DataFrame, poms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts, files): artifacts(purl, digest, digest_algo, matched, notes, error) has one row a component; files(component_id, path, content, size_bytes,
    read_error) holds pom.xml, pom-parent-1.xml and so on, and the jar's retained members. A component with neither POM nor jar is gone."""
    maven = staged.where(F.col("ecosystem") == "maven")
    c = purl.maven_coordinates(F.col("name"))
    blank = lambda x: F.coalesce(trim_space(x), F.lit("")) == ""
    whole = c.isNotNull() & ~blank(c["group_id"]) & ~blank(c["artifact_id"]) & ~blank(F.col("version"))
    asked = maven.withColumn("gav", F.when(whole, gav(c["group_id"], c["artifact_id"], F.col("version"))))
    # Each POM is parsed once and each chain made once; several branches read them.
    docs = materialise(documents(poms), "poms")
    found = materialise(asked.select("purl", "gav", "recorded", F.sha1("content").alias("digest")).join(ancestry(docs), "gav", "left"), "chains")
    has_pom, has_jar, complete = F.col("chain").isNotNull(), F.col("digest").isNotNull(), F.col("gav").isNotNull()
    # A checksum file holds the digest and sometimes a name.
    recorded = F.lower(F.coalesce(F.get(F.split(trim_space(F.coalesce("recorded", F.lit(""))), r"\p{IsWhite_Space}+"), F.lit(0)), F.lit("")))
    error = F.when(~complete, "group, artifact and version are needed").when(~has_pom & ~has_jar, "gone: there is neither a POM nor a jar")
    notes = F.filter(F.array(F.when(~has_jar, NO_JAR), F.when(~has_pom, NO_POM)), lambda n: n.isNotNull())
    none = F.expr("cast(array() as array<string>)")
    artifacts = found.select(
        "purl", F.when(error.isNull(), F.coalesce("digest", F.lit(""))).alias("digest"), F.when(error.isNull() & has_jar, "sha1").otherwise("").alias("digest_algo"), F.coalesce(complete & (recorded != "") & (recorded == F.col("digest")), F.lit(False)).alias("matched"),
        F.when(error.isNull(), notes).otherwise(none).alias("notes"), error.alias("error"),
    )
    links = found.select("purl", F.posexplode("chain").alias("depth", "gav"))
    name = F.when(F.col("depth") == 0, "pom.xml").otherwise(F.format_string("pom-parent-%d.xml", "depth"))
    of_poms = links.join(docs.select("gav", "content"), "gav").select(F.col("purl").alias("component_id"), name.alias("path"), "content", F.octet_length("content").cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("read_error"))
    jars = asked.where("gav is not null and content is not null").select(F.col("purl").alias("component_id"), F.coalesce("file_name", F.lit("artifact.jar")).alias("name"), "content", F.lit("").alias("prefix"))
    # A POM of the chain stands in place of a member of its name.
    members = expand_all(jars).where(~F.col("path").rlike(r"^pom(-parent-[0-9]+)?\.xml\z") | F.col("read_error").isNotNull())
    return artifacts, members.unionByName(of_poms)
