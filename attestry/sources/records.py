"""What registries say of an artifact, as an acquisition job has staged their answers: recorded checksums in three forms, and a release's index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import empty_to_null, trim_space

_RELEASE = "urls array<struct<filename:string,url:string,packagetype:string,size:bigint,digests:struct<sha256:string>>>"
NO_PARSE, GONE = "the record doesn't parse", "gone: the release has no archive to download"


def _text(body: Column) -> Column:
    return F.make_valid_utf8(F.coalesce(body.cast("string"), F.lit("")))


def _fields(line: Column) -> Column:
    return F.filter(F.split(line, r"\p{IsWhite_Space}+"), lambda f: f != "")


def recorded_checksums(records: DataFrame) -> DataFrame:
    """(purl, recorded, error) of records(purl, ecosystem, name, version, body): the line of a module's content in a checksum database's answer, the checksum of a
    crate's record, the digest in a file beside a jar. '' where the record has none; an error where there is no such record."""
    eco, text = F.col("ecosystem"), _text(F.col("body"))
    lines = F.transform(F.split(text, "\n"), _fields)
    mine = F.filter(lines, lambda f: (F.size(f) == 3) & (F.get(f, F.lit(0)) == F.col("name")) & (F.get(f, F.lit(1)) == F.col("version")))
    doc = F.try_parse_json(text)
    crate = F.try_variant_get(doc, "$.version.checksum", "string")
    found = F.when(eco == "golang", F.get(F.get(mine, F.lit(0)), F.lit(2))).when(eco == "cargo", crate).when(eco == "maven", F.lower(F.get(_fields(text), F.lit(0))))
    error = F.when(~F.coalesce(eco.isin("golang", "cargo", "maven"), F.lit(False)), F.concat(F.lit("no checksum record for "), F.coalesce(eco, F.lit("an unnamed ecosystem")))).when((eco == "cargo") & doc.isNull(), NO_PARSE)
    return records.select("purl", F.when(error.isNull(), F.coalesce(found, F.lit(""))).alias("recorded"), error.alias("error"))


def release_archives(releases: DataFrame) -> DataFrame:
    """(purl, filename, url, recorded, error) of releases(purl, body), a release's entry in an index: its first source archive, else the smallest wheel, ties by name."""
    text = _text(F.col("body"))
    read = releases.select("purl", F.try_parse_json(text).isNull().alias("bad"), F.coalesce(F.from_json(text, _RELEASE)["urls"], F.expr("cast(array() as array<struct<filename:string,url:string,packagetype:string,size:bigint,digests:struct<sha256:string>>>)")).alias("urls"))
    wheel = lambda f: F.lower(F.coalesce(f["filename"], F.lit(""))).endswith(".whl") | (f["packagetype"] == "bdist_wheel")
    source = F.get(F.filter("urls", lambda f: f["packagetype"] == "sdist"), F.lit(0))
    ranked = F.transform(F.filter("urls", lambda f: F.coalesce(wheel(f), F.lit(False))), lambda f: F.struct(F.coalesce(f["size"], F.lit(0)).alias("size"), f["filename"].alias("name"), f.alias("f")))
    best = read.withColumn("f", F.coalesce(source, F.array_min(ranked)["f"]))
    error = F.when(F.col("bad"), NO_PARSE).when(F.col("f").isNull(), GONE)
    return best.select("purl", "f.filename", "f.url", empty_to_null(trim_space(F.coalesce("f.digests.sha256", F.lit("")))).alias("recorded"), error.alias("error"))
