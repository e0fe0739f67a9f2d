"""Readers of staged artifacts: what each ecosystem calls its archives, nests in them, and hashes them by.

An acquisition job stages one row an artifact, with the lockfile's digest beside the bytes, so that no join carries contents:
staged(purl, ecosystem, name, version, recorded, file_name, content)."""

from __future__ import annotations

import base64
import hashlib
import io
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import digests, paths
from attestry.functions.digests import subresource_integrity
from attestry.functions.text import trim_space
from attestry.operators import ownership
from attestry.sources.archives import DAMAGED, MAX_ENTRIES, expand_all

# Fixed value: the largest artifact that is taken, unless the caller says otherwise.
MAX_ARTIFACT = 1 << 30


@F.pandas_udf(T.StringType())
def zip_dirhash(content: pd.Series) -> pd.Series:
    """h1: of every member of a zip, retained or not, read in chunks; null for one that can't be read."""

    def one(body):
        if body is None:
            return None
        lines = []
        try:
            with zipfile.ZipFile(io.BytesIO(body)) as z:
                members = sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename)
                if len(members) > MAX_ENTRIES or any("\n" in i.filename for i in members):
                    return None
                for i in members:
                    h = hashlib.sha256()
                    with z.open(i) as f:
                        while chunk := f.read(1 << 20):
                            h.update(chunk)
                    lines.append(f"{h.hexdigest()}  {i.filename}\n")
        except DAMAGED:
            return None
        return "h1:" + base64.b64encode(hashlib.sha256("".join(lines).encode()).digest()).decode()

    return content.map(one)


def lockfile_integrity(content: Column, recorded: Column) -> Column:
    """In the algorithm that the lockfile used, sha512 where nothing is recorded; null for an algorithm that isn't known."""
    algorithm = F.when(F.contains(recorded, F.lit("-")), F.substring_index(recorded, "-", 1)).otherwise("sha512")
    return F.coalesce(*(F.when(algorithm == a, subresource_integrity(content, a)) for a in ("sha512", "sha256", "sha1")))


@dataclass(frozen=True)
class Reader:
    """How one ecosystem's artifacts are read. `digest` takes (content, recorded), content null in rows of others, `prefix` (name, version, file name)."""

    ecosystem: str
    algorithm: str
    digest: Callable[[Column, Column], Column]
    prefix: Callable[[Column, Column, Column], Column]
    suffixes: tuple[str, ...]


def _without_suffix(file_name: Column) -> Column:
    """A source archive nests in its own name; a wheel doesn't nest."""
    return F.when(file_name.endswith(".whl"), "").otherwise(F.regexp_replace(file_name, r"\.(tar\.gz|zip)\z", ""))


READERS = (
    Reader("golang", "h1", lambda c, r: zip_dirhash(c), lambda n, v, f: F.concat(n, F.lit("@"), v), (".zip",)),
    Reader("cargo", "sha256", lambda c, r: F.sha2(c, 256), lambda n, v, f: F.concat(n, F.lit("-"), v), (".crate",)),
    Reader("pypi", "sha256", lambda c, r: F.sha2(c, 256), lambda n, v, f: _without_suffix(f), (".whl", ".tar.gz", ".zip")),
    Reader("maven", "sha1", lambda c, r: F.sha1(c), lambda n, v, f: F.lit(""), (".jar",)),
    Reader("npm", "npm-integrity", lockfile_integrity, lambda n, v, f: F.lit("package"), (".tgz",)),
)


def readers(*more: Reader) -> dict[str, Reader]:
    """By ecosystem; of several readers for one the last holds."""
    return {r.ecosystem: r for r in (*READERS, *more)}


def _refusal(by: dict[str, Reader], max_bytes: int) -> Column:
    """Why a row isn't read; null where it is."""
    eco, name, size = F.col("ecosystem"), F.coalesce("file_name", F.lit("")), F.octet_length("content")
    suffix = F.coalesce(*(F.when((eco == e) & F.array_contains(F.transform(F.array(*map(F.lit, r.suffixes)), lambda s: name.endswith(s)), True), True) for e, r in by.items()), F.lit(False))
    return (
        F.when(~F.coalesce(eco.isin(*by), F.lit(False)), F.concat(F.lit("no reader for "), F.coalesce(eco, F.lit("an unnamed ecosystem"))))
        .when((F.coalesce("name", F.lit("")) == "") | (F.coalesce("version", F.lit("")) == ""), "a name and a version are needed")
        .when(F.col("content").isNull(), "nothing is staged").when(size > max_bytes, "larger than the bound").when(~suffix, F.concat(F.lit("not an archive of its kind: "), name))
    )


def artifacts(staged: DataFrame, by: dict[str, Reader] | None = None, max_bytes: int = MAX_ARTIFACT) -> DataFrame:
    """(purl, ecosystem, digest, digest_algo, matched, error): each artifact's digest in its ecosystem's algorithm, and whether it is the
    recorded one. Without a recorded digest nothing matches; Maven's are compared without case."""
    by = by or readers()
    rows = staged.withColumn("error", _refusal(by, max_bytes))
    good, eco = F.col("error").isNull(), F.col("ecosystem")
    recorded = trim_space(F.coalesce("recorded", F.lit("")))
    # One pass over the artifacts: each reader sees its own rows' contents and null for others, so Python gets those of module zips alone.
    own = lambda e: good & (eco == e)
    one = lambda of: F.coalesce(*(F.when(own(e), of(e, r)) for e, r in by.items()))
    done = rows.withColumns({"digest": one(lambda e, r: r.digest(F.when(own(e), F.col("content")), recorded)), "digest_algo": one(lambda e, r: F.lit(r.algorithm))})
    same = F.when(eco == "maven", F.lower(recorded) == F.lower("digest")).otherwise(recorded == F.col("digest"))
    done = done.withColumns({"matched": F.coalesce((recorded != "") & same, F.lit(False)), "error": F.coalesce("error", F.when(F.col("digest").isNull(), "it can't be hashed"))})
    return done.select("purl", "ecosystem", "digest", "digest_algo", "matched", "error")


def published_files(staged: DataFrame, by: dict[str, Reader] | None = None, max_bytes: int = MAX_ARTIFACT) -> DataFrame:
    """The retained members as a files table, component_id being the purl; an artifact that isn't read is a row with its error."""
    by = by or readers()
    rows = staged.withColumn("error", _refusal(by, max_bytes))
    prefix = F.coalesce(*(F.when(F.col("ecosystem") == e, r.prefix(F.col("name"), F.col("version"), F.col("file_name"))) for e, r in by.items()), F.lit(""))
    return expand_all(rows.select(F.col("purl").alias("component_id"), F.col("file_name").alias("name"), "content", prefix.alias("prefix"), "error"))


def local_files(files: DataFrame, vendored: DataFrame) -> DataFrame:
    """(component_id, purl, path, digest): each vendored copy's own files by name, below its root, less what a deeper root owns."""
    owned = ownership.owners(files.where(paths.is_terms_file(F.col("path"))).select("component_id", "path", digests.file_digest(F.col("content")).alias("digest")), vendored).where("root is not null")
    return owned.join(vendored.select("component_id", "purl", "root").distinct(), ["component_id", "root"]).select("component_id", "purl", F.expr("substring(path, length(root) + 2)").alias("path"), "digest")


def verified_copies(files: DataFrame, vendored: DataFrame, staged: DataFrame, by: dict[str, Reader] | None = None) -> DataFrame:
    """(purl, verdict, reason) of every copy that the trees hold. One purl vendored into several trees is verified over all of them: a
    path below its root counts by its first digest that isn't the published one."""
    local = local_files(files, vendored).select("purl", "path", "digest").distinct()
    there = published_files(staged, by).where(F.col("read_error").isNull() & paths.is_terms_file(F.col("path"))).select(F.col("component_id").alias("purl"), "path", digests.file_digest(F.col("content")).alias("digest"), F.lit(0).alias("ord"))
    return ownership.verify(local, there, vendored.select("purl"))


def unrecognised_text(files: DataFrame) -> DataFrame:
    """(component_id, path, text, error): the first in-scope file, in discovery order, whose text nothing recognised. A text that wasn't
    retained is an error, as its name would be that of the empty text. files as in conclude.reference_of."""
    from attestry.operators.conclude import prefer_root

    waiting = prefer_root(files).where("read_error is null and size_bytes > 0 and size(coalesce(names, array())) = 0")
    first = waiting.groupBy("component_id").agg(F.min_by(F.struct("path", F.coalesce("text", F.lit("")).alias("text")), F.struct((-F.col("weight")).alias("w"), F.col("path"))).alias("f"))
    return first.select("component_id", "f.path", F.nullif(F.col("f.text"), F.lit("")).alias("text"), F.when(F.col("f.text") == "", F.concat(F.lit("the text of "), F.col("f.path"), F.lit(" wasn't retained"))).alias("error"))


def corpus_of(spark, folder: str) -> DataFrame:
    """corpus(id, text) from a folder of <identifier>.txt, to add to a classifier's own texts."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return found.select(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.txt\z", "").alias("id"), F.col("content").cast("string").alias("text"))


def by_role(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, installed) of a files table with tree_role, as evidence.collect takes them."""
    return tuple(files.where(F.col("tree_role") == role).drop("tree_role") for role in ("source", "installed"))
