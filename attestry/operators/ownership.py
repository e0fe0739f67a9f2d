"""Whose file is whose: vendored roots, nested ownership, content hashes, verification. Prefix tests are equi-joins on ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import digests, paths


def owners(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files(component_id, path, ...) with `root`, the deepest of roots(component_id, root) above it, null if none."""
    above = files.select("component_id", "path", F.explode(paths.ancestors(F.col("path"))).alias("root"))
    owned = above.join(roots.select("component_id", "root").distinct(), ["component_id", "root"]).groupBy("component_id", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.join(owned, ["component_id", "path"], "left")


def vendored_roots(components: DataFrame, files: DataFrame) -> DataFrame:
    """components(component_id, purl, name, vendor_root) that have licence files under vendor_root/name, with that root."""
    wanted = components.where("name <> '' and vendor_root <> ''").withColumn("root", F.concat(F.regexp_replace("vendor_root", r"/\z", ""), F.lit("/"), F.col("name")))
    above = files.where(paths.is_terms_file(F.col("path"))).select("component_id", F.explode(paths.ancestors(F.col("path"))).alias("root")).distinct()
    return wanted.join(above, ["component_id", "root"], "left_semi")


def component_hashes(components: DataFrame, files: DataFrame) -> DataFrame:
    """(component_id, terms_content_hash, files, error): a component without files has the empty set's hash. One with a file that
    can't be read has no key at all, as any would stand for another set; `error` names the first such file."""
    covered = files.where(paths.is_terms_file(F.col("path"))).select("component_id", "path", digests.file_digest(F.col("content")).alias("digest"), F.when(F.col("read_error").isNotNull(), F.concat("path", F.lit(": "), "read_error")).alias("e"))
    hashed = covered.groupBy("component_id").agg(digests.content_hash_agg(F.col("path"), F.col("digest")).alias("h"), F.count(F.lit(1)).alias("n"), F.min("e").alias("error"))
    empty = digests.content_hash(F.array().cast("array<struct<path:string,digest:string>>"))
    return components.select("component_id").join(hashed, "component_id", "left").select("component_id", F.when(F.col("error").isNull(), F.coalesce("h", empty)).alias("terms_content_hash"), F.coalesce("n", F.lit(0)).cast("long").alias("files"), "error")


def own_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Licence files that are the component's own: in nobody else's tree and under no vendored root."""
    mine = owners(files.where(paths.is_terms_file(F.col("path"))), roots).where("root is null").drop("root")
    return mine.where(~paths.belongs_to_another(paths.exclusion(F.col("path"))))


def vendored_hashes(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(component_id, root, terms_content_hash): by path below the root, without what a deeper root owns."""
    owned = owners(files.where(paths.is_terms_file(F.col("path"))), roots).where("root is not null")
    relative = F.expr("substring(path, length(root) + 2)")
    records = owned.select("component_id", "root", relative.alias("path"), digests.file_digest(F.col("content")).alias("digest"))
    return records.groupBy("component_id", "root").agg(digests.content_hash_agg(F.col("path"), F.col("digest")).alias("terms_content_hash"))


def verify(local: DataFrame, published: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(purl, verdict, reason) of local(purl, path, digest) against published(purl, path, digest, ord): every local file must be there
    with its content; the first by path that isn't gives the reason. Of a path published twice the last counts. Nothing published is no
    pass for a copy that has files; a copy without files is pristine. `asked`(purl), if given, names all copies, else local and published do."""
    there = published.groupBy("purl", "path").agg(F.max_by("digest", "ord").alias("published"))
    some = published.select("purl").distinct().withColumn("some", F.lit(True))
    joined = local.join(there, ["purl", "path"], "left")
    fault = F.when(F.col("published").isNull(), F.concat(F.col("path"), F.lit(" is not published"))).when(F.col("published") != F.col("digest"), F.concat(F.col("path"), F.lit(" differs")))
    first = joined.withColumn("fault", fault).groupBy("purl").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("path"))).alias("fault"), F.count(F.lit(1)).alias("files"))
    every = (asked if asked is not None else local.select("purl").unionByName(published.select("purl"))).select("purl").distinct()
    out = every.join(first, "purl", "left").join(some, "purl", "left")
    reason = F.when((F.coalesce("files", F.lit(0)) > 0) & F.col("some").isNull(), "nothing is published to compare with").otherwise(F.coalesce("fault", F.lit("")))
    return out.select("purl", F.when(reason == "", "pristine").otherwise("diverged").alias("verdict"), reason.alias("reason"))
