"""From files and their matches to one conclusion a component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.functions import spdx
from attestry.functions.paths import depth

CONFIDENT = 0.9


def identifier_of(name: Column) -> Column:
    """The identifier by which a match counts: resolved, or the base whose grant is open, or the reference."""
    r = spdx.normalize(name)
    return F.coalesce(r["id"], r["grant_base"], r["ref"])


def prefer_root(files: DataFrame) -> DataFrame:
    """Where a component has an in-scope file at the top, even an unreadable one, only such files count."""
    in_scope = files.where("excluded = ''").withColumn("root", depth(F.col("path")) == 0)
    any_root = F.max(F.col("root").cast("int")).over(Window.partitionBy("component_id"))
    return in_scope.withColumn("any_root", any_root).where("root or any_root = 0").drop("root", "any_root")


def grant_for(only: Column, or_later: Column, granted: Column) -> tuple[Column, Column]:
    """(the granted expression, how many distinct ones apply) given the expressions that notices grant."""
    hits = F.array_sort(F.array_distinct(F.filter(granted, lambda g: (g == only) | (g == or_later))))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))), F.size(hits)


def conclude(components: DataFrame, files: DataFrame, granted: DataFrame) -> DataFrame:
    """One row for each of components(component_id): expression, reason, identifiers, grant_basis, '' for what is absent.

    files(component_id, path, excluded, size_bytes, read_error, names array of confident match names);
    granted(component_id, expressions array, sampled)."""
    readable = prefer_root(files).where("read_error is null")
    named = readable.withColumn("ids", F.array_sort(F.array_distinct(F.transform(F.coalesce("names", F.array().cast("array<string>")), identifier_of))))
    per = named.groupBy("component_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("identifiers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("names", F.array().cast("array<string>")))))).alias("names"),
        F.coalesce(F.bool_or((F.size("ids") == 0) & (F.col("size_bytes") > 0)), F.lit(False)).alias("unrecognized"),
    )
    df = components.select("component_id").join(per, "component_id", "left").join(granted, "component_id", "left")
    none = F.array().cast("array<string>")
    df = df.withColumns({"identifiers": F.coalesce("identifiers", none), "expressions": F.coalesce("expressions", none), "sampled": F.coalesce("sampled", F.lit(0)), "unrecognized": F.coalesce("unrecognized", F.lit(False))})
    settled = settle(F.col("identifiers"), F.col("unrecognized"), F.col("expressions"), F.col("sampled"))
    return df.select("component_id", *(settled[c].alias(c) for c in ("expression", "reason")), "identifiers", settled["grant_basis"].alias("grant_basis"), "unrecognized")


def settle(identifiers: Column, unrecognized: Column, granted: Column, sampled: Column) -> dict[str, Column]:
    """expression, reason and grant_basis of a component's identifiers, given what its notices grant and how many were read."""
    # The one identifier is resolved anew, so a base that lost its exception resolves without it.
    r = spdx.normalize(F.get(identifiers, F.lit(0)))
    expr, hits = grant_for(r["only"], r["or_later"], granted)
    one = F.size(identifiers) == 1
    needs = one & r["grant_base"].isNotNull()
    reason = (
        F.when((F.size(identifiers) == 0) & unrecognized, "unrecognized-license-text")
        .when(F.size(identifiers) == 0, "no-license-text")
        .when(F.size(identifiers) > 1, "several-licenses")
        .when(needs & (hits > 1), "grant-undecided")
        .otherwise("")
    )
    expression = F.when(one & ~needs, F.get(identifiers, F.lit(0))).when(needs & (hits == 1), expr).when(needs & (hits == 0), r["only"]).otherwise("")
    basis = F.when(~needs, "").when(hits == 1, "notice").when(hits > 1, "mixed").when(sampled > 0, "absent").otherwise("unknown")
    return {"expression": expression, "reason": reason, "grant_basis": basis}


def reference_of(files: DataFrame) -> DataFrame:
    """(component_id, license_ref): from the first in-scope file, in discovery order, that nothing recognised."""
    from attestry.functions.digests import license_ref

    open_files = prefer_root(files).where("read_error is null and size_bytes > 0 and size(coalesce(names, array())) = 0")
    return open_files.groupBy("component_id").agg(F.min_by("text", F.struct((-F.col("weight")).alias("w"), F.col("path"))).alias("text")).select("component_id", license_ref(F.col("text")).alias("license_ref"))
