"""How complete and how conclusive a component's evidence is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a declaration without text, prose alone, and a stated choice are worth; the confidence that counts.
MANIFEST_CREDIT, PROSE_CREDIT, CHOICE_CREDIT, CONFIDENT = 0.8, 0.5, 0.95, 0.9
# Fixed value: what stands in a file's place of a name where nothing matched.
NO_ASSERTION = "NOASSERTION"
_NONE = "cast(array() as array<string>)"


def assess(inputs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a component of inputs(component_id, files array<struct<path, license, confidence, excluded, err, ids>>, manifest_terms,
    manifest_sets array<array<string>> (the names in each manifest that parses), has_manifest, has_prose, states_choice,
    declared array<string>, incomplete int): score and its three terms, flags joined by commas, unknown, relationship.

    files are in discovery order; ids are a file's confident identifiers. `keep` names columns of inputs to pass on."""
    df = inputs.withColumn("scope", F.filter("files", lambda f: f["excluded"] == ""))
    df = df.withColumns(
        {
            "total": F.size("scope"),
            "readable": F.size(F.filter("scope", lambda f: F.coalesce(f["err"], F.lit("")) == "")),
            "resolved": F.size(F.filter("scope", lambda f: F.size(F.coalesce(f["ids"], F.expr(_NONE))) > 0)),
            "detected": F.array_sort(F.array_distinct(F.flatten(F.transform("scope", lambda f: F.coalesce(f["ids"], F.expr(_NONE)))))),
            "best": F.array_max(F.transform(F.filter("scope", lambda f: ~F.coalesce(f["license"], F.lit("")).isin("", NO_ASSERTION)), lambda f: f["confidence"])),
        }
    )
    failed = F.col("total") - F.col("readable")
    unknown = (F.col("readable") == 0) & ~F.col("has_manifest") & ~F.col("has_prose") & ((F.col("incomplete") > 0) | (failed > 0))
    df = df.withColumn("unknown", unknown)
    known = lambda c: F.when(F.col("unknown"), F.lit(0.0)).otherwise(c)
    project = F.coalesce("best", F.when(F.coalesce("manifest_terms", F.lit("")) != "", F.lit(MANIFEST_CREDIT)), F.when(F.col("has_prose"), F.lit(PROSE_CREDIT)), F.lit(0.0))
    resolution = F.when(F.col("total") == 0, 1.0).otherwise(F.col("resolved") / F.col("total"))
    composed = F.exists(F.coalesce("manifest_sets", F.array().cast("array<array<string>>")), lambda s: F.size(F.array_except(F.col("detected"), s)) == 0)
    relation = F.when((F.size("detected") < 2) | composed, 1.0).when(F.col("states_choice"), F.lit(CHOICE_CREDIT)).otherwise(0.0)
    df = df.withColumns({"project_license": known(project), "text_resolution": known(resolution), "relation": known(relation)})
    declared = F.array_sort(F.array_distinct(F.coalesce("declared", F.expr(_NONE))))
    detail = F.format_string(
        "project %.2f; text resolution %.2f, %d of %d classified; relation %.2f; score %.2f", "project_license", "text_resolution", "resolved", "total", "relation", F.col("project_license") * F.col("text_resolution") * F.col("relation")
    )
    nothing = F.when(F.col("incomplete") > 0, F.format_string("no evidence: %d gaps", "incomplete")).otherwise(F.format_string("no evidence: none of %d files could be read", "total"))
    flags = F.array(
        F.when((F.size(declared) > 0) & (F.size("detected") > 0) & (declared != F.col("detected")), "declared-conflict"),
        F.when(F.col("relation") == 0, "relationship-ambiguous"),
        F.when(F.col("resolved") < F.col("total"), "unidentified-text"),
    )
    return df.select(
        "component_id", (F.col("project_license") * F.col("text_resolution") * F.col("relation")).alias("score"), "project_license", "text_resolution", "relation",
        F.when(F.col("unknown"), "").otherwise(F.array_join(F.filter(flags, lambda f: f.isNotNull()), ",")).alias("flags"), "unknown",
        F.when(~F.col("unknown") & (F.size("detected") >= 2) & (F.col("relation") == F.lit(CHOICE_CREDIT)), "OR").otherwise("").alias("relationship"), F.col("total").cast("long").alias("license_files"),
        F.when(F.col("unknown"), nothing).otherwise(detail).alias("rationale"), F.col("detected").alias("detected"), *keep,
    )
