"""Names to identifiers by a dimension: each distinct name is looked up once, in a vocabulary of any size.

A name has up to four keys (as it stands, in lower case, as an address, as a wording); the dimension has rows of (space, key, rank) and what they stand
for. One equi-join meets them and the lowest rank holds: names that stay references, listed identifiers, bases whose grant is open, names that classifiers
use, addresses, listed names, wordings. The same answers as functions.spdx.normalize, which folds a small vocabulary into the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import spdx
from attestry.functions.text import empty_to_null, trim_space
from attestry.functions.vocabulary import CLASSIFIER_NAMES, SYNONYMS, UNLISTED, Vocabulary

ENTRY = "space string, key string, rank int, id string, grant_base string, only string, or_later string"
#: Ranks in the order in which they decide.
REFERENCE, LISTED, GRANT, CLASSIFIER, ADDRESS, NAME, WORDING = range(7)
#: Rows of a dimension that may be sent to every executor; a larger one is joined by exchange.
BROADCAST_ENTRIES = 1_000_000


def _rows(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """What is fixed: references, grants, classifiers' names and wordings."""
    none = (None, None, None)
    rows = [("exact", n, REFERENCE, None, *none) for n in UNLISTED] + [("exact", k, CLASSIFIER, v, *none) for k, v in CLASSIFIER_NAMES.items()] + [("text", k, WORDING, v, *none) for k, v in SYNONYMS.items()]
    return spark.createDataFrame(rows + [("exact", n, GRANT, None, *g) for n, g in vocabulary.grants.items()], ENTRY)


def built_in(spark: SparkSession, vocabulary: Vocabulary = spdx.VOCABULARY) -> DataFrame:
    """The dimension of a vocabulary held in memory."""
    none = (None, None, None)
    rows = [("lower", k, LISTED, v, *none) for k, v in vocabulary.current.items()] + [("url", k, ADDRESS, v, *none) for k, v in vocabulary.addresses.items()] + [("text", k, NAME, v, *none) for k, v in vocabulary.names.items()]
    return spark.createDataFrame(rows, ENTRY).unionByName(_rows(spark, vocabulary))


def dimension(entries: DataFrame) -> DataFrame:
    """The dimension of a published list entries(licenseId, name, isDeprecatedLicenseId, seeAlso array<string>): entries that are no longer current name nothing, and an
    address or a name of two identifiers names neither."""
    spark = entries.sparkSession
    now = entries.where(~F.coalesce(F.col("isDeprecatedLicenseId"), F.lit(False)) & F.col("licenseId").isNotNull())
    key = lambda space, rank, k: F.struct(F.lit(space).alias("space"), k.alias("key"), F.lit(rank).alias("rank"))
    urls = F.transform(F.coalesce("seeAlso", F.array().cast("array<string>")), lambda u: key("url", ADDRESS, spdx.normalize_url(u)))
    own = F.array(key("lower", LISTED, F.lower("licenseId")), key("text", NAME, spdx.normalize_text(F.coalesce("name", F.lit("")))))
    each = now.select(F.col("licenseId").alias("id"), F.explode(F.concat(own, urls)).alias("k")).select("id", "k.*").where("coalesce(key, '') <> ''")
    one = each.groupBy("space", "key", "rank").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    listed = one.select("space", "key", "rank", "id", *(F.lit(None).cast("string").alias(c) for c in ("grant_base", "only", "or_later")))
    return listed.unionByName(_rows(spark, spdx.VOCABULARY))


def keys_of(name: Column) -> Column:
    t = trim_space(name)
    of = lambda space, k: F.struct(F.lit(space).alias("space"), k.alias("key"))
    return F.array(of("exact", t), of("lower", F.lower(t)), of("url", spdx.normalize_url(t)), of("text", spdx.normalize_text(t)))


def resolve(df: DataFrame, column: str, dimension_: DataFrame, out: str = "resolved") -> DataFrame:
    """df with `out`, struct(id, grant_base, only, or_later, ref): exactly one of id, grant_base and ref is set, none for a blank name; null for null."""
    small = dimension_.count() <= BROADCAST_ENTRIES
    distinct = df.select(F.col(column).alias("__name")).where("__name is not null").distinct()
    asked = distinct.select("__name", F.explode(keys_of(F.col("__name"))).alias("k")).select("__name", "k.*").where("key <> ''")
    met = asked.join(F.broadcast(dimension_) if small else dimension_, ["space", "key"])
    first = met.groupBy("__name").agg(F.min_by(F.struct("id", "grant_base", "only", "or_later"), F.col("rank")).alias("x"))
    found = distinct.join(first, "__name", "left")
    ref = F.when(F.col("x.id").isNull() & F.col("x.grant_base").isNull(), empty_to_null(trim_space(F.col("__name"))))
    named = found.select("__name", F.struct("x.id", "x.grant_base", "x.only", "x.or_later", ref.alias("ref")).alias(out))
    return df.join(named, df[column] == named["__name"], "left").drop("__name")
