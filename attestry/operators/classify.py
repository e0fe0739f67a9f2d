"""Which known texts a file contains: shingle containment against a corpus of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.sources.scratch import materialise

GRAM, THRESHOLD = 5, 0.9
#: Rows of corpus shingles that may be sent to every executor; a larger corpus is joined by exchange.
BROADCAST_GRAMS = 500_000
COPYRIGHT = r"(?im)^[^\w\n]*(copyright\b|\(c\)|all rights reserved)[^\n]*$"


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation; lines that only state a copyright don't count."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, " ")), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.btrim(plain), " "), lambda w: w != "")


def shingles(df: DataFrame, key: list[str], text: str, gram: int = GRAM) -> DataFrame:
    """(key..., g): distinct hashes of the word n-grams; a text of fewer words has one, of them all."""
    words = df.select(*key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    n = F.least(F.size("w"), F.lit(gram))
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, F.lit(gram)), " ")))
    grams = words.withColumn("g", F.when(F.size("w") > 0, F.array_distinct(hashes)))
    # An outer explode, filtered after: a filter that the optimizer moved below would tokenise each text again for every word.
    return grams.select(*key, F.explode_outer("g").alias("g")).where("g is not null")


def containment(files: DataFrame, key: list[str], corpus: DataFrame, text: str = "text", gram: int = GRAM) -> DataFrame:
    """(key..., id, confidence): the share of each corpus(id, text) entry's shingles found in a file. A file of several licences
    matches each of them. Only shingles of the corpus leave the scan: the join comes before any exchange of files' shingles."""
    known = materialise(shingles(corpus, ["id"], "text", gram), "corpus-shingles")
    sizes = known.groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    small = known.count() <= BROADCAST_GRAMS
    found = shingles(files, key, text, gram).join(F.broadcast(known) if small else known, "g")
    return found.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("hit")).join(F.broadcast(sizes) if small else sizes, "id").select(*key, "id", (F.col("hit") / F.col("total")).alias("confidence"))


def identify(files: DataFrame, key: list[str], corpus: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """containment() at or above the threshold."""
    return containment(files, key, corpus, text).where(F.col("confidence") >= threshold)


def matches_by_file(matches: DataFrame, key: list[str]) -> DataFrame:
    """(key..., matches array<struct<name, confidence>>), strongest first, ties by name."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col("id").alias("name"))))
    return matches.groupBy(*key).agg(best.alias("m")).select(*key, F.transform("m", lambda x: F.struct(x["name"].alias("name"), (-x["c"]).alias("confidence"))).alias("matches"))
