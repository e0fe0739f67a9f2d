"""Line dedup against levelled runs: a line that an earlier document holds goes, however far apart the two are.

A run is a table of line keys, dealt into buckets by key and sorted in each, that no other run shares a key with. Documents come in batches, in
the order of their ids. The keys of a batch are anti-joined to every run by merging, bucket by bucket and without an exchange of the runs; what
is left is new, and becomes a run of level 0. FANOUT runs of a level are compacted into one of the next, so a key is rewritten but a
logarithmic number of times and few runs are there to merge with.

A line's key is the line without white space at its ends and with A to Z in lower case; keys of fewer than `least` code points aren't compared. Keys travel
as 128 bits of MD5, lines and texts don't. A key goes in all documents but the one of the smallest id among those that hold it; there all of its
lines stay. A hot key is one row after the combining on the map side; where lines meet their keys again, the adaptive skewed join splits it.

Null and empty texts are one empty line. Rows that share an id are one document. Null ids are one document, after all others. Rows alike in
everything give alike rows. Texts of any length are compared whole; kept lines are put together from slices, in time linear in the lines. An
empty table gives an empty one; further columns aren't read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import WHITE, forget, save, scratch_dir

LEAST, BATCHES, FANOUT, BUCKET_LINES, LEAST_BUCKETS, FILE_DOCS, LEAST_FILES = 10, 6, 3, 2_000_000, 6, 1_000_000, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = (1 << 63) - 1


def line_keys(text: Column, least: int = LEAST) -> Column:
    """array<binary>: the key of each line, null for a line that isn't compared."""
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    stripped = F.transform(F.split(lower, "\n"), lambda line: F.btrim(line, F.lit(WHITE)))
    return F.transform(stripped, lambda line: F.when(F.char_length(line) >= least, F.unhex(F.md5(line))))


class Runs:
    """Sorted runs of keys, by level. All are bucketed alike."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def write(self, keys: DataFrame) -> str:
        """keys(key, first, last), one row a key, as a bucketed table; each task writes the bucket that it has."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = f"{scratch_dir(self.spark)}/{name}"
        keys.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", self.paths[name]).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        gone = self.spark.range(0)
        gone.saved_at = self.paths.pop(name)
        forget(gone)

    def admit(self, keys: DataFrame) -> DataFrame:
        """Adds the keys that no run holds yet, as a run of their own; returns keys(key, first, last) with `held`, whether one did."""
        batch = self.write(keys)
        new = self.spark.table(batch)
        for run in (r for level in self.levels for r in level):
            new = new.join(self.spark.table(run).hint("merge"), "key", "left_anti")
        mine = self.write(new)
        seen = self.spark.table(batch).join(self.spark.table(mine).select("key", F.lit(False).alias("held")).hint("merge"), "key", "left")
        judged = save(seen.withColumn("held", F.coalesce("held", F.lit(True))).where("held or first < last"), "line-repeated")
        self.drop(batch)
        self.add(mine, 0)
        return judged

    def add(self, run: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for r in full[1:]:
                merged = merged.unionByName(self.spark.table(r))
            self.add(self.write(merged), level + 1)
            for r in full:
                self.drop(r)

    def close(self) -> None:
        for run in [r for level in self.levels for r in level]:
            self.drop(run)
        self.levels = []


def repeated_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, row, gone array<int>): the places, from 0, of the lines that go; documents that lose none have no row. doc is the id, LAST for
    null; row tells texts of one id apart."""
    spark = docs.sparkSession
    given = identified(docs)
    quantiles = given.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    cuts = sorted(set(quantiles or []))
    batch = F.array_size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: F.col("doc") > c))
    keyed = save(given.select("doc", "row", batch.alias("batch"), line_keys(F.col("text"), least).alias("keys")), "line-keys")
    lines = keyed.agg(F.sum(F.array_size("keys"))).first()[0] or 0
    runs = Runs(spark, LEAST_BUCKETS + lines // BUCKET_LINES, fanout)
    gone = []
    for i in range(len(cuts) + 1):
        # Files whose batches are others are skipped by their least and greatest.
        each = keyed.where(F.col("batch") == i).select("doc", "row", F.posexplode("keys").alias("at", "key")).where("key is not null")
        judged = runs.admit(each.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
        hit = each.join(judged, "key").where(F.col("held") | (F.col("doc") > F.col("first")))
        gone.append(save(hit.groupBy("doc", "row").agg(F.array_sort(F.collect_set("at")).alias("gone")), "line-gone"))
        forget(judged)
    runs.close()
    forget(keyed)
    out = gone[0]
    for g in gone[1:]:
        out = out.unionByName(g)
    return out


def identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def dedup(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each document without the lines that a document of a smaller id holds."""
    gone = repeated_lines(docs, least, batches, fanout)
    # Lines are split below the join, so that no expression over them splits the text anew.
    split = identified(docs).select("doc_id", "doc", "row", F.split("text", "\n").alias("lines"))
    joined = split.join(gone, ["doc", "row"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    n = F.array_size("lines")
    between = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(n)), lambda a, b: F.slice("lines", a + 2, b - a - 1))
    kept = F.when(F.array_size("gone") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.flatten(between), "\n"))
    return joined.select("doc_id", n.cast("long").alias("n_lines"), F.array_size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))


ORACLE = rf"""with d as (select *, coalesce(doc_id, {LAST}) as doc, coalesce(text, '') as t, row_number() over () as r from documents),
l as (select r, doc, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as place from d),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') as key from l),
f as (select key, min(doc) as first from k where length(key) >= {LEAST} group by key),
j as (select k.*, coalesce(k.doc > f.first, false) as gone from k left join f using (key)),
o as (select r, count(*) as n_lines, count(*) filter (where gone) as n_dropped, coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '') as kept from j group by r)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from d join o using (r)"""
