"""Finding and reading licence files, notices and prose over whole fleets of trees; every per-component loop is a window or an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.functions import paths
from attestry.functions.spdx import header_grant, tag
from attestry.functions.text import head_bytes, trim_space
from attestry.operators.notices import header_grants
from attestry.operators.notices import headers as headers_of
from attestry.sources.scratch import materialise

# Bounds.
MAX_TEXT_BYTES, MAX_NOTICE_FILES, MAX_NOTICE_BYTES, MAX_HINTS, MAX_EXCERPT, MAX_MANIFEST = 131072, 24, 2048, 10, 300, 4 << 20
# Wordings that leave the choice of licence to the user.
CHOICE = (
    r"\bat your option\b", r"\bat the user'?s option\b", r"\b(dual|tri|triple|quad|multi)[\s-]*licen[sc]ed\b", r"\bunder either\b",
    r"\byour choice\b", r"\bchoice of (either|any|the following)\b", r"\bany of the following licen[sc]es\b",
)


def discover(files: DataFrame, scope: str = "tree") -> DataFrame:
    """Licence files with weight and exclusion; `project` scope keeps to the top. Names decide before any content is read."""
    found = files.withColumn("weight", paths.terms_weight(F.col("path"))).where("weight is not null")
    if scope == "project":
        found = found.where(~paths.outside_project(F.col("path")))
    bonus = F.when(paths.depth(F.col("path")) == 0, F.lit(paths.ROOT_BONUS)).otherwise(0.0)
    return found.withColumns({"weight": F.col("weight") + bonus, "excluded": paths.exclusion(F.col("path"))})


def ordered(candidates: DataFrame) -> DataFrame:
    """Adds `ord`, the place in discovery order within the component: weight down, path up."""
    return candidates.withColumn("ord", F.row_number().over(Window.partitionBy("component_id").orderBy(F.desc("weight"), "path")))


def with_declarations(candidates: DataFrame, declarations: DataFrame) -> DataFrame:
    """Full outer join of candidates(component_id, path, weight, excluded) and declarations(component_id, path, license, ord): the last
    declaration of a path holds, and one for a file that discovery didn't find is a candidate of weight 0."""
    latest = declarations.groupBy("component_id", "path").agg(F.max_by("license", "ord").alias("declared"))
    both = candidates.join(latest, ["component_id", "path"], "full_outer")
    return both.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "excluded": F.coalesce("excluded", paths.exclusion(F.col("path")))})


def is_prose() -> Column:
    """Of a files table: prose at the top that can be read."""
    return (paths.depth(F.col("path")) == 0) & paths.is_prose_file(F.col("path")) & F.col("read_error").isNull()


def hints(content: Column) -> Column:
    """array<struct<line, excerpt>>: the first lines of a text that mention a licence."""
    trimmed = F.transform(F.split(content.cast("string"), "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), trim_space(x).alias("excerpt")))
    first = F.slice(F.filter(trimmed, lambda x: x["excerpt"].rlike(paths.LICENSE_MENTION)), 1, MAX_HINTS)
    cut = lambda x: F.when(F.octet_length(x) > MAX_EXCERPT, F.concat(F.make_valid_utf8(head_bytes(x, MAX_EXCERPT).cast("string")), F.lit("..."))).otherwise(F.make_valid_utf8(x))
    return F.transform(first, lambda x: F.struct(x["line"].alias("line"), cut(x["excerpt"]).alias("excerpt")))


def prose_hints(files: DataFrame) -> DataFrame:
    """(component_id, path, line, excerpt): the first lines of top-level prose files that mention a licence."""
    return files.where(is_prose()).select("component_id", "path", F.explode(hints(F.col("content"))).alias("h")).select("component_id", "path", "h.*")


def is_choice(excerpt: Column) -> Column:
    out = F.lit(False)
    for pattern in CHOICE:
        out = out | excerpt.rlike("(?iu)" + pattern)
    return out


def choice_of_terms(hints: DataFrame) -> DataFrame:
    """(component_id, excerpt): the first hint that states a choice."""
    return hints.where(is_choice(F.col("excerpt"))).groupBy("component_id").agg(F.min_by("excerpt", F.struct("path", "line")).alias("excerpt"))


def notice_paths(files: DataFrame) -> DataFrame:
    """(component_id, path, i): an even sample of source files: the places that a fixed stride gives over the sorted paths. Paths alone are numbered: they
    are exchanged by range and numbered within tasks, so a component of very many sources is several tasks' work; one count a task and component is added up."""
    p = F.col("path")
    candidates = files.where(paths.is_notice_source(p) & (paths.dir_exclusion(paths.directory(p)) == "") & ~paths.is_terms_file(p)).select("component_id", "path")
    by_range = candidates.repartitionByRange("component_id", "path").sortWithinPartitions("component_id", "path").withColumn("at", F.monotonically_increasing_id())
    placed = materialise(by_range.withColumn("task", F.shiftright("at", 33)), "notice-paths")
    counts = placed.groupBy("component_id", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    component = Window.partitionBy("component_id")
    begins = counts.select("component_id", "task", "first", (F.sum("m").over(component.orderBy("task")) - F.col("m")).alias("begin"), F.sum("m").over(component).alias("n"))
    numbered = placed.join(begins, ["component_id", "task"]).withColumn("i", (F.col("begin") + F.col("at") - F.col("first")).cast("int"))
    stride = F.when(F.col("n") > MAX_NOTICE_FILES, F.floor(F.col("n") / MAX_NOTICE_FILES)).otherwise(1)
    return numbered.where(F.col("i") % stride == 0).select("component_id", "path", "i")


def notice_heads(read: DataFrame) -> DataFrame:
    """(component_id, path, text, nth, truncated) of (component_id, path, i, head, size_bytes, read_error): at most MAX_NOTICE_FILES of the sampled files; those that are
    empty, can't be read or hold a zero byte make way for the next."""
    good = read.where(F.col("read_error").isNull() & (F.octet_length("head") > 0) & ~F.contains(F.col("head").cast("string"), F.lit("\0")))
    kept = good.withColumn("nth", F.row_number().over(Window.partitionBy("component_id").orderBy("i"))).where(F.col("nth") <= MAX_NOTICE_FILES)
    return kept.select("component_id", "path", F.col("head").cast("string").alias("text"), F.col("nth").cast("long").alias("nth"), (F.col("size_bytes") > MAX_NOTICE_BYTES).alias("truncated"))


def notice_sample(files: DataFrame) -> DataFrame:
    """(component_id, path, text, nth, truncated): an even sample of source files by path, at most MAX_NOTICE_FILES readable ones."""
    # Of files that are no sources not even the head goes into the join.
    heads = files.where(paths.is_notice_source(F.col("path"))).select("component_id", "path", head_bytes(F.col("content"), MAX_NOTICE_BYTES).alias("head"), "size_bytes", "read_error")
    return notice_heads(heads.join(notice_paths(files), ["component_id", "path"]))


def grants(notices: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(component_id, expression, source, path, files) of (component_id, path, text, nth): the tag of each notice, else what the first of `headers`
    (operators.notices) found in it grants; the first place in notice order is kept."""
    key = ["component_id", "path", "nth"]
    read = notices.withColumn("tag", tag(F.col("text")))
    tagged = read.where("tag is not null").select(*key, F.col("tag").alias("expression"), F.lit("spdx-tag").alias("source"))
    wordings = headers_of(notices.sparkSession) if headers is None else headers
    worded = header_grants(read.where("tag is null"), key, wordings, header_grant).withColumn("source", F.lit("header"))
    return (
        tagged.unionByName(worded).groupBy("component_id", "expression").agg(F.min_by(F.struct("source", "path"), F.struct("nth", "path")).alias("first"), F.count(F.lit(1)).alias("files"))
        .select("component_id", "expression", "first.source", "first.path", F.col("files").cast("long").alias("files"))
    )
