"""Trees as rows: one file a row, of any number of components at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.paths import BUILD_OUTPUT, normalize_path

#: component_id, path, content, size_bytes, read_error.
FILES = "component_id string, path string, content binary, size_bytes bigint, read_error string"


def read_trees(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root/<component>/; the first directory names the component. Content is read only where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = len(root.split("://", 1)[-1].strip("/"))
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/+", "")
    tail = F.substring(bare, F.lit(prefix + 2), F.length(bare))
    return found.select(F.substring_index(tail, "/", 1).alias("component_id"), F.regexp_replace(tail, "^[^/]+/", "").alias("path"), "content", F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("read_error"))


def files_of(df: DataFrame) -> DataFrame:
    """A files table from (component_id, path, content): cleans paths, adds sizes."""
    out = df.withColumns({"path": F.regexp_replace(normalize_path(F.col("path")), r"^\./", ""), "content": F.col("content").cast("binary")})
    if "read_error" not in df.columns:
        out = out.withColumn("read_error", F.lit(None).cast("string"))
    return out.withColumn("size_bytes", F.coalesce(F.octet_length("content").cast("bigint"), F.lit(0).cast("bigint"))).select("component_id", "path", "content", "size_bytes", "read_error")


#: How documents stand in for trees: sixteen kinds of place, {} is the document's id.
TEMPLATES = (
    "LICENSE-{}", "COPYING-{}.md", "d{}/LICENSE", "docs/d{}/LICENSE.md", "vendor/m{}/LICENSE", "third_party/m{}/COPYING", "tests/t{}/LICENSE", BUILD_OUTPUT[0] + "/p{}/LICENSE",
    "node_modules/n{}/LICENSE.txt", "d{}/PATENTS", "tests/t{}/PATENTS", "n{}/README.md", "src/s{}.c", "src/s{}.py", "rust-1.86.0-src/r{}/COPYING", "license{}.go",
)


def document_trees(documents: DataFrame) -> DataFrame:
    """documents as files: the source is the component, the template follows from the id. No rows are left out."""
    k = F.pmod(F.floor(F.col("doc_id") / 20), F.lit(len(TEMPLATES))).cast("int")
    template = F.get(F.array(*(F.lit(t) for t in TEMPLATES)), k)
    path = F.replace(template, F.lit("{}"), F.col("doc_id").cast("string"))
    return documents.select(
        F.col("source").alias("component_id"), path.alias("path"), F.col("text").cast("binary").alias("content"), F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0).cast("bigint")).alias("size_bytes"),
        F.lit(None).cast("string").alias("read_error"), "doc_id",
    )
