"""What manifests declare: JSON, TOML, XML, INI and header formats, one column each, and the per-ecosystem choice."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import paths
from attestry.functions.text import empty_to_null, trim_space
from attestry.operators.detection import MAX_MANIFEST

LICENSE_AND_FILE = T.StructType().add("license", "string").add("license_file", "string")
MAX_METADATA_HEADER, MAX_DECLARED = 64 << 10, 120


def join_choice(values: Column) -> Column:
    """Blank entries dropped, the rest joined as a choice."""
    return F.array_join(F.filter(F.transform(values, lambda v: trim_space(F.coalesce(v, F.lit("")))), lambda v: v != ""), " OR ")


def _json_field(doc: Column, field: str) -> Column:
    """A string, an array of strings, an object with type or url, or an array of those; told apart by the value's own kind."""
    value = F.try_variant_get(doc, f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    named = lambda x: F.coalesce(empty_to_null(trim_space(F.coalesce(x["type"], F.lit("")))), trim_space(F.coalesce(x["url"], F.lit(""))))
    one = F.try_variant_get(value, "$", "struct<type:string,url:string>")
    many = F.try_variant_get(value, "$", "array<struct<type:string,url:string>>")
    return (
        F.when(kind == "STRING", trim_space(F.try_variant_get(value, "$", "string")))
        .when(kind.startswith("ARRAY<STRING"), join_choice(F.try_variant_get(value, "$", "array<string>")))
        .when(kind.startswith("OBJECT"), named(one))
        .when(kind.startswith("ARRAY<OBJECT"), join_choice(F.transform(many, named)))
        .otherwise("")
    )


def package_json_terms(content: Column) -> Column:
    doc = F.try_parse_json(content)
    return F.coalesce(empty_to_null(_json_field(doc, "license")), _json_field(doc, "licenses"), F.lit(""))


def _said(value) -> str:
    return value.strip() if isinstance(value, str) else ""


def _table(doc, key: str) -> dict:
    return doc[key] if isinstance(doc, dict) and isinstance(doc.get(key), dict) else {}


def cargo_terms(doc: dict) -> tuple[str, str]:
    """The declared licence, else the file named in its place."""
    package = _table(doc, "package")
    declared = _said(package.get("license"))
    return (declared, "") if declared else ("", _said(package.get("license-file")))


def pyproject_terms(doc: dict) -> tuple[str, str]:
    """The project table's licence as text or table, else poetry's."""
    value = _table(doc, "project").get("license")
    if _said(value):
        return _said(value), ""
    if isinstance(value, dict) and (_said(value.get("text")) or _said(value.get("file"))):
        return (_said(value["text"]), "") if _said(value.get("text")) else ("", _said(value["file"]))
    return _said(_table(_table(doc, "tool"), "poetry").get("license")), ""


@F.pandas_udf(LICENSE_AND_FILE)
def toml_terms(name: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Spark reads no TOML. What isn't text or doesn't parse declares nothing."""

    def one(name, content):
        try:
            doc = tomllib.loads(bytes(content or b"").decode("utf-8"))
        except (ValueError, RecursionError):
            return "", ""
        return (cargo_terms if name == "Cargo.toml" else pyproject_terms)(doc)

    return pd.DataFrame([one(n, c) for n, c in zip(name, content)], columns=["license", "license_file"])


def setup_cfg_terms(content: Column) -> Column:
    """The value may stand on a later line than its key; `file:` in lower case names a file instead."""
    white = r"[\t\n\f\r ]"
    value = trim_space(F.regexp_extract(content, rf"(?dmi)^{white}*license(?:_expression)?{white}*={white}*(.+?){white}*$", 1))
    return F.when(value.startswith("file:"), "").otherwise(value)


def metadata_headers(content: Column) -> Column:
    """map<lower-case key, value> of the header block: first value of a key, folded lines skipped."""
    head = F.substring(content.cast("binary"), 1, MAX_METADATA_HEADER).cast("string")
    block = F.get(F.split(F.replace(head, F.lit("\r\n"), F.lit("\n")), r"\n[\t ]*(?:\n|\z)", 2), F.lit(0))
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")) & ~x.rlike(r"^[\t ]"))
    pairs = F.transform(lines, lambda x: F.struct(trim_space(F.lower(F.substring_index(x, ":", 1))).alias("key"), trim_space(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == (i + 1))
    return F.map_from_entries(first)


def metadata_terms(content: Column) -> Column:
    headers = metadata_headers(content)
    expression, legacy = (F.coalesce(F.try_element_at(headers, F.lit(k)), F.lit("")) for k in ("license-expression", "license"))
    return F.when(expression != "", expression).when(F.octet_length(legacy) > MAX_DECLARED, "").otherwise(legacy)


def pom_terms(content: Column) -> Column:
    """Each entry's name, else its address, as a choice."""
    doc = F.from_xml(content, "licenses struct<license:array<struct<name:string,url:string>>>")
    entries = F.transform(doc["licenses"]["license"], lambda x: F.coalesce(empty_to_null(trim_space(F.coalesce(x["name"], F.lit("")))), x["url"], F.lit("")))
    return F.coalesce(join_choice(entries), F.lit(""))


TOML = ("Cargo.toml", "pyproject.toml")


def is_manifest() -> Column:
    """Of a files table: a manifest at the top that can be read."""
    name = F.col("path")
    return (paths.depth(name) == 0) & paths.is_manifest_file(name) & (F.col("size_bytes") <= MAX_MANIFEST) & F.col("read_error").isNull()


def manifest(name: Column, content: Column) -> Column:
    """struct<ecosystem, license, license_file> of a manifest: each is read by its own reader, TOML ones alone outside of the JVM."""
    # Bytes that are no UTF-8 don't get further than here.
    text = F.make_valid_utf8(content.cast("string"))
    ecosystem = F.when(name == "package.json", "npm").when(name == "go.mod", "golang").when(name == "Cargo.toml", "cargo").when(name.startswith("pom"), "maven").otherwise("pypi")
    toml = toml_terms(name, F.when(name.isin(*TOML), content))
    declared = (
        F.when(name == "package.json", package_json_terms(text)).when(name == "setup.cfg", setup_cfg_terms(text)).when(name.startswith("pom"), pom_terms(text))
        .when(name.isin("METADATA", "PKG-INFO"), metadata_terms(text)).when(name.isin(*TOML), toml["license"]).otherwise("")
    )
    return F.struct(ecosystem.alias("ecosystem"), F.coalesce(declared, F.lit("")).alias("license"), F.coalesce(F.when(name.isin(*TOML), toml["license_file"]), F.lit("")).alias("license_file"))


def manifests(files: DataFrame) -> DataFrame:
    """(component_id, path, ecosystem, license, license_file) of top-level manifests, those that declare nothing included."""
    return files.where(is_manifest()).withColumn("m", manifest(F.col("path"), F.col("content"))).select("component_id", "path", "m.*")


def declared_terms(found: DataFrame) -> DataFrame:
    """(component_id, ecosystem, license): the first manifest of each ecosystem that declares one; of POMs the nearest."""
    nearness = F.struct(F.coalesce(F.regexp_extract("path", r"pom-parent-(\d)", 1), F.lit("")).alias("a"), F.col("path").alias("b"))
    return found.where("license <> ''").groupBy("component_id", "ecosystem").agg(F.min_by("license", nearness).alias("license"))
