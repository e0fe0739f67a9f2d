"""Durable digests: line-ending-normalised SHA-256, the content hash of a set of files, and reference names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME, REF_SCHEME, REF_CHARS = "v1", "v1", 16


def normalized_hex(content: Column) -> Column:
    """SHA-256 of the bytes with each CRLF made LF; a lone CR stays."""
    return F.sha2(F.replace(content.cast("string"), F.lit("\r\n"), F.lit("\n")), 256)


def file_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), normalized_hex(content))


def framed(records: Column) -> Column:
    """Length-prefixed records in bytewise order, from array<struct<path, digest>>; no separators, duplicates kept."""
    def one(x: Column) -> Column:
        return F.concat(F.octet_length(x["path"]).cast("string"), F.lit(":"), x["path"], F.octet_length(x["digest"]).cast("string"), F.lit(":"), x["digest"])

    return F.array_join(F.transform(F.sort_array(records), one), "")


def content_hash(records: Column) -> Column:
    """The key of a set of files; null and empty sets hash the empty string."""
    return F.concat(F.lit(SCHEME + "-"), F.sha2(F.coalesce(framed(records), F.lit("")), 256))


def content_hash_agg(path: Column, digest: Column) -> Column:
    """The same as an aggregate over rows: only paths and digests are gathered, never contents."""
    return content_hash(F.collect_list(F.struct(path.alias("path"), digest.alias("digest"))))


def patch_set_digest(records: Column) -> Column:
    """'' for no patches."""
    return F.when(F.size(F.coalesce(records, F.array().cast("array<struct<path:string,digest:string>>"))) == 0, "").otherwise(F.concat(F.lit("sha256:"), F.sha2(F.replace(framed(records), F.lit("\r\n"), F.lit("\n")), 256)))


def license_ref(text: Column) -> Column:
    """The reference name of a text that no identifier names; '' for empty text."""
    return F.when(F.octet_length(text) == 0, "").otherwise(F.concat(F.lit(f"LicenseRef-{REF_SCHEME}-"), F.substring(normalized_hex(text), 1, REF_CHARS)))


def subresource_integrity(content: Column, algorithm: str = "sha512") -> Column:
    """algorithm-base64; Spark wraps base64 at 76 characters, so line ends go."""
    raw = {"sha512": F.unhex(F.sha2(content, 512)), "sha256": F.unhex(F.sha2(content, 256)), "sha1": F.unhex(F.sha1(content))}[algorithm]
    return F.concat(F.lit(algorithm + "-"), F.regexp_replace(F.base64(raw), r"\s", ""))
