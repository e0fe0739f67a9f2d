"""Package addresses and coordinates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.text import trim_space


def _versioned(address: Column, version: Column) -> Column:
    return F.when(F.coalesce(version, F.lit("")) == "", address).otherwise(F.concat(address, F.lit("@"), version))


def golang(module: Column, version: Column) -> Column:
    return _versioned(F.concat(F.lit("pkg:golang/"), module), version)


def cargo(name: Column, version: Column) -> Column:
    return _versioned(F.concat(F.lit("pkg:cargo/"), name), version)


def normalize_pypi(name: Column) -> Column:
    return trim_space(F.lower(F.regexp_replace(name, "[-_.]+", "-")))


def pypi(name: Column, version: Column) -> Column:
    return _versioned(F.concat(F.lit("pkg:pypi/"), normalize_pypi(name)), version)


def maven(group: Column, artifact: Column, version: Column) -> Column:
    return _versioned(F.concat(F.lit("pkg:maven/"), group, F.lit("/"), artifact), version)


def maven_coordinates(name: Column) -> Column:
    """struct(group_id, artifact_id) of group:artifact; null without a colon."""
    cut = F.split(name, ":", 2)
    return F.when(F.size(cut) == 2, F.struct(F.get(cut, F.lit(0)).alias("group_id"), F.get(cut, F.lit(1)).alias("artifact_id")))


def path_escape(s: Column) -> Column:
    """Percent-encodes a path segment: form encoding, less what a path segment may hold."""
    out = F.url_encode(s)
    for escaped, plain in (("+", "%20"), ("%40", "@"), ("%3A", ":"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%7E", "~")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def npm(name: Column, version: Column) -> Column:
    """Both sides of the first slash are escaped; a scope's @ stays."""
    cut = F.split(name, "/", 2)
    address = F.when(F.size(cut) == 2, F.concat(path_escape(F.get(cut, F.lit(0))), F.lit("/"), path_escape(F.get(cut, F.lit(1))))).otherwise(path_escape(name))
    return _versioned(F.concat(F.lit("pkg:npm/"), address), version)


def npm_name_from_path(install_path: Column) -> Column:
    return F.substring_index(install_path, "node_modules/", -1)


# How a repository's address may begin, in the order in which beginnings go.
SCHEMES = ("https://", "http://", "git+https://", "ssh://", "git@")


def repository_path(repository: Column) -> Column:
    """host/path of a repository's address, whatever way it is cloned."""
    out = repository
    for scheme in SCHEMES:
        out = F.regexp_replace(out, "^" + re.escape(scheme), "")
    return F.regexp_replace(out, r"/\z", "")


def source(name: Column, version: Column, repository: Column, commit: Column) -> Column:
    """By the repository at a commit, or at the version; without a repository by the package's own name."""
    place = F.regexp_replace(repository_path(repository), r"\.git\z", "")
    at = F.when(F.coalesce(commit, F.lit("")) != "", commit).otherwise(version)
    return F.when(F.coalesce(repository, F.lit("")) == "", F.concat(F.lit("pkg:apk/"), name, F.lit("@"), version)).otherwise(F.concat(F.lit("pkg:generic/"), place, F.lit("@"), at))


def is_own_distribution(distribution: Column, own: Column) -> Column:
    return normalize_pypi(distribution) == normalize_pypi(F.regexp_replace(own, r"^py3(\.\d+)?-", ""))
