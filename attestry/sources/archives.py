"""Archives as rows: members of zip and tar.gz content, filtered by name before they are read, within bounds."""

from __future__ import annotations

import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import NAME_WEIGHTS, IGNORED_EXTENSIONS, MANIFESTS, PROSE

# Bounds on what one archive may hold.
MAX_ENTRIES, MAX_RETAINED, MAX_DECOMPRESSED, MAX_JAR = 100_000, 64 << 20, 1 << 30, 256 << 20
#: Members of small archives go on together: rows and bytes of content in a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
ZIP_SUFFIXES, TAR_SUFFIXES = (".zip", ".jar", ".whl", ".crate.zip"), (".tar.gz", ".tgz", ".crate")


class Refused(ValueError):
    """The archive breaks a bound or contradicts itself."""


#: What reading damaged archives raises, whatever they are packed with: ValueError takes in wrong UTF-8, OSError damaged bzip2 data.
DAMAGED = (Refused, zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError, ValueError, NotImplementedError, RuntimeError, struct.error)


@cache
def _retained():
    import re

    names = [re.compile(p.replace(r"\z", r"\Z"), re.I) for p, _ in NAME_WEIGHTS]
    prose, parent = re.compile(PROSE.replace("(?iu)", "").replace(r"\z", r"\Z"), re.I), re.compile(r"pom-parent-[1-7]\.xml")

    def keep(path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        ignored = dot >= 0 and name[dot:] in IGNORED_EXTENSIONS
        return (not ignored and any(p.search(name) for p in names)) or name in MANIFESTS or bool(parent.fullmatch(name)) or bool(prose.search(name))

    return keep


def clean_member(raw: str) -> str:
    """'' for absolute paths and ones that climb out."""
    p = raw.replace("\\", "/")
    parts = [x for x in p.split("/") if x not in ("", ".")]
    return "" if p.startswith("/") or ".." in parts or (len(p) > 1 and p[1] == ":") else "/".join(parts)


def _members(content: bytes, name: str):
    """(raw name, size or None, reader) of each regular member."""
    lower = name.lower()
    if lower.endswith(ZIP_SUFFIXES):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir() and (i.external_attr >> 28) in (0, 8):
                    yield i.filename, lambda i=i: z.open(i).read(MAX_RETAINED + 1)
        return
    if not lower.endswith(TAR_SUFFIXES):
        raise Refused(f"{name} is no archive that can be read")
    unpacked = _Bounded(io.BytesIO(content))
    with tarfile.open(fileobj=unpacked, mode="r|") as t:
        for m in t:
            if m.isreg():
                yield m.name, lambda m=m: t.extractfile(m).read(MAX_RETAINED + 1)
    unpacked.finish()


class _Bounded(io.RawIOBase):
    """Decompresses a gzip file as it is read, to a bound in all; of the file no more than a piece is held. A file that ends within a member was cut short;
    what follows its last member and is none is left out, as gzip does."""

    def __init__(self, source):
        self.source, self.inflate, self.left, self.ready, self.pending = source, zlib.decompressobj(31), MAX_DECOMPRESSED, b"", b""
        self.begun, self.members = False, 0

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        out = bytearray()
        while len(out) < n:
            if not self.ready:
                if self.inflate.eof:  # another member may follow
                    self.pending = self.inflate.unused_data + self.pending
                    self.inflate, self.begun, self.members = zlib.decompressobj(31), False, self.members + 1
                feed = self.inflate.unconsumed_tail
                if not feed:
                    feed, self.pending = self.pending or self.source.read(65536), b""
                if not feed and self.begun:
                    raise EOFError("the compressed file ends before its end is marked")
                if not feed or (self.members and not self.begun and not b"\x1f\x8b".startswith(feed[:2])):
                    break
                self.begun = True
                self.ready = self.inflate.decompress(feed, 1 << 20)
                self.left -= len(self.ready)
                if self.left < 0:
                    raise Refused("it decompresses to more than the bound")
                continue
            take = min(n - len(out), len(self.ready))
            out += self.ready[:take]
            self.ready = self.ready[take:]
        return bytes(out)

    def finish(self) -> None:
        """Reads what is left, so that a file that is cut short or damaged behind the last entry met is an error as well."""
        while self.read(1 << 20):
            pass


def expand(name: str, content: bytes, prefix: str = "") -> dict[str, bytes]:
    """The retained members by clean path. Members under `prefix` are the artifact; if none is, the prefix was wrong and all count."""
    keep, prefix = _retained(), prefix.strip("/") + "/" if prefix.strip("/") else ""
    found: dict[bool, dict[str, bytes]] = {True: {}, False: {}}
    any_inside, entries, total = False, 0, 0
    for raw, read in _members(content, name):
        entries += 1
        if entries > MAX_ENTRIES:
            raise Refused("it has too many entries")
        path = clean_member(raw)
        if not path:
            continue
        inside = not prefix or path.startswith(prefix)
        any_inside |= inside
        path = path[len(prefix) :] if inside else path
        if (any_inside and not inside) or not keep(path):
            continue
        body = read()
        total += len(body)
        if total > MAX_RETAINED:
            raise Refused("it retains more than the bound")
        if found[inside].setdefault(path, body) != body:
            raise Refused(f"{path} is there twice with different content")
    return found[any_inside]


def expand_all(archives: DataFrame) -> DataFrame:
    """(component_id, path, content, size_bytes, read_error) of (component_id, name, content, prefix); a refused archive is one row with its error.
    One that the caller refuses, by an `error` that isn't null, is such a row as well."""
    refused = F.col("error") if "error" in archives.columns else F.lit(None).cast("string")
    given = archives.select("component_id", "name", F.when(refused.isNull(), F.col("content")).alias("content"), F.coalesce(F.col("prefix"), F.lit("")).alias("prefix"), refused.alias("error"))

    def run(batches):
        schema = pa.schema([("component_id", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("size_bytes", pa.int64()), ("read_error", pa.string())])
        whole = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        rows, size, counted = [], 0, 0
        for b in batches:
            for cid, name, content, prefix, error in zip(*(b.column(i) for i in range(5))):
                cid, name = cid.as_py(), name.as_py()
                try:
                    if error.is_valid:
                        rows.append((cid, name or "", None, 0, error.as_py()))
                    else:
                        rows += ((cid, p, c, len(c), None) for p, c in sorted(expand(name or "", content.as_py() or b"", prefix.as_py()).items()))
                except DAMAGED as e:
                    rows.append((cid, name, None, 0, f"{type(e).__name__}: {e}"))
                size += sum(r[3] for r in rows[counted:])
                counted = len(rows)
                if counted >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield whole(rows)
                    rows, size, counted = [], 0, 0
        if rows:
            yield whole(rows)

    return given.mapInArrow(run, "component_id string, path string, content binary, size_bytes long, read_error string")


def jar_coordinates(jars: DataFrame) -> DataFrame:
    """(component_id, path, group_id, artifact_id, version) from every pom.properties of the jars in a files table; shaded jars give several."""
    given = jars.where(F.lower("path").endswith(".jar") & (F.col("size_bytes") <= MAX_JAR)).select("component_id", "path", "content")

    def run(batches):
        for b in batches:
            rows = []
            for cid, path, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for n in z.namelist():
                            if n.startswith("META-INF/maven/") and n.endswith("/pom.properties"):
                                lines = z.open(n).read(8 << 10).decode("utf-8", "replace").splitlines()
                                p = {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if "=" in x and not x.startswith("#"))}
                                if all(p.get(k) for k in ("groupId", "artifactId", "version")):
                                    rows.append((cid, path, p["groupId"], p["artifactId"], p["version"]))
                except DAMAGED:
                    rows.append((cid, path, None, None, None))  # a failure, for the caller to name
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["component_id", "path", "group_id", "artifact_id", "version"])

    return given.mapInArrow(run, "component_id string, path string, group_id string, artifact_id string, version string")
