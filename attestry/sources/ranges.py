"""Archives where they lie: members read by ranges, so that no task holds more of an artifact than one member.

staged(component_id, name, uri, prefix) names archives in a file system that all executors reach. Of a zip its directory at the end is read first; the members to
be retained are then dealt over tasks by place, and each is read by its own range. A tar.gz has no directory, so one task reads it as a stream, a piece
at a time. The bounds and the rules of sources.archives hold; an archive that breaks one is a row with its error and has no other."""

from __future__ import annotations

import errno
import io
import struct
import tarfile
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.sources.archives import DAMAGED, MAX_ENTRIES, MAX_RETAINED, TAR_SUFFIXES, ZIP_SUFFIXES, Refused, _Bounded, _retained, clean_member
from attestry.sources.scratch import materialise

#: Packed bytes for each task that reads members.
TASK_BYTES, LEAST_TASKS = 64 << 20, 4
PLACES = "component_id string, archive string, uri string, prefix string, path string, raw string, at bigint, packed bigint, size bigint, method int, crc bigint, error string"
MEMBERS = "component_id string, archive string, path string, content binary, error string"


class _File(io.RawIOBase):
    """A file of any file system; a place before its begin is an OSError, as the standard library's readers expect."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (self.file.tell() if whence == 1 else self.file.size() if whence == 2 else 0)
        if at < 0:
            raise OSError(errno.EINVAL, "a place before the file")
        return self.file.seek(at)

    def read(self, n: int = -1) -> bytes:
        return self.file.read(None if n is None or n < 0 else n)

    def close(self) -> None:
        self.file.close()
        super().close()


def _open(uri: str) -> _File:
    return _File(uri)


def _chosen(names: list[tuple[str, object]], prefix: str) -> list[tuple[str, object]]:
    """(clean path, member) of those to be retained: the ones under the prefix, or all if none is."""
    keep, prefix = _retained(), prefix.strip("/") + "/" if prefix.strip("/") else ""
    clean = [(clean_member(n), m) for n, m in names]
    inside = [(p[len(prefix) :], m) for p, m in clean if p and p.startswith(prefix)]
    return [(p, m) for p, m in (inside or [x for x in clean if x[0]]) if keep(p)]


def _directory(uri: str, prefix: str) -> list[tuple]:
    with _open(uri) as f, zipfile.ZipFile(f) as z:
        infos = [i for i in z.infolist() if not i.is_dir() and (i.external_attr >> 28) in (0, 8)]
    if len(infos) > MAX_ENTRIES:
        raise Refused("it has too many entries")
    chosen = _chosen([(i.filename, i) for i in infos], prefix)
    if sum(i.file_size for _, i in chosen) > MAX_RETAINED:
        raise Refused("it retains more than the bound")
    if any(i.flag_bits & 1 for _, i in chosen):
        raise Refused("it is encrypted")
    return [(p, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for p, i in chosen]


def places(staged: DataFrame) -> DataFrame:
    """One row a member to be read, with its range; one for a whole tar.gz, method -1; one for an archive that can't be read, with its error."""

    def run(batches):
        for b in batches:
            for cid, name, uri, prefix in zip(*(b.column(i).to_pylist() for i in range(4))):
                prefix = prefix or ""
                head, none = (cid, name, uri, prefix), (None,) * 7
                try:
                    lower = (name or "").lower()
                    if lower.endswith(ZIP_SUFFIXES):
                        rows = [(*head, *m, None) for m in _directory(uri, prefix)]
                    elif lower.endswith(TAR_SUFFIXES):
                        rows = [(*head, None, None, 0, 0, 0, -1, 0, None)]
                    else:
                        raise Refused(f"{name} is no archive that can be read")
                except DAMAGED as e:
                    rows = [(*head, *none, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.string()] * 6, *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.string()))], [c.split(" ")[0] for c in PLACES.split(", ")])

    return staged.select("component_id", "name", "uri", "prefix").mapInArrow(run, PLACES)


def _member(uri: str, raw: str, at: int, packed: int, size: int, method: int, crc: int) -> bytes:
    with _open(uri) as f:
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):  # rarer ways of packing are the library's
            with zipfile.ZipFile(f) as z:
                return z.read(raw)
        f.seek(at)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise Refused(f"{raw} isn't where the directory says")
        f.seek(at + 30 + sum(struct.unpack("<HH", head[26:30])))
        body = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        inflate = zlib.decompressobj(-15)
        body = inflate.decompress(body, size + 1)
    if len(body) != size or zlib.crc32(body) != crc:
        raise Refused(f"{raw} isn't what the directory says")
    return body


def _streamed(uri: str, prefix: str):
    """(path, content) of a tar.gz. Names are only known as they come, so members outside of the prefix are held back until one is met inside."""
    keep, prefix = _retained(), prefix.strip("/") + "/" if prefix.strip("/") else ""
    entries = total = 0
    outside, met = [], not prefix
    with _open(uri) as f, tarfile.open(fileobj=(unpacked := _Bounded(f)), mode="r|") as t:
        for m in t:
            entries += 1
            if entries > MAX_ENTRIES:
                raise Refused("it has too many entries")
            path = clean_member(m.name) if m.isreg() else ""
            inside = path.startswith(prefix)
            if not path or (met and not inside):
                continue
            if inside and not met:
                met, outside, total = True, [], 0
            name = path[len(prefix) :] if inside else path
            if not keep(name):
                continue
            body = t.extractfile(m).read(MAX_RETAINED + 1)
            total += len(body)
            if total > MAX_RETAINED:
                raise Refused("it retains more than the bound")
            if inside:
                yield name, body
            else:
                outside.append((name, body))
        unpacked.finish()
    yield from outside


def expand_ranges(staged: DataFrame) -> DataFrame:
    """(component_id, path, content, size_bytes, read_error), as archives.expand_all gives them of contents."""
    found = materialise(places(staged), "archive-places")
    packed = found.agg(F.sum("packed")).first()[0] or 0
    dealt = found.where("error is null").repartition(LEAST_TASKS + packed // TASK_BYTES, "uri", "at")

    def run(batches):
        schema = pa.schema([("component_id", pa.string()), ("archive", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        one = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
        for b in batches:
            for r in b.to_pylist():
                try:
                    if r["method"] == -1:
                        for path, body in _streamed(r["uri"], r["prefix"]):
                            yield one(r["component_id"], r["archive"], path, body, None)
                    else:
                        yield one(r["component_id"], r["archive"], r["path"], _member(*(r[c] for c in ("uri", "raw", "at", "packed", "size", "method", "crc"))), None)
                except DAMAGED as e:
                    yield one(r["component_id"], r["archive"], None, None, f"{type(e).__name__}: {e}")

    key = ["component_id", "archive"]
    read = materialise(dealt.mapInArrow(run, MEMBERS), "archive-members")
    by_path = read.where("error is null").groupBy(*key, "path").agg(F.min(F.sha2("content", 256)).alias("lo"), F.max(F.sha2("content", 256)).alias("hi")).where("lo <> hi")
    twice = by_path.select(*key, F.concat(F.lit("Refused: "), "path", F.lit(" is there twice with different content")).alias("error"))
    bad = found.select(*key, "error").unionByName(read.select(*key, "error")).where("error is not null").unionByName(twice).groupBy(*key).agg(F.min("error").alias("error"))
    good = read.where("error is null").join(bad, key, "left_anti").dropDuplicates([*key, "path"])
    files = good.select("component_id", "path", "content", F.octet_length("content").cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("read_error"))
    return files.unionByName(bad.select("component_id", F.col("archive").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("size_bytes"), F.col("error").alias("read_error")))
