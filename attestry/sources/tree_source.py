"""Directory trees as a data source: one row a file, and one for each directory or file that can't be read.

    spark.dataSource.register(TreeSource)
    spark.read.format("attestry_tree").option("components", "a,b").load("file:///fleet")

The first directory below the root names the component. The driver lists only the upper `split` levels (components alone, unless more are asked for, as for
one huge tree); each directory of the last one is a partition that one task walks. Filters on component_id and on the path's beginning or end reach the source: partitions and files that can't pass are neither listed nor
read. `names` (shell patterns, joined by commas) limits which files' contents are read; the others are rows without content. Any file system that Arrow
opens by its address will do; links are followed where they stay below their component, as far as the file system has any.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from attestry.sources.trees import FILES

#: Bytes of content in a batch, levels that the driver lists, and bytes beyond which a file's content isn't read.
BATCH_BYTES, SPLIT, MAX_BYTES = 2 << 20, 1, 256 << 20
SCHEMA = pa.schema([("component_id", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("size_bytes", pa.int64()), ("read_error", pa.string())])


@dataclass
class Subtree(InputPartition):
    """A directory below a component, '' for the component itself; `deep` walks on below it, else its own files alone are read."""

    component: str
    directory: str
    deep: bool
    error: str | None = None


class TreeReader(DataSourceReader):
    def __init__(self, options):
        root = options.get("path")
        if not root:
            raise ValueError("a tree source needs a path")
        self.root = root
        self.wanted = [c for c in options.get("components", "").split(",") if c] or None
        self.names = [n for n in options.get("names", "").split(",") if n]
        self.split = int(options.get("split", SPLIT))
        self.max_bytes = int(options.get("maxBytes", MAX_BYTES))
        self.only: set[str] | None = None
        self.begins: list[str] = []
        self.ends: list[str] = []
        self.exact: set[str] | None = None

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return _system(self.root if "://" in self.root else "file://" + os.path.abspath(self.root))

    def pushFilters(self, filters: list[Filter]):
        """Takes what tests of component_id and path it can; Spark still evaluates all of them."""
        for f in filters:
            match f:
                case EqualTo(("component_id",), value):
                    self.only = {value} & (self.only or {value})
                case In(("component_id",), values):
                    self.only = set(values) & (self.only or set(values))
                case EqualTo(("path",), value):
                    self.exact = {value} & (self.exact or {value})
                case In(("path",), values):
                    self.exact = set(values) & (self.exact or set(values))
                case StringStartsWith(("path",), value):
                    self.begins.append(value)
                case StringEndsWith(("path",), value):
                    self.ends.append(value)
            yield f

    def listed(self, at: str) -> list[fs.FileInfo]:
        """The entries of one directory in order."""
        system, _ = self._opened()
        found = system.get_file_info(fs.FileSelector(at))
        found.sort(key=lambda i: i.base_name)
        return found

    def partitions(self) -> list[Subtree]:
        _, root = self._opened()
        components = self.wanted or [i.base_name for i in self.listed(root) if i.type == fs.FileType.Directory]
        out: list[Subtree] = []
        for c in sorted(set(components)):
            if self.only is None or c in self.only:
                self._planned(f"{root}/{c}", c, "", 1, out)
        return out

    def _planned(self, base: str, component: str, directory: str, level: int, out: list[Subtree]) -> None:
        if level >= self.split:
            out.append(Subtree(component, directory, True))
            return
        try:
            below = [i for i in self.listed(f"{base}/{directory}".rstrip("/")) if i.type == fs.FileType.Directory]
        except OSError as e:
            out.append(Subtree(component, directory, False, _said(e)))
            return
        out.append(Subtree(component, directory, False))
        for i in below:
            path = f"{directory}/{i.base_name}".lstrip("/")
            if self._may_hold(path) and self._inside(base, path):
                self._planned(base, component, path, level + 1, out)

    def _may_hold(self, directory: str) -> bool:
        """Whether a path below the directory can pass the tests of beginnings and names."""
        d = directory + "/"
        return all(d.startswith(b) or b.startswith(d) for b in self.begins) and (self.exact is None or any(p.startswith(d) for p in self.exact))

    def _passes(self, path: str) -> bool:
        return all(path.startswith(b) for b in self.begins) and all(path.endswith(e) for e in self.ends) and (self.exact is None or path in self.exact)

    def _inside(self, base: str, path: str) -> bool:
        """Links that lead out of the component aren't followed, nor those that lead back to what holds them."""
        if not isinstance(self._opened()[0], fs.LocalFileSystem):
            return True
        top, real = os.path.realpath(base), os.path.realpath(f"{base}/{path}")
        parents = {os.path.realpath(os.path.join(base, *path.split("/")[:n])) for n in range(len(path.split("/")))}
        return real.startswith(top + os.sep) and real not in parents

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        _, root = self._opened()
        rows, size = [], 0
        for row in self._rows(f"{root}/{partition.component}", partition):
            rows.append(row)
            size += len(row[2] or b"") + 200
            if size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, base: str, part: Subtree):
        waiting = [part.directory]
        if part.error is not None:
            yield part.component, part.directory + "/", None, 0, part.error
            return
        while waiting:
            directory = waiting.pop()
            try:
                entries = self.listed(f"{base}/{directory}".rstrip("/"))
            except OSError as e:
                yield part.component, directory + "/", None, 0, _said(e)
                continue
            for i in entries:
                path = f"{directory}/{i.base_name}".lstrip("/")
                if i.type == fs.FileType.Directory:
                    if part.deep and self._may_hold(path) and self._inside(base, path):
                        waiting.append(path)
                elif i.type == fs.FileType.File and self._passes(path) and self._inside(base, path):
                    yield self._file(base, part.component, path, i.size or 0)

    def _file(self, base: str, component: str, path: str, size: int):
        name = path.rsplit("/", 1)[-1]
        if size > self.max_bytes or (self.names and not any(fnmatch.fnmatchcase(name, n) for n in self.names)):
            return component, path, None, size, "larger than the bound" if size > self.max_bytes else None
        try:
            with self._opened()[0].open_input_stream(f"{base}/{path}", compression=None) as f:
                return component, path, f.read(), size, None
        except OSError as e:
            return component, path, None, size, _said(e)


@cache
def _system(uri: str) -> tuple[fs.FileSystem, str]:
    """Opened once a worker, not for every file."""
    return fs.FileSystem.from_uri(uri)


def _said(e: OSError) -> str:
    """What went wrong, without the place, which is the row's own."""
    import errno

    return os.strerror(e.errno) if e.errno in errno.errorcode else str(e).split("'")[0].strip()[:200] or type(e).__name__


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "attestry_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_directories(spark: SparkSession, root: str, components: list[str] | None = None, **options: str) -> DataFrame:
    """A files table of the trees below root, unreadable directories included, their paths ending in a slash. A component that was asked for and isn't there is
    the row of its own directory, `/`. Filters reach the source where the session lets Python sources have them."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("attestry_tree").options(**options)
    return (reader.option("components", ",".join(components)) if components else reader).load(root)


def subjects_of(files: DataFrame, error: str = "source_error") -> DataFrame:
    """(component_id, error): the components of a files table, with why a tree as a whole couldn't be read."""
    from pyspark.sql import functions as F

    whole = (F.col("path") == "/") & F.col("read_error").isNotNull()
    return files.groupBy("component_id").agg(F.max(F.when(whole, F.col("read_error"))).alias(error))
