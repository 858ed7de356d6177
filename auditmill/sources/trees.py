"""A Spark data source for the names of a directory tree.

    spark.dataSource.register(TreeListing)
    spark.read.format("auditmill_tree").option("path", root).load().filter("suffix = '.py' AND size_bytes < 1000")

Columns: path, rel_path, suffix (lower case, with its dot), depth (0 for files right under the root), size_bytes. Spark's
own file sources leave out names that start with `_` or `.`, and with them every `__init__.py`.

Partitions are planned from the upper levels: directories are expanded until there are enough of them, and these are
dealt to as many tasks to walk. The files of an expanded directory are listed by as many tasks as their number calls for,
each taking its share of the names. Directories are read as streams and rows leave in batches, so a task holds a batch
and the directories still to walk. Where the session lets Python sources take filters (`spark.sql.python.filterPushdown.enabled`),
comparisons of suffix, depth and size_bytes are taken and decide before a row is made; options `suffixes`, `max_bytes`,
`skip` and `recursive` do the same without.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.cloudpickle
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

NAME = "auditmill_tree"
SCHEMA = "path string, rel_path string, suffix string, depth int, size_bytes bigint"
BATCH_ROWS = 10_000
SHARE_FILES = 100_000   # names of one directory that a task takes
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def open_path(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def entries(path: str) -> Iterator[tuple[str, bool, int | None]]:
    """(name, is directory, size) of a directory's entries. Links to directories are not followed.

    A mounted directory is read as a stream; Arrow gives that of a remote one as a whole, about 300 bytes a name."""
    fs, inner = open_path(path)
    if not isinstance(fs, arrow_fs.LocalFileSystem):
        for info in fs.get_file_info(arrow_fs.FileSelector(inner)):
            is_dir = info.type == arrow_fs.FileType.Directory
            yield info.base_name, is_dir, None if is_dir else info.size
        return
    with os.scandir(inner) as found:
        for entry in found:
            try:
                is_dir = entry.is_dir()
                if not (is_dir and entry.is_symlink()):
                    yield entry.name, is_dir, None if is_dir else entry.stat().st_size
            except OSError:
                continue


def suffix_of(name: str) -> str:
    """The last dot of a name and what follows, in lower case; dots that a name begins with are not meant."""
    bare = name.lstrip(".")
    at = bare.rfind(".")
    return bare[at:].lower() if at > 0 and at < len(bare) - 1 else ""


@dataclass(frozen=True)
class Walk(D.InputPartition):
    """Directories to walk, or one share of the files right in a directory."""

    rel_paths: tuple[str, ...]
    files_only: bool = False
    share: int = 0
    shares: int = 1


class Tests:
    """Conditions on suffix, depth and size, as lists of allowed values and bounds."""

    def __init__(self, suffixes: Iterable[str] | None = None, max_bytes: int | None = None) -> None:
        self.suffixes = None if suffixes is None else frozenset(suffixes)
        self.bounds: list[tuple[str, str, int]] = [] if max_bytes is None else [("size_bytes", "<=", max_bytes)]

    def take(self, item: D.Filter) -> bool:
        """Take a filter of Spark's over; false for one this source does not know."""
        column = item.attribute[0] if getattr(item, "attribute", None) and len(item.attribute) == 1 else None
        signs = {D.LessThan: "<", D.LessThanOrEqual: "<=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.EqualTo: "="}
        if column == "suffix" and type(item) in (D.EqualTo, D.In):
            values = frozenset([item.value] if isinstance(item, D.EqualTo) else item.value)
            self.suffixes = values if self.suffixes is None else self.suffixes & values
            return True
        if column in ("depth", "size_bytes") and type(item) in signs:
            self.bounds.append((column, signs[type(item)], item.value))
            return True
        return isinstance(item, D.IsNotNull) and column in ("path", "rel_path", "suffix", "depth", "size_bytes")

    def hold(self, suffix: str, depth: int, size: int) -> bool:
        if self.suffixes is not None and suffix not in self.suffixes:
            return False
        for column, sign, value in self.bounds:
            own = depth if column == "depth" else size
            if not {"<": own < value, "<=": own <= value, ">": own > value, ">=": own >= value, "=": own == value}[sign]:
                return False
        return True

    def deepest(self) -> float:
        """No file further down can pass."""
        return min([value - (sign == "<") for column, sign, value in self.bounds if column == "depth" and sign in ("<", "<=", "=")], default=float("inf"))


class TreeReader(D.DataSourceReader):
    def __init__(self, root: str, recursive: bool, skip: Iterable[str], tests: Tests, width: int) -> None:
        self.root, self.recursive, self.skip, self.tests, self.width = root.rstrip("/"), recursive, frozenset(skip), tests, width

    def _full(self, rel_path: str) -> str:
        return f"{self.root}/{rel_path}" if rel_path else self.root

    def partitions(self) -> list[Walk]:
        """Expand the directories nearest to the root until `width` are there to walk."""
        planned, frontier = [], deque([""])
        while frontier and len(frontier) < self.width:
            rel_path = frontier.popleft()
            files, below = 0, []
            for name, is_dir, _ in entries(self._full(rel_path)):
                if not is_dir:
                    files += 1
                elif name not in self.skip:
                    below.append(f"{rel_path}/{name}" if rel_path else name)
            shares = -(-files // SHARE_FILES)
            planned += [Walk((rel_path,), True, i, shares) for i in range(shares)]
            if self.recursive and (rel_path.count("/") + bool(rel_path)) < self.tests.deepest():
                frontier.extend(below)
        below = list(frontier)
        return planned + [Walk(tuple(below[i::self.width])) for i in range(min(self.width, len(below)))] or [Walk(("",), True)]

    def read(self, partition: Walk) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        left = list(partition.rel_paths)
        while left:
            rel_path = left.pop()
            depth = rel_path.count("/") + bool(rel_path)
            for name, is_dir, size in entries(self._full(rel_path)):
                own = f"{rel_path}/{name}" if rel_path else name
                if is_dir:
                    if not partition.files_only and name not in self.skip and depth < self.tests.deepest():
                        left.append(own)
                    continue
                if partition.shares > 1 and zlib.crc32(name.encode("utf-8", "surrogateescape")) % partition.shares != partition.share:
                    continue
                suffix = suffix_of(name)
                if self.tests.hold(suffix, depth, size):
                    rows.append((self._full(own), own, suffix, depth, size))
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


class PushingTreeReader(TreeReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        return [f for f in filters if not self.tests.take(f)]


_TYPES = [("path", pa.string()), ("rel_path", pa.string()), ("suffix", pa.string()), ("depth", pa.int32()), ("size_bytes", pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    clean = [[v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for v in column] for column in zip(*rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(clean, _TYPES)], names=[n for n, _ in _TYPES])


class TreeListing(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        o = self.options
        tests = Tests(json.loads(o["suffixes"]) if "suffixes" in o else None, int(o["max_bytes"]) if "max_bytes" in o else None)
        kind = PushingTreeReader if o.get("pushdown", "false") == "true" else TreeReader
        return kind(o["path"], o.get("recursive", "true") == "true", json.loads(o.get("skip", "[]")), tests, int(o.get("width", "64")))


def listing(spark: SparkSession, root: str, recursive: bool = True, skip: Iterable[str] = (), suffixes: Iterable[str] | None = None,
            max_bytes: int | None = None) -> DataFrame:
    """The files under a root. Tests given here are made by the source, and so are filters put on the result later if
    the session allows it."""
    spark.dataSource.register(TreeListing)
    options = {"path": root, "recursive": str(recursive).lower(), "skip": json.dumps(list(skip)), "width": 4 * spark.sparkContext.defaultParallelism,
               "pushdown": str(spark.conf.get(PUSHDOWN, "false")).lower()}
    if suffixes is not None:
        options["suffixes"] = json.dumps(list(suffixes))
    if max_bytes is not None:
        options["max_bytes"] = max_bytes
    return spark.read.format(NAME).options(**options).load()


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
