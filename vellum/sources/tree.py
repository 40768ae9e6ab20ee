"""A folder tree as a data source: files, folders with their identities, and the places that could not be read.

The driver lists folders level by level until there are enough subtrees for the tasks; each then walks its own, and the folders above are listed by tasks of their own. A filter on the start of ``path`` is pushed
down to the walk by ``scan``: folders that no such path lies in are not entered.

Links to folders are followed by real path: one that leads to a folder which the walk comes to by itself is left alone, so loops end; of several links to a folder outside, what is below it is listed once, under the
path that is least. Links to files are files of their own. A folder that can't be read, or a link that leads nowhere, is a row of kind ``gap``, and a listing with gaps is not complete: nothing may be
concluded from what it lacks.

Defined results: an empty or missing root gives no files, a missing one a gap; hidden names (with a leading dot) and excluded folders are not entered; hard links are files with one identity each; names that are no UTF-8
are shown with U+FFFD; where the system has no birth time it is null. Roots are folders that every executor has mounted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from ..functions import paths
from ..operators.graph import checkpointed

SCHEMA = "kind string, path string, real string, dev long, ino long, size long, modified long, born long, linked boolean"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string()] * 3 + [pa.int64()] * 5 + [pa.bool_()]
_ROWS = 4096


def _shown(path: str) -> str:
    return os.fsencode(path).decode("utf-8", "replace")


class Walk:
    """The rules of one listing; paths are relative to the root, with slashes."""

    def __init__(self, root: str, start: str = "", excluded: tuple[str, ...] = (), hidden: bool = False, links: bool = True):
        self.root, self.start, self.excluded, self.hidden, self.links = root, start, excluded, hidden, links
        self.real_root = os.path.realpath(root)
        self.prefixes: list[str] = []

    def at(self, path: str) -> str:
        return os.path.join(self.root, path) if path else self.root

    def enters(self, path: str) -> bool:
        """Whether a folder is in scope by its own path."""
        if not self.hidden and any(part.startswith(".") for part in path.split("/") if part):
            return False
        return not any(path == x or path.startswith(x + "/") for x in self.excluded)

    def may_hold(self, path: str) -> bool:
        """Whether a path that the pushed filters want may lie at or below a folder."""
        return all((path + "/").startswith(p) or p.startswith(path + "/" if path else "") or path.startswith(p) for p in self.prefixes)

    def covers(self, real: str) -> bool:
        """Whether the walk comes to a real folder by its own path."""
        top = os.path.realpath(self.at(self.start))
        if real != top and not real.startswith(top.rstrip("/") + "/"):
            return False
        own = os.path.relpath(real, self.real_root).replace(os.sep, "/")
        return self.enters("" if own == "." else own)

    def folder(self, path: str, above: tuple[str, ...], linked: bool) -> tuple[list[tuple], list[tuple[str, tuple[str, ...], bool]]]:
        """The rows of a folder's own entries, and the folders to enter next: (path, real folders above, linked)."""
        rows, below = [], []
        try:
            entries = sorted(os.scandir(self.at(path)), key=lambda e: os.fsencode(e.name))
        except OSError:
            return [("gap", _shown(path), None, None, None, None, None, None, linked)], []
        real_folder = os.path.realpath(self.at(path))
        for entry in entries:
            own = f"{path}/{entry.name}" if path else entry.name
            if entry.name.startswith(".") and not self.hidden:
                continue
            link = entry.is_symlink()
            if link and not self.links:
                continue
            try:
                stat = os.stat(entry.path)
                is_folder = entry.is_dir()
            except OSError:
                if self.enters(own):
                    rows.append(("gap", _shown(own), None, None, None, None, None, None, linked or link))
                continue
            real = os.path.realpath(entry.path) if link else os.path.join(real_folder, entry.name)
            kind = "folder" if is_folder else "file"
            if is_folder:
                if not self.enters(own) or (link and (real in above or self.covers(real))) or not self.may_hold(own):
                    continue
                below.append((own, (*above, real), linked or link))
            elif not entry.is_file():
                continue
            where = real if is_folder else os.path.join(real_folder, entry.name)
            born = getattr(stat, "st_birthtime", None)
            rows.append((kind, _shown(own), _shown(where), stat.st_dev, stat.st_ino, stat.st_size, stat.st_mtime_ns // 1_000_000, born and int(born * 1000), linked or (link and is_folder)))
        return rows, below


class Subtree(InputPartition):
    def __init__(self, path: str, above: tuple[str, ...], linked: bool, deep: bool):
        self.path, self.above, self.linked, self.deep = path, above, linked, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.walk = Walk(options["path"], options.get("start", ""), tuple(json.loads(options.get("excluded", "[]"))), options.get("hidden", "false") == "true", options.get("links", "true") == "true")
        self.tasks = int(options.get("tasks", "64"))

    def partitions(self):
        top = self.walk.start
        ready, done = [(top, (os.path.realpath(self.walk.at(top)),), False)], []
        while ready and len(ready) < self.tasks:
            done += ready
            ready = [sub for place in ready for sub in self.walk.folder(*place)[1]]
        return [Subtree(*place, deep=False) for place in done] + [Subtree(*place, deep=True) for place in ready]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        waiting, rows = [(partition.path, partition.above, partition.linked)], []
        while waiting:
            own, below = self.walk.folder(*waiting.pop())
            rows += own
            if partition.deep:
                waiting += below
            if len(rows) >= _ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


class PrunedTreeReader(TreeReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("path",) and isinstance(f.value, str):
                self.walk.prefixes.append(f.value)
            yield f  # Spark judges the rows again


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _TYPES)], names=_COLUMNS)


class TreeSource(DataSource):
    """Options: path, start, excluded (a JSON list of folders), hidden, links, tasks, pruned (takes filters, where the session lets Python sources do so)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return (PrunedTreeReader if self.options.get("pruned") == "true" else TreeReader)(dict(self.options))


def read_tree(spark: SparkSession, root: str, start: str = "", excluded: list[str] | None = None, hidden: bool = False, links: bool = True, tasks: int = 64, pruned: bool = False) -> DataFrame:
    """All rows as the walk finds them; what several links lead to is listed under each."""
    spark.dataSource.register(TreeSource)
    options = {"path": root.removeprefix("file:"), "start": start, "excluded": json.dumps(excluded or []), "hidden": str(hidden).lower(), "links": str(links).lower(), "tasks": str(tasks), "pruned": str(pruned).lower()}
    return spark.read.format("tree").options(**options).load()


def scan(spark: SparkSession, root: str, prefix: str | None = None, **options) -> DataFrame:
    """One listing, written down, so that all that is asked of it sees the same state of the folders. ``prefix``: only paths that begin so."""
    key, before = "spark.sql.python.filterPushdown.enabled", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set(key, "true")
    try:
        rows = read_tree(spark, root, pruned=True, **options)
        rows = rows.filter(F.col("path").startswith(prefix)) if prefix else rows
        place = F.when(F.col("linked") & F.col("real").isNotNull(), F.col("real")).otherwise(F.col("path"))
        least = rows.groupBy("kind", place.alias("place")).agg(F.min_by(F.struct(*_COLUMNS), "path").alias("row")).select("row.*")
        return checkpointed(least)
    finally:
        spark.conf.set(key, before)


def is_complete(tree: DataFrame) -> DataFrame:
    """One row: whether the listing has no gaps."""
    return tree.agg((F.count_if(F.col("kind") == "gap") == 0).alias("complete"))


def importable(tree: DataFrame) -> DataFrame:
    """The files of a known format, with it."""
    return tree.filter("kind = 'file'").withColumn("format", paths.format_class(F.col("path"))).filter("format IS NOT NULL")


def removals(known: DataFrame, tree: DataFrame, path: str = "path") -> DataFrame:
    """Known rows whose file is gone; none while the listing has gaps, for the file may lie in one."""
    held = tree.filter("kind = 'gap'").select(F.lit(True).alias("__gap")).limit(1)
    gone = known.join(tree.filter("kind = 'file'").select(F.col("path").alias(path)), path, "left_anti")
    return gone.join(F.broadcast(held), F.lit(True), "left_anti")


def originals_anywhere(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all originals below a folder, hidden and excluded ones too, links not followed: what must be empty before a tree is removed."""
    return read_tree(spark, folder, hidden=True, links=False).filter((F.col("kind") == "file") & (paths.format_class(F.col("path")) == "raw")).select("path")
