"""Listings of mounted file systems: a data source that plans its partitions by directory, and rounds for deep trees.

The driver looks at directories level by level, only until there are as many as partitions are wanted. Each partition
lists its own directories some levels down; a directory at the lowest of these is left open, and the open ones of all
partitions are dealt anew for the next round. So a subtree that holds most of a tree is walked by many tasks, and
neither the driver nor a task ever holds more than the directories of a few levels.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.utils import AnalysisException

from pathlore.sources.catalog import PACKAGES, ancestors
from pathlore.sources.work import written

#: An entry of a listing; ``open``: a directory that isn't listed yet.
SCHEMA = "path string, size long, is_directory boolean, is_symlink boolean, created_at timestamp, modified_at timestamp, open boolean"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("is_directory", pa.bool_()), ("is_symlink", pa.bool_()), ("created_at", pa.timestamp("us", "UTC")), ("modified_at", pa.timestamp("us", "UTC")), ("open", pa.bool_())])
#: Levels of directories that a task lists in a round, and partitions of the first one.
LEVELS, PARTITIONS = 4, 64


def _told(path: str) -> str:
    """A path whose bytes may be no UTF-8, as a string."""
    return os.fsencode(path).decode("utf-8", "replace")


def _time(seconds: float | None) -> dt.datetime | None:
    try:
        return None if seconds is None else dt.datetime.fromtimestamp(seconds, dt.UTC)
    except (OverflowError, ValueError, OSError):
        return None


def is_package(name: str, packages: Sequence[str]) -> bool:
    return name.rpartition(".")[2] in packages and "." in name[1:]


def entries(folder: str, levels: int, packages: Sequence[str] = PACKAGES) -> Iterator[tuple]:
    """Entries (SCHEMA) under a directory, so many levels down: hidden ones too, links as links, nothing inside packages.
    What can't be read, or is gone by now, is left out; a package or a link that is asked for itself is listed."""
    todo = [(folder, 1)]
    while todo:
        at, level = todo.pop()
        try:
            found = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            continue
        for e in found:
            try:
                link = e.is_symlink()
                inside = not link and e.is_dir(follow_symlinks=False)
                stat = e.stat(follow_symlinks=False)
            except OSError:
                continue
            deeper = inside and not is_package(e.name, packages)
            opened = deeper and level >= levels
            if deeper and not opened:
                todo.append((e.path, level + 1))
            yield _told(e.path), stat.st_size if not inside else 0, inside, link, _time(getattr(stat, "st_birthtime", None)), _time(stat.st_mtime), opened


class Directories(InputPartition):
    """Directories of a partition, each with the levels to list below it, and whether its own directories are in
    partitions too."""

    def __init__(self, found: list[tuple[str, int, bool]]) -> None:
        super().__init__(None)
        self.found = found


class ListingReader(DataSourceReader):
    def __init__(self, options: Any) -> None:
        self.root, self.levels, self.wanted = options["path"], int(options.get("levels", LEVELS)), int(options.get("partitions", PARTITIONS))
        self.packages = [p for p in options.get("packages", ",".join(PACKAGES)).split(",") if p]

    def partitions(self) -> Sequence[InputPartition]:
        """Breadth first, a level a round, until there are enough directories: those above them are listed one level deep."""
        above: list[str] = []
        level = [self.root]
        while level and len(level) < self.wanted and len(above) < self.wanted:
            below = [p for at in level for p, _, inside, _, _, _, opened in entries(at, 1, self.packages) if inside and opened]
            above += level
            level = below
        every = [(p, 1, True) for p in above] + [(p, self.levels, False) for p in level]
        return [Directories(every[i :: self.wanted]) for i in range(min(self.wanted, len(every)))]

    def read(self, partition: Directories) -> Iterator[tuple]:
        for folder, levels, above in partition.found:
            for e in entries(folder, levels, self.packages):
                yield (*e[:6], e[6] and not above)


class Listing(DataSource):
    """spark.read.format("listing"): options path, levels, partitions, packages."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> ListingReader:
        return ListingReader(self.options)


def _deeper(levels: int, packages: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["path"].to_pylist():
                held: list[tuple] = []
                for e in entries(folder, levels, packages):
                    held.append(e)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def local_listing(spark: SparkSession, root: str, packages: Sequence[str] = PACKAGES, levels: int = LEVELS, partitions: int = PARTITIONS) -> DataFrame:
    """A listing of a folder that all executors have mounted under the same path: directories, hidden names and links
    (``is_symlink``) are in it, the root isn't, and packages aren't looked into. A missing root is an empty listing."""
    spark.dataSource.register(Listing)
    level = spark.read.format("listing").options(path=root.removeprefix("file://").rstrip("/") or "/", levels=levels, partitions=partitions, packages=",".join(packages)).load()
    whole = level = written(level, "listing")
    while not (again := level.where("open").select("path")).isEmpty():
        level = written(again.repartition(partitions).mapInArrow(_deeper(levels, packages), SCHEMA), "listing")
        whole = whole.unionByName(level)
    return whole.drop("open")


def mounted(spark: SparkSession, root: str) -> str | None:
    """The path under which the machines have a folder mounted, if it lies in their own file system: also of a path
    without a scheme, and of a link of another file system that leads there. None if it doesn't, or isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.resolvePath(at).toUri() if fs.exists(at) else None
    return found.getPath() if found is not None and found.getScheme() == "file" else None


def store_listing(spark: SparkSession, root: str, packages: Sequence[str] = PACKAGES) -> DataFrame:
    """A listing of a folder in any store that Spark reads: files as its reader finds them, without those that it takes
    for hidden, and the directories that hold some. A missing root is an empty listing."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA).drop("open")
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    below, inside = F.substring("path", len(top) + 1, 2**30), r"/[^/]+\.(" + "|".join(packages or ["$^"]) + ")/"
    none = F.lit(None).cast("timestamp").alias("created_at")
    files = found.where(~below.rlike(inside)).select("path", F.col("length").alias("size"), F.lit(False).alias("is_directory"), F.lit(False).alias("is_symlink"), none, F.col("modificationTime").alias("modified_at"))
    dirs = found.select(F.explode(ancestors(below)).alias("below")).where(~F.col("below").rlike(inside)).distinct()
    dirs = dirs.select(F.concat(F.lit(top), "below").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_directory"), F.lit(False).alias("is_symlink"), none, F.lit(None).cast("timestamp").alias("modified_at"))
    return dirs.unionByName(files)


def listing(spark: SparkSession, root: str, packages: Sequence[str] = PACKAGES, levels: int = LEVELS, partitions: int = PARTITIONS) -> DataFrame:
    """local_listing() of a folder that is mounted, store_listing() of any other."""
    path = mounted(spark, root)
    return store_listing(spark, root, packages) if path is None else local_listing(spark, path, packages, levels, partitions)
