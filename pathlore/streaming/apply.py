"""Batches of change events applied to a stored catalog and its postings, at a cost in proportion to their changes.

The store is a log. A base holds records, postings and graves; each batch appends a delta: the records that are there
now with their event's id, their postings, and graves (paths that are gone, directories that were listed anew). Which
records are live follows from all of them together and not from the order in which they came:

* of several records of an id the one of the largest event id counts;
* a grave ends the record of its path, and a directory's grave everything at and under it, if of a smaller event id.
  A path that is gone was a directory if the newest record before that said so, dead or live: what events said of
  directories, files and paths that are gone is kept event by event, also when deltas go into a new base.

So late and repeated events, batches that run again and streams with a new checkpoint change nothing that newer events
said. A version is a small pointer file, written last and under its final name at once: before it the former version
is read, whatever else is half written. When the deltas hold more than a share of the base, or are many, a version
gets a new base; ``vacuum`` removes what the last versions don't point to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathlore.functions import text as tx
from pathlore.operators import postings
from pathlore.sources import catalog as ct
from pathlore.sources.work import written
from pathlore.streaming import events as ev

#: What a batch says of a path: gone, or there with this size and time. A directory that is there comes with its whole
#: listing under the same event id.
SCHEMA = "event_id long, path string, gone boolean, size long, is_directory boolean, created_at timestamp, modified_at timestamp"
#: Deltas that hold this share of the base's rows, or are so many, go into a new base; records in a shard of the base.
SHARE, DELTAS, SHARD_ROWS = 0.25, 64, 1_000_000
#: Event id of records that no event has told of.
BEFORE = -1
#: Events that say a path is gone or a directory that is there (listed anew, if not from BEFORE), and those of files.
_GRAVES, _FILES = "path string, event_id long, gone boolean", "path string, event_id long"


@dataclass(frozen=True)
class Version:
    """What a pointer file says."""

    number: int
    base: str
    shards: int
    base_rows: int
    deltas: tuple[str, ...] = ()
    delta_rows: int = 0
    roots: tuple[str, ...] = ()
    count: int = 0  #: live records
    applied: dict[str, int] = field(default_factory=dict)  #: last batch of each stream
    anchors: int = 0  #: paths of the last batch
    delta: int = 0  #: records more after it
    added: int = 0  #: totals over all batches
    removed: int = 0
    changed: int = 0
    batches: int = 0


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _fs(spark, f"{folder}/versions/*.json")
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.globStatus(at) or [])


def version(spark: SparkSession, folder: str, number: int | None = None) -> Version:
    """A version of the store, by default the last one."""
    number = _pointers(spark, folder)[-1] if number is None else number
    told = json.loads(spark.read.option("wholetext", True).text(f"{folder}/versions/{number:012d}.json").first()[0])
    return Version(**{**told, "deltas": tuple(told["deltas"]), "roots": tuple(told["roots"])})


def _point(spark: SparkSession, folder: str, v: Version) -> Version:
    """Makes v the last version: a file that is written elsewhere and renamed. Another writer's version stops this one."""
    fs, draft = _fs(spark, f"{folder}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(asdict(v)).encode()))
    out.close()
    if not fs.rename(draft, _fs(spark, f"{folder}/versions/{v.number:012d}.json")[1]):
        fs.delete(draft, False)
        raise RuntimeError(f"version {v.number} of {folder} is there already: another stream has written it")
    return v


def _shard(shards: int) -> Column:
    return F.pmod(F.col("id"), F.lit(shards)).cast("int").alias("shard")


def _write_base(spark: SparkSession, folder: str, records: DataFrame, posted: DataFrame, graves: DataFrame, files: DataFrame, rows: int) -> tuple[str, int]:
    """A new base of records (with event_id), and into how many shards by id it is dealt."""
    name, shards = f"base-{uuid.uuid4().hex}", max(1, rows // SHARD_ROWS)
    records.select(*ct.COLUMNS, "event_id", _shard(shards)).repartition("shard").write.partitionBy("shard").parquet(f"{folder}/{name}/records")
    posted.select("kind", "key", "id").write.parquet(f"{folder}/{name}/postings")
    graves.select("path", "event_id", "gone").write.parquet(f"{folder}/{name}/graves")
    files.select("path", "event_id").write.parquet(f"{folder}/{name}/files")
    return name, shards


def start(catalog: DataFrame, folder: str, roots: Sequence[str] = ()) -> None:
    """Version 0: a catalog, its postings, and no event. Events of paths outside the roots, if any are given, are left out."""
    spark = catalog.sparkSession
    n = catalog.count()
    records = catalog.withColumn("event_id", F.lit(BEFORE).cast("long"))
    dirs = records.where("is_directory").select("path", "event_id", F.lit(False).alias("gone"))
    base, shards = _write_base(spark, folder, records, postings.build(catalog), dirs, spark.createDataFrame([], _FILES), n)
    _point(spark, folder, Version(0, base, shards, n, roots=tuple(r.rstrip("/") for r in roots), count=n))


@dataclass
class State:
    """A version's tables: base records (with event_id), ids of those that are dead, and live records of the deltas."""

    base: DataFrame
    dead: DataFrame | None
    fresh: DataFrame | None

    def records(self) -> DataFrame:
        if self.dead is None:
            return self.base
        return self.base.join(self.dead.hint("merge"), "id", "left_anti").select(*self.base.columns).unionByName(self.fresh)


def _at_or_above(path: Column) -> Column:
    return F.array_union(ct.ancestors(path), F.array(path))


def _told(spark: SparkSession, folder: str, v: Version, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{folder}/{d}/{table}" for d in (v.base, *v.deltas)])


def _removals(graves: DataFrame, files: DataFrame) -> DataFrame:
    """above, at: directories with the last event after which nothing older is at or under them. A directory that is
    listed anew is one, and a path that is gone if the newest record before that says that it was a directory."""
    both = graves.groupBy("path").agg(F.bool_or("gone").alias("g"), F.bool_or(~F.col("gone")).alias("d")).where("g AND d").select("path")
    told = graves.select("path", "event_id", "gone", (~F.col("gone")).alias("dir")).unionByName(files.select("path", "event_id", F.lit(False).alias("gone"), F.lit(False).alias("dir")))
    told = told.join(both.hint("merge"), "path", "left_semi")
    # what is gone and there under one event id is there after it
    before = Window.partitionBy("path").orderBy("event_id", F.desc("gone"), "dir").rowsBetween(Window.unboundedPreceding, -1)
    was = told.withColumn("was", F.last(F.when(~F.col("gone"), F.col("dir")), ignorenulls=True).over(before)).where("gone AND was").select("path", "event_id")
    listed = graves.where(~F.col("gone") & (F.col("event_id") > BEFORE)).select("path", "event_id")
    return listed.unionByName(was).groupBy(F.col("path").alias("above")).agg(F.max("event_id").alias("at"))


def _state(spark: SparkSession, folder: str, v: Version, shards: Sequence[int] | None = None) -> State:
    """The version's state; of those shards of the base alone, if told: paths that hash elsewhere are not to be asked for.

    Joins whose sides grow with the events shuffle, so that none of them passes through the driver.
    """
    base = spark.read.parquet(f"{folder}/{v.base}/records")
    base = (base if shards is None else base.where(F.col("shard").isin([int(s) for s in shards]))).select(*ct.COLUMNS, "event_id")
    if not v.deltas:
        return State(base, None, None)
    graves = _told(spark, folder, v, "graves", _GRAVES)
    gone = graves.where("gone").groupBy("path").agg(F.max("event_id").alias("gone_id"))
    dirs = written(_removals(graves, _told(spark, folder, v, "files", _FILES)), "removals")
    has_dirs = not dirs.isEmpty()
    told = spark.read.schema(base.schema).parquet(*[f"{folder}/{d}/records" for d in v.deltas])
    if len(v.deltas) > 1:  # a delta has an id once
        told = told.groupBy("id").agg(F.max(F.struct("event_id", *[c for c in ct.COLUMNS if c != "id"])).alias("r")).select("id", "r.*").select(*base.columns)
        told = written(told, "newest")

    def buried(rows: DataFrame) -> DataFrame:
        """Ids of rows that a grave ends; without directories' graves no path is cut into its ancestors."""
        ended = rows.select("id", "path", "event_id").join(gone.hint("merge"), "path").where("gone_id > event_id").select("id")
        if not has_dirs:
            return ended
        under = rows.select("id", "event_id", F.explode(_at_or_above(F.col("path"))).alias("above")).join(dirs, "above").where("at > event_id").select("id")
        return ended.unionByName(under)

    newer = base.select("id", F.col("event_id").alias("old_id")).join(told.select("id", "event_id").hint("merge"), "id")
    dead = newer.where("event_id > old_id").select("id").unionByName(buried(base)).distinct()
    stale = newer.where("event_id <= old_id").select("id").unionByName(buried(told)).distinct()
    return State(base, dead, told.join(stale.hint("merge"), "id", "left_anti").select(*base.columns))


def _postings(spark: SparkSession, folder: str, v: Version, state: State) -> DataFrame:
    """Postings of live records: those of the base without the dead, and of the deltas those of live versions."""
    base = spark.read.parquet(f"{folder}/{v.base}/postings")
    if state.dead is None:
        return base
    told = spark.read.parquet(*[f"{folder}/{d}/postings" for d in v.deltas]).join(state.fresh.select("id", "event_id").hint("merge"), ["id", "event_id"], "left_semi")
    return base.join(state.dead.hint("merge"), "id", "left_anti").select("kind", "key", "id").unionByName(told.select("kind", "key", "id").distinct())


def latest(spark: SparkSession, folder: str, number: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Catalog and postings of a version, by default of the last one."""
    v = version(spark, folder, number)
    state = _state(spark, folder, v)
    return state.records().select(*ct.COLUMNS), _postings(spark, folder, v, state)


def compact(spark: SparkSession, folder: str) -> Version:
    """The last version with all deltas in a new base. What events said of graves, directories and files stays, so that
    events that come late still find it."""
    v = version(spark, folder)
    state = _state(spark, folder, v)
    base, shards = _write_base(spark, folder, state.records(), _postings(spark, folder, v, state), *(_told(spark, folder, v, t, s).distinct() for t, s in (("graves", _GRAVES), ("files", _FILES))), v.count)
    return _point(spark, folder, replace(v, number=v.number + 1, base=base, shards=shards, base_rows=v.count, deltas=(), delta_rows=0, anchors=0, delta=0))


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Removes the pointers before the last ``keep`` and what none of those points to."""
    numbers = _pointers(spark, folder)
    used = {name for n in numbers[-keep:] for v in [version(spark, folder, n)] for name in (v.base, *v.deltas)}
    for n in numbers[:-keep]:
        fs, at = _fs(spark, f"{folder}/versions/{n:012d}.json")
        fs.delete(at, False)
    fs, at = _fs(spark, f"{folder}/*")
    for found in fs.globStatus(at) or []:
        name = found.getPath().getName()
        if name.startswith(("base-", "delta-")) and name not in used:
            fs.delete(found.getPath(), True)


def _within(roots: Sequence[str]) -> Column:
    under = F.lit(not roots)
    for root in roots:
        under = under | (F.col("path") == root) | F.col("path").startswith(f"{root}/")
    return under


def apply_batch(batch: DataFrame, folder: str, stream: str, number: int) -> Version:
    """Appends a batch (SCHEMA) of a stream to the store; a batch that has been applied is left out."""
    spark = batch.sparkSession
    v = version(spark, folder)
    if number <= v.applied.get(stream, -1):
        return v
    name = f"delta-{uuid.uuid4().hex}"
    rows = batch.where(F.col("path").isNotNull() & F.col("event_id").isNotNull() & _within(v.roots))
    there = rows.where(~F.coalesce("gone", F.lit(False)))
    last = there.groupBy("path").agg(F.max(F.struct("event_id", "size", "is_directory", "created_at", "modified_at")).alias("r")).select("path", "r.*")
    records = ct.records(last, carry=["event_id"])
    records.write.parquet(f"{folder}/{name}/records")
    records = spark.read.parquet(f"{folder}/{name}/records")
    postings.build(records, carry=["event_id"]).write.parquet(f"{folder}/{name}/postings")
    gone, listed = F.coalesce("gone", F.lit(False)), F.coalesce("is_directory", F.lit(False))
    rows.where(gone | listed).select("path", "event_id", gone.alias("gone")).distinct().write.parquet(f"{folder}/{name}/graves")
    there.where(~listed).select("path", "event_id").distinct().write.parquet(f"{folder}/{name}/files")
    graves = spark.read.schema(_GRAVES).parquet(f"{folder}/{name}/graves")

    n = records.count()
    told = records.select("path").unionByName(graves.select("path")).distinct()
    anchors = told.count()
    if not anchors:
        return _point(spark, folder, replace(v, number=v.number + 1, applied={**v.applied, stream: number}, anchors=0, delta=0))
    new = replace(v, number=v.number + 1, deltas=(*v.deltas, name), delta_rows=v.delta_rows + n + graves.count(), applied={**v.applied, stream: number}, anchors=anchors, batches=v.batches + 1)

    # how many records more: of the shards of the batch's paths alone, unless one of these is or was a directory, as then
    # others may come or go with it
    known = _told(spark, folder, new, "graves", _GRAVES).where("NOT gone").select("path")
    if not told.join(known.hint("merge"), "path", "left_semi").isEmpty():
        more = _state(spark, folder, new).records().count() - v.count
    else:
        ids = written(told.select("path", tx.stable_id(tx.normalize(F.col("path"))).alias("id")).select("id").distinct(), "touched")
        shards = [r[0] for r in ids.select(_shard(v.shards)).distinct().collect()]
        touched = lambda x: _state(spark, folder, x, shards).records().select("id").join(ids.hint("merge"), "id", "left_semi").count()
        more = touched(new) - touched(v)
    new = replace(new, count=v.count + more, delta=more, added=v.added + max(more, 0), removed=v.removed + max(-more, 0), changed=v.changed + (more == 0))
    _point(spark, folder, new)
    return compact(spark, folder) if new.delta_rows > SHARE * new.base_rows or len(new.deltas) > DELTAS else new


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the checkpoint has: another one for each new checkpoint, also under an old one's name."""
    return json.loads(spark.read.option("wholetext", True).text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def apply_batches(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Applies all events that are there now (SCHEMA), a version for each batch; an empty batch makes a version too.

    Null paths and ids are left out. The order of events is that of their ids, within a batch and over all streams.
    """
    ev.run(stream, lambda batch, number: apply_batch(batch, folder, _stream_id(batch.sparkSession, checkpoint), number), checkpoint)


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """One row: version, live records, and what all batches together have added, removed and changed."""
    v = version(spark, folder)
    return spark.createDataFrame([(v.number, v.count, v.added, v.removed, v.changed, v.batches)], "version long, item_count long, added long, removed long, changed long, batches long")
