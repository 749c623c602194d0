"""Change events: debounce, rescan latch, counters, and batches applied to a catalog. Each has a batch form too."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "event_id long, ts timestamp, monitor string, batch_id long, path string, flags int"
#: Flags of events after which a root must be listed anew, and of the monitor's start after that; bits are a setting of
#: the source.
RESCAN, RESTART = 1 | 2 | 4, 8


def source(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def needs_rescan(flags: Column, mask: int = RESCAN) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(mask)) != 0


def debounce(events: DataFrame, gap: str = "250 milliseconds") -> DataFrame:
    """monitor, start, path, last_event_id: the distinct paths of each run of events less than ``gap`` apart."""
    runs = events.groupBy("monitor", F.session_window("ts", gap).alias("w")).agg(F.collect_set("path").alias("paths"), F.max("event_id").alias("last_event_id"))
    return runs.select("monitor", F.col("w.start").alias("start"), F.explode("paths").alias("path"), "last_event_id")


RUNS = "monitor string, start timestamp, path string, last_event_id long"


#: Lists that the paths of an open run are dealt to, and rows that go to the state or out at once.
SHARES, AT_ONCE = 16, 10_000


class Runs(StatefulProcessor):
    """A monitor's run of events that is open, and the events that the watermark hasn't reached yet.

    Events wait until none before them can come, and then join the open run or end it, in order: all that are ready at
    once, in columns, as each call to the state costs as much as many events. A run also ends, by a timer, when the
    watermark is ``gap`` past its last event. Its paths are lists in the state store, dealt by hash: only one of them is
    made distinct at a time, and goes out in rows. Nothing stays of a run that has ended.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap = 1000 * gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, path string")
        self.open = handle.getValueState("open", "first long, last long, event_id long")
        self.paths = [handle.getListState(f"paths{i}", "path string") for i in range(SHARES)]

    def _keep(self, paths: pd.Series) -> None:
        """Adds distinct paths to those of the open run."""
        share = pd.util.hash_array(paths.to_numpy(object), categorize=False) % SHARES
        for i in range(SHARES):
            told = [(p,) for p in paths[share == i]]
            for j in range(0, len(told), AT_ONCE):
                self.paths[i].appendList(told[j : j + AT_ONCE])

    def _ended(self, monitor: str) -> Iterator[pd.DataFrame]:
        first, _, event_id = self.open.get()
        for kept in self.paths:
            if kept.exists():
                yield from self._out(monitor, first, list({p for (p,) in kept.get()}), event_id)
                kept.clear()
        self.open.clear()

    def _out(self, monitor: str, first: int, paths: list[str], event_id: int) -> Iterator[pd.DataFrame]:
        for j in range(0, len(paths), AT_ONCE):
            yield pd.DataFrame({"monitor": monitor, "start": pd.Timestamp(first, unit="us", tz="UTC"), "path": paths[j : j + AT_ONCE], "last_event_id": event_id})

    def _settled(self, monitor: str, watermark: int, fresh: pd.DataFrame | None = None) -> Iterator[pd.DataFrame]:
        """Brings the run up to the watermark, in microseconds like the events; fresh ones don't wait yet."""
        held = self.waiting.exists()
        rows = pd.DataFrame(self.waiting.get(), columns=["us", "event_id", "path"]) if held else None
        rows = rows if fresh is None else fresh if rows is None else pd.concat([rows, fresh], ignore_index=True)
        if rows is not None:
            ready = rows["us"] <= watermark
            if not ready.any():
                rows = None
            elif held:
                self.waiting.clear()
            later = fresh if rows is None else rows[~ready]
            if later is not None:
                for j in range(0, len(later), AT_ONCE):
                    part = later[j : j + AT_ONCE]
                    self.waiting.appendList(list(zip(part["us"].tolist(), part["event_id"].tolist(), part["path"].tolist(), strict=True)))
        if rows is not None:
            rows = rows[ready].sort_values("us", kind="stable")
            us = rows["us"].to_numpy()
            last = self.open.get()[1] if self.open.exists() else us[0] - self.gap
            run = (np.diff(us, prepend=last) >= self.gap).cumsum()  # 0: of the run that is open
            for number, part in rows.groupby(run, sort=True):
                if number and self.open.exists():
                    yield from self._ended(monitor)
                paths, event_id = part["path"].dropna().drop_duplicates(), int(part["event_id"].max())
                first = int(part["us"].iloc[0])
                if number and number < run[-1]:  # begins and ends here
                    yield from self._out(monitor, first, paths.tolist(), event_id)
                    continue
                if self.open.exists():
                    first, event_id = self.open.get()[0], max(event_id, self.open.get()[2])
                self.open.update((first, int(part["us"].iloc[-1]), event_id))
                self._keep(paths)
        if self.open.exists() and watermark >= self.open.get()[1] + self.gap:
            yield from self._ended(monitor)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        told = [pd.DataFrame({"us": part["ts"].astype("datetime64[us]").astype("int64"), "event_id": part["event_id"], "path": part["path"]}) for part in rows if len(part)]
        fresh = pd.concat(told, ignore_index=True) if told else None
        yield from self._settled(key[0], 1000 * timerValues.getCurrentWatermarkInMs(), fresh)
        if fresh is not None:
            self.handle.registerTimer((int(fresh["us"].max()) + self.gap) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._settled(key[0], 1000 * timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, gap_ms: int = 250, late: str = "10 seconds") -> DataFrame:
    """The same on a stream, in append mode: events later than the watermark are dropped, a run comes out once the
    watermark has passed it, and then its state is gone. Needs the RocksDB state store (``state_store``)."""
    return events.withWatermark("ts", late).select("monitor", "ts", "event_id", "path").groupBy("monitor").transformWithStateInPandas(Runs(gap_ms), RUNS, "Append", "EventTime")


def state_store(spark: SparkSession) -> None:
    """Sets the state store that keeps maps, lists and timers of a key apart from each other, on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _marks(events: DataFrame) -> DataFrame:
    """Each arrival group with whether it asks for a rescan, and whether its monitor is stale after it."""
    flagged = events.withColumns({"r": needs_rescan(F.col("flags")).cast("int"), "again": needs_rescan(F.col("flags"), RESTART).cast("int")})
    groups = flagged.groupBy("monitor", "batch_id").agg(F.max("r").alias("r"), F.max("again").alias("again"))
    mark = F.when(F.col("r") == 1, True).when(F.col("again") == 1, False)
    return groups.withColumn("stale", F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy("monitor").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))


def latch(events: DataFrame) -> DataFrame:
    """Events that arrive while their monitor isn't stale: from an arrival group with a rescan flag on, none, until one
    with a restart."""
    return events.join(_marks(events).where("NOT stale").select("monitor", "batch_id"), ["monitor", "batch_id"], "left_semi")


STATES = "monitor string, batch_id long, stale boolean, last_event_id long, last_ts timestamp, added long, removed long, changed long, batches long"
_STATE = "stale boolean, last_event_id long, last_us long, added long, removed long, changed long, batches long"


class Monitor(StatefulProcessor):
    """What is known of a monitor: whether it is stale, its last event, and what applied batches have changed.

    Groups (batch_id) are taken in order. A group with a rescan flag makes the monitor stale and is dropped whole, one
    with a restart makes it fresh again before its events count; the last event's id and time go on in any case. A row
    with a delta tells of an applied batch. ``accepted``: gives the events that are to be applied, else a row for each
    group with the state after it.
    """

    def __init__(self, accepted: bool) -> None:
        self.accepted = accepted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)

    @staticmethod
    def _marks(part: pd.DataFrame) -> pd.DataFrame:
        """What a part's rows say of each group: its flags, its last event, and sums of deltas. Rows don't stay."""
        event, flags = part["event_id"].notna(), pd.to_numeric(part["flags"]).fillna(0).astype("int64")
        delta = pd.to_numeric(part["delta"]) if "delta" in part else pd.Series(np.nan, part.index)
        told = pd.DataFrame({
            "batch_id": part["batch_id"].astype("int64"), "rescan": event & (flags & RESCAN != 0), "again": event & (flags & RESTART != 0), "e": part["event_id"].astype("Int64"),
            "us": part["ts"].astype("datetime64[us]").astype("int64").astype("Int64").where(event), "added": delta.clip(lower=0).fillna(0).astype("int64"), "removed": (-delta).clip(lower=0).fillna(0).astype("int64"),
            "changed": (delta == 0).astype("int64"), "batches": delta.notna().astype("int64"),
        })
        return Monitor._one([told.set_index("batch_id")])

    @staticmethod
    def _one(marks: list[pd.DataFrame]) -> pd.DataFrame:
        how = dict.fromkeys(("rescan", "again", "e", "us"), "max") | dict.fromkeys(("added", "removed", "changed", "batches"), "sum")
        return pd.concat(marks).groupby(level=0, sort=True).agg(how)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stale, last_id, last_us, *sums = self.state.get() if self.state.exists() else (False, None, None, 0, 0, 0, 0)
        held, marks = [], []
        for part in rows:
            marks.append(self._marks(part))
            if len(marks) == 100:
                marks = [self._one(marks)]
            if self.accepted:
                held.append(part[part["event_id"].notna()])
        out, dropped = [], []
        names = [f.split()[0] for f in STATES.split(", ")]
        for batch_id, rescan, again, e, us, *more in self._one(marks).itertuples() if marks else ():
            stale = rescan or stale and not again
            if stale:
                dropped.append(batch_id)
            if e is not pd.NA and e == e:  # there is one
                last_id = max(int(e), last_id if last_id is not None else -(2**63))
                last_us = int(us) if last_us is None else max(int(us), last_us)
            sums = [int(a + b) for a, b in zip(sums, more, strict=True)]
            if not self.accepted:
                out.append((key[0], batch_id, bool(stale), last_id, None if last_us is None else pd.Timestamp(last_us, unit="us", tz="UTC"), *sums))
                if len(out) == AT_ONCE:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        for part in held:
            part = part[~part["batch_id"].isin(dropped)]
            if len(part):
                yield part[["event_id", "ts", "monitor", "batch_id", "path", "flags"]]
        self.state.update((stale, last_id, last_us, *map(int, sums)))
        if out:
            yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def latch_stream(events: DataFrame) -> DataFrame:
    """latch() on a stream whose groups arrive in order. Needs ``state_store``."""
    return events.groupBy("monitor").transformWithStateInPandas(Monitor(True), SCHEMA, "Append", "None")


def monitor_stream(events: DataFrame) -> DataFrame:
    """The state of each monitor (STATES) after each group that arrives, of a stream of events and applied batches
    (SCHEMA and ``delta``). Needs ``state_store``."""
    asked = [c for c in ("monitor", "batch_id", "event_id", "ts", "flags", "delta") if c in events.columns]
    return events.select(*asked).groupBy("monitor").transformWithStateInPandas(Monitor(False), STATES, "Append", "None")


def last_event(events: DataFrame) -> DataFrame:
    return events.groupBy("monitor").agg(F.max("event_id").alias("last_event_id"), F.max("ts").alias("last_ts"))


def counters(batches: DataFrame) -> DataFrame:
    """added, removed, changed, batches of a table with each applied batch's delta."""
    d = F.col("delta")
    zero = F.lit(0).cast("long")
    return batches.agg(
        F.coalesce(F.sum(F.greatest(d, zero)), zero).alias("added"), F.coalesce(F.sum(F.greatest(-d, zero)), zero).alias("removed"),
        F.coalesce(F.sum(F.when(d == 0, 1).otherwise(0)), zero).cast("long").alias("changed"), F.count(F.lit(1)).alias("batches"),
    )


def drained(result: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """What a stream in append mode gives over everything that is there now, in a folder."""
    result.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(folder)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that is there now, in batches; each batch is handed over with its number."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
