"""What a monitor's processors ask of the state store and keep in memory, without a stream."""

import tracemalloc
from types import SimpleNamespace

import pandas as pd

from pathlore.streaming import events as ev


class Store:
    """A state of any kind; counts calls over all states."""

    calls = 0

    def __init__(self):
        self.rows, self.map = [], {}

    def _told(self, *a):
        Store.calls += 1

    def exists(self):
        self._told()
        return bool(self.rows or self.map)

    def get(self):
        self._told()
        return self.rows if isinstance(self.rows, tuple) else iter(self.rows)

    def update(self, row):
        self._told()
        self.rows = row

    def put(self, rows):
        self._told()
        self.rows = list(rows)

    def appendList(self, rows):
        self._told()
        self.rows = self.rows + list(rows)

    def updateValue(self, k, v):
        self._told()
        self.map[k] = v

    def keys(self):
        return iter(self.map)

    def clear(self):
        self.rows, self.map = [], {}


def handle():
    made = lambda *a: Store()
    return SimpleNamespace(getListState=made, getValueState=made, getMapState=made, registerTimer=lambda ms: None)


def test_debounce_asks_the_store_by_the_batch():
    runs, n = ev.Runs(1000), 3_000
    runs.init(handle())
    Store.calls = 0
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    us = [i * 1_000 + (10_000_000 if i >= 2_000 else 0) for i in range(n)]
    rows = pd.DataFrame({"ts": pd.to_datetime(us, unit="us"), "event_id": range(n), "path": [f"/p{i % 700}" for i in range(n)]})
    out = list(runs.handleInputRows(("m",), iter([rows[:1500], rows[1500:]]), at(0)))
    out += list(runs.handleExpiredTimer(("m",), at(100_000), None))
    got = pd.concat(out)
    assert got.groupby("start").agg(n=("path", "nunique"), rows=("path", "size"), last=("last_event_id", "max")).to_numpy().tolist() == [[700, 700, 1999], [700, 700, 2999]]
    assert Store.calls < 200


def test_a_monitor_keeps_groups_and_no_rows():
    monitor = ev.Monitor(False)
    monitor.init(handle())
    ts = pd.Timestamp("2024-01-01")

    def parts():
        for i in range(120):
            ids = range(i * 10_000, (i + 1) * 10_000)
            yield pd.DataFrame({"batch_id": [k // 20_000 for k in ids], "event_id": ids, "ts": ts, "flags": 0, "delta": None, "path": "/p"})

    tracemalloc.start()
    out = pd.concat(list(monitor.handleInputRows(("m",), parts(), None)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["last_event_id"].tolist() == [20_000 * (i + 1) - 1 for i in range(60)]
    assert peak < 20e6
