"""Live twins of session, lap and incident detection on Structured Streaming.

A stateful key is one vehicle, whose rate is bounded by its sensors. Rows wait in the key's list
state until the watermark passes them and are then folded in event time over a few numbers of
state, so neither the size of a trigger nor the order of its files changes a result. Rows behind
the watermark of the trigger before theirs, up to which others may have been folded, are dropped
and counted.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import FractionalType, IntegralType, StructType

# The process that sets up keyed state on the driver does not inherit the import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions closed by a quiet gap; rows later than the watermark are dropped."""
    w = F.session_window(ts, gap)
    d = stream.withWatermark(ts, delay).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("_last"))
    return d.select(key, F.col("w.start").alias("t_in"), F.col("_last").alias("t_out"), "n")


class _EventTimeFold(StatefulProcessor):
    """Buffers a key's rows, and folds those that the watermark has passed in event time.

    ``step(state, row)`` returns (state, output row or None). A timer at the earliest waiting row
    releases it; with ``idle_us`` a key starts anew after a longer gap between rows, and its state
    goes once the watermark shows one.
    """

    def __init__(self, key: str, ts: str, order: list[str], cols: list[str], row_schema: StructType, width: int, names: list[str],
                 step: Callable[[list, tuple], tuple], idle_us: int | None):
        self.key, self.ts, self.order, self.cols, self.row_schema = key, ts, order, cols, row_schema
        self.width, self.names, self.step, self.idle_us = width, names, step, idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.numbers = handle.getValueState("numbers", ", ".join([*[f"s{i} double" for i in range(self.width)], "last long"]))

    def _timer(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def _rows(self, d: pd.DataFrame) -> list[tuple]:
        """State rows of the exact types: a batch with a null has its whole numbers as floats."""
        cast = [int if isinstance(f.dataType, IntegralType) else float if isinstance(f.dataType, FractionalType) else (lambda v: v) for f in self.row_schema]
        return [tuple(None if pd.isna(v) else c(v) for c, v in zip(cast, row)) for row in d.itertuples(index=False, name=None)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fields = self.row_schema.fieldNames()
        got = pd.concat(list(rows), ignore_index=True)[fields]
        if len(got):
            self.waiting.appendList(self._rows(got))
            self._timer(int(got[self.ts].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fields = self.row_schema.fieldNames()
        held = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=fields) if self.waiting.exists() else pd.DataFrame(columns=fields)
        due = held[held[self.ts].astype("int64") <= passed].sort_values(self.order, kind="stable") if len(held) else held
        rest = held.drop(due.index)
        now, last = [None] * self.width, None
        if self.numbers.exists():
            *now, last = self.numbers.get()
        out = []
        for at, row in zip(due[self.ts].tolist(), due[self.cols].itertuples(index=False, name=None)):
            if self.idle_us is not None and last is not None and at - last > self.idle_us:
                now = [None] * self.width
            now, made = self.step(list(now), row)
            last = int(at)
            if made is not None:
                out.append((key[0], *made))
        if len(due):
            self.numbers.update((*[None if v is None else float(v) for v in now], last))
            if len(rest):
                self.waiting.put(self._rows(rest))
            else:
                self.waiting.clear()
        if len(rest):
            self._timer(int(rest[self.ts].min()))
        elif self.idle_us is not None and last is not None:
            if last + self.idle_us < passed:
                self.numbers.clear()
            else:
                self._timer(last + self.idle_us + 1000)
        if out:
            yield pd.DataFrame(out, columns=[self.key, *self.names])

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, ts: str, delay: str, order: list[str], out: str, width: int, step: Callable[[list, tuple], tuple], cols: list[str],
              idle_us: int | None = None) -> DataFrame:
    """Fold the rows of each key in event time. ``ts`` is a clock in microseconds; null keys are left out."""
    names = [c.split()[0] for c in out.split(",")]
    fields = list(dict.fromkeys([ts, *order, *cols]))
    row_schema = StructType([stream.schema[c] for c in fields])
    key_type = stream.schema[key].dataType.simpleString()
    timed = stream.where(F.col(key).isNotNull()).withColumn("_ts", F.timestamp_micros(ts)).withWatermark("_ts", delay)
    fold = _EventTimeFold(key, ts, order, cols, row_schema, width, names, step, idle_us)
    return timed.groupBy(key).transformWithStateInPandas(fold, f"{key} {key_type}, {out}", "Append", "EventTime")


def live_laps(stream: DataFrame, key: str, ts: str, delay: str, gate: tuple[float, float, float, float], min_gap: float, min_speed: float = 0.6,
              idle_us: int | None = None) -> DataFrame:
    """Gate crossings with interpolated time, side and lap number. Needs t, event_id, e, n, speed."""
    ax, ay, bx, by = gate
    sx, sy = bx - ax, by - ay

    def step(state, row):
        t, eid, e, n, v = row
        pt, pid, pe, pn, pv, last, lap = state
        nxt = [t, eid, e, n, v, last, lap or 0.0]
        if pt is None or pv < min_speed:
            return nxt, None
        rx, ry = e - pe, n - pn
        det = rx * sy - ry * sx
        if abs(det) <= 1e-12:
            return nxt, None
        qx, qy = ax - pe, ay - pn
        f, u = (qx * sy - qy * sx) / det, (qx * ry - qy * rx) / det
        tc = pt + f * (t - pt)
        if not (0 <= f <= 1 and 0 <= u <= 1) or (last is not None and tc - last <= min_gap):
            return nxt, None
        nxt[5], nxt[6] = tc, nxt[6] + 1
        return nxt, (int(pid), tc, 1 if ry * sx - rx * sy >= 0 else -1, int(nxt[6]))

    return _stateful(stream, key, ts, delay, [ts, "event_id"], "event_id long, t_cross double, side int, lap_no long", 7, step, ["t", "event_id", "e", "n", "speed"], idle_us)


def live_incidents(stream: DataFrame, key: str, ts: str, delay: str, crash_speed: float, drop: float, spin: float, slow: float, slow_s: float, go: float, go_s: float,
                   idle_us: int | None = None) -> DataFrame:
    """Incident flag per row once the watermark passes it. Needs t, event_id, speed, turn."""

    def step(state, row):
        t, eid, v, w = row
        pt, pv, inc, low, rec = state
        inc, low, rec = inc or 0.0, low or 0.0, rec or 0.0
        if pt is None:
            return [t, v, 0.0, 0.0, 0.0], (int(eid), False)
        dt = t - pt
        if not inc and v < crash_speed and (v - pv < drop or abs(w) > spin):
            inc, low, rec = 1.0, 0.0, 0.0
        if not inc:
            low = low + dt if v < slow else 0.0
            if low > slow_s:
                inc, low = 1.0, 0.0
            return [t, v, inc, low, rec], (int(eid), bool(inc))
        rec = rec + dt if v > go else 0.0
        if rec > go_s:
            inc, rec = 0.0, 0.0
        return [t, v, inc, low, rec], (int(eid), True)

    return _stateful(stream, key, ts, delay, [ts, "event_id"], "event_id long, incident boolean", 5, step, ["t", "event_id", "speed", "turn"], idle_us)


def drain(stream: DataFrame, path: str) -> int:
    """Run a stream over all files present now into a Parquet folder, then stop.

    Returns the number of rows dropped as later than the watermark. Keyed state needs the RocksDB
    store; the session's own choice is put back once the query has started.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    was = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        conf.set(name, was) if was else conf.unset(name)
    late, running = {}, True
    while running:  # progress keeps the last triggers only
        running = not q.awaitTermination(1)
        for p in q.recentProgress:  # a trigger may be reported again without rows
            late[p.batchId] = max(late.get(p.batchId, 0), sum(op.numRowsDroppedByWatermark for op in p.stateOperators))
    return sum(late.values())
