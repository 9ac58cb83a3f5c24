"""Debounce windows: of fixed length, armed by the first event, not stretched by later ones."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Windows of time within which gaps are looked for together.
SPAN = 256
WINDOW_S, MOST_HELD, MOST_PENDING = 10, 8192, 65_536
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(times: list[int], width: int) -> list[tuple[int, int, int]]:
    """``(start, last, n)`` of the windows over ordered times; an event at a window's end opens the next."""
    out: list[list[int]] = []
    for t in times:
        if out and t < out[-1][0] + width:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return [tuple(w) for w in out]  # type: ignore[misc]


def debounce_batch(events: DataFrame, key: str, ts_us: str, width_us: int) -> DataFrame:
    """``(key, window_start, last_event, n_events)`` of a bounded table of events, times in microseconds.

    Events are first cut at gaps of at least a window, where a new window always begins; so a key's history is
    folded in many small runs instead of one; a burst without any such gap is one run, read as a stream. Null keys or
    times are left out.
    """
    kind = dict(events.dtypes)[key]
    e = events.where(F.col(key).isNotNull() & F.col(ts_us).isNotNull()).select(F.col(key).alias("k"), F.col(ts_us).cast("long").alias("t"))
    # Per key and time first, so that the ordered windows see one row per distinct time.
    e = e.groupBy("k", "t").agg(F.count("*").alias("c")).withColumn("b", F.floor(F.col("t") / (SPAN * width_us)))
    # Gaps and bursts are found within spans of time and carried over by a small table of their ends, so that no task
    # holds a key's whole history.
    inside, along = Window.partitionBy("k", "b").orderBy("t"), Window.partitionBy("k").orderBy("b")
    ends = e.groupBy("k", "b").agg(F.max("t").alias("hi")).withColumn("before", F.lag("hi").over(along)).drop("hi")
    e = e.join(ends, ["k", "b"]).withColumn("gap", F.coalesce(F.col("t") - F.coalesce(F.lag("t").over(inside), "before") >= width_us, F.lit(False)).cast("int")).drop("before")
    gaps = e.groupBy("k", "b").agg(F.sum("gap").alias("n"))
    gaps = gaps.withColumn("first", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    e = e.withColumn("burst", F.sum("gap").over(inside)).join(gaps, ["k", "b"]).withColumn("burst", F.col("burst") + F.col("first"))

    names = [key, "window_start", "last_event", "n_events"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list | None = None  # the open window: key, burst, start, last, count
        for b in batches:
            rows = []
            for k, burst, t, c in zip(b["k"].tolist(), b["burst"].tolist(), b["t"].tolist(), b["c"].tolist()):
                if now is not None and now[0] == k and now[1] == burst and t < now[2] + width_us:
                    now[3], now[4] = t, now[4] + c
                    continue
                if now is not None:
                    rows.append((now[0], *now[2:]))
                now = [k, burst, t, t, c]
            yield pd.DataFrame(rows, columns=names)
        if now is not None:
            yield pd.DataFrame([(now[0], *now[2:])], columns=names)

    # Bursts, not keys, are spread over the tasks, and each task reads its sorted rows as a stream.
    spread = e.repartition("k", "burst").sortWithinPartitions("k", "burst", "t").select("k", "burst", "t", "c")
    return spread.mapInPandas(run, f"`{key}` {kind}, window_start long, last_event long, n_events long")


COLUMNS = ["key", "window_start", "last_event", "n_events", "rescan", "paths"]


class Debouncer(StatefulProcessor):
    """Per key: the open window's start, its paths, and whether a rescan is due; held paths beyond the cap collapse into a rescan."""

    def __init__(self, width_us: int = WINDOW_S * 1_000_000, most: int = MOST_HELD):
        self.width, self.most = width_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, last long, n long, rescan boolean, paths array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.window.get() if self.window.exists() else None
        now = {"start": held[0], "last": held[1], "n": held[2], "rescan": held[3], "paths": set(held[4])} if held else None
        out = []
        events = pd.concat(list(rows)).sort_values("t", kind="stable")
        for t, path, rescan in zip(events["t"].tolist(), events["path"].tolist(), events["rescan"].tolist()):
            if now is not None and t >= now["start"] + self.width:
                out.append(self._close(key[0], now))
                now = None
            if now is None:
                now = {"start": t, "last": t, "n": 0, "rescan": False, "paths": set()}
            now["last"], now["n"] = max(now["last"], t), now["n"] + 1
            if rescan or now["rescan"]:
                now["rescan"], now["paths"] = True, set()
            else:
                now["paths"].add(path)
                if len(now["paths"]) > self.most:
                    now["rescan"], now["paths"] = True, set()
        if now is not None:
            self.window.update((now["start"], now["last"], now["n"], now["rescan"], sorted(now["paths"])))
            if held is None or held[0] != now["start"]:  # a window that was just opened closes by itself if no event comes
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, self.width // 1000))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Close the window whose time is over; the timer of one that an event has closed meanwhile finds a younger one and lets it be."""
        out = []
        if self.window.exists() and all(t <= expiredTimerInfo.getExpiryTimeInMs() for t in self.handle.listTimers()):
            start, last, n, rescan, paths = self.window.get()
            out.append((key[0], start, last, n, rescan, list(paths)))
            self.window.clear()
        yield pd.DataFrame(out, columns=COLUMNS)

    def _close(self, key: Any, w: dict) -> tuple:
        return key, w["start"], w["last"], w["n"], w["rescan"], sorted(w["paths"])

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, width_us: int = WINDOW_S * 1_000_000, most: int = MOST_HELD) -> DataFrame:
    """Closed windows of a stream ``(key string, t long, path string, rescan boolean)``; needs the RocksDB state store.

    A window is closed by the first later event of its key, or by a timer once its width has passed since it was
    opened. What is open when the stream stops stays in the state and comes out after a restart from the checkpoint,
    so nothing is lost. Timers need batches without data; a run that is to end when its input does
    (``availableNow``) has to turn them off (``spark.sql.streaming.noDataMicroBatches.enabled``).
    """
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Debouncer(width_us, most),
        outputStructType="key string, window_start long, last_event long, n_events long, rescan boolean, paths array<string>",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def reconcile_windows(windows: DataFrame, checkpoint: str, on_paths, on_rescan):
    """A running query that hands every micro-batch's paths, or a rescan, to the given functions, once each.

    Both must be idempotent: a batch is repeated if the query dies before its checkpoint.
    """

    def batch(df: DataFrame, _: int) -> None:
        df.persist()
        if not df.where("rescan").isEmpty():
            on_rescan()
        else:
            paths = df.select(F.explode("paths").alias("path")).distinct()
            if paths.limit(MOST_PENDING + 1).count() > MOST_PENDING:
                on_rescan()
            elif not paths.isEmpty():
                on_paths(paths)
        df.unpersist()

    return windows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
