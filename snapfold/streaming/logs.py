"""Streams of logs and landed files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.tables import latest_per_key


def severity_windows(logs: DataFrame, width: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts per window, host and severity; with `late` as a watermark for streams."""
    rows = logs.withWatermark("timestamp", late) if late else logs
    span = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return rows.groupBy(span.alias("w"), "host", "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "host", "severity", "n")


def host_sessions(logs: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of a host's messages without a pause of `gap`."""
    rows = logs.withWatermark("timestamp", late) if late else logs
    return rows.groupBy(F.session_window("timestamp", gap).alias("w"), "host").agg(F.count(F.lit(1)).alias("n")).select("host", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def dedup_in_flight(logs: DataFrame, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """The first of equal rows (by these keys) that come within `late` of one another."""
    return logs.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(list(keys))


def upsert_into(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """An upsert for land_stream(): the newest row of each key of a batch, in a folder of the batch's own number.

    A batch that comes again writes the same folder again, so nothing lands twice. landed() reads the table.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        rows = latest_per_key(batch, keys, [F.desc(c) for c in order])
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return upsert


def landed(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    return latest_per_key(rows, keys, [*[F.desc(c) for c in order], F.desc("batch")]).drop("batch")


class _Flaps(StatefulProcessor):
    """Counts changes of state for one key in event time.

    Rows wait in a list until the watermark has passed them, so that late ones take their place; a timer stands at the
    earliest that waits. A key that has been idle for more than `idle_ms` begins anew, however batches fall, and leaves the
    state once the watermark is that far.
    """

    def __init__(self, by: Sequence[str], time: str, state: str, idle_ms: int) -> None:
        self.by, self.time, self.state, self.idle_ms = list(by), time, state, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, state string")
        self.seen = handle.getValueState("seen", "state string, flaps long, at long")

    def _set_timer(self, at: int) -> None:
        set_already = list(self.handle.listTimers())
        for old in set_already:
            if old > at:
                self.handle.deleteTimer(old)
        if not any(old <= at for old in set_already):
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (Spark's names)
        new = [(int(t.value // 1000), None if pd.isna(s) else s) for part in rows for t, s in zip(part[self.time], part[self.state], strict=True) if not pd.isna(t)]
        if new:
            first = min(t for t, _ in [*new, *(self.waiting.get() if self.waiting.exists() else [])])
            self.waiting.appendList(new)
            self._set_timer(first // 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] <= mark), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        left = [r for r in held if r[0] > mark]
        last, flaps, at = self.seen.get() if self.seen.exists() else (None, 0, None)
        for t, now in due:
            if at is not None and t - at > self.idle_ms * 1000:
                last, flaps = None, 0
            flaps += last is not None and now is not None and now != last
            last, at = now, t
        if not due and not left and at is not None and at + self.idle_ms * 1000 <= mark:
            self.seen.clear()
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.waiting.put(left) if left else self.waiting.clear()
        self.seen.update((last, flaps, at))
        self._set_timer((min(r[0] for r in left) if left else at + self.idle_ms * 1000) // 1000)
        if due:
            yield pd.DataFrame({**{c: [v] for c, v in zip(self.by, key, strict=True)}, "flaps": [flaps]})

    def close(self) -> None:
        pass


def flap_stream(events: DataFrame, by: Sequence[str], time: str, state: str, late: str = "10 minutes", idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """by and flaps so far, as a stream: how often the state has changed for each key, in order of event time, then state.

    Rows may come out of order by `late`; they count once the watermark has passed them, as in session_flaps() over all rows.
    A null state is no change and no state to change from; a pause of more than idle_ms begins the count anew. Output mode update: a row for each key whose count is renewed.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in by) + ", flaps long"
    rows = events.withWatermark(time, late).groupBy(*by)
    return rows.transformWithStateInPandas(_Flaps(by, time, state, idle_ms), schema, "update", "eventTime")


def land_stream(staging: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Lands each micro-batch by an upsert that is idempotent by batch id, all that is there now."""
    return staging.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
