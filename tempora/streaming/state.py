"""Keyed state with Spark's arbitrary stateful processing: history that survives late rows, silence told by timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HISTORY_HOURS = 25
#: Late hours are worked in while they are at most this much older than the newest one.
LATE_HOURS = 48
HISTORY_OUTPUT = "station_id string, timestamp_utc timestamp, history_rows int, ready boolean, sum_24h double, lag_24h double"
STATUS_OUTPUT = "station_id string, since timestamp, status string"


def rocksdb(spark: SparkSession) -> SparkSession:
    """Typed state lives in RocksDB on the executors, with its change log in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class HourHistory(StatefulProcessor):
    """A map from hour to amount for each station. Every new hour gives its own result and, when it is late, those of the
    24 hours after it again, so the last result of an hour is the one a batch run gives, whatever the order of arrival,
    the micro-batches and the Arrow batches.

    Hours that no result can need leave the map; those of a station that falls silent leave by time-to-live. An hour that is held is not
    replaced; of repeated hours in one micro-batch the smallest amount counts. Hours more than ``late`` older than the newest are left out.
    """

    def __init__(self, late: int = LATE_HOURS, ttl_ms: int | None = None):
        self.late, self.ttl_ms = late, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour_no long", "amount double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.hours.iterator()} if self.hours.exists() else {}
        new: dict[int, float] = {}
        for r in rows:
            hour, amount = r["hour_no"], r["amount"]
            if hour not in held:
                new[hour] = min(amount, new.get(hour, amount))
        if not new:
            return
        # what was held from the start of this micro-batch on tells which hours come too late
        oldest = max(held) - self.late if held else min(new)
        new = {h: a for h, a in new.items() if h >= oldest}
        every = held | new
        if new:
            yield from self._results(key[0], every, new)
        keep = max(every) - self.late - HISTORY_HOURS + 1
        for hour in held:
            if hour < keep:
                self.hours.removeKey((hour,))
        for hour, amount in new.items():
            if hour >= keep:
                self.hours.updateValue((hour,), (amount,))

    def _results(self, station: str, every: dict[int, float], new: dict[int, float]) -> Iterator[Row]:
        numbers = np.array(sorted(every))
        touched = np.array(sorted(new))
        before = np.searchsorted(touched, numbers, "right") - 1
        again = numbers[(before >= 0) & (numbers - touched[np.maximum(before, 0)] < HISTORY_HOURS)]
        amounts = np.array([every[h] for h in numbers.tolist()])
        for hour in again.tolist():
            lo, hi = np.searchsorted(numbers, [hour - HISTORY_HOURS + 1, hour + 1])
            day = lo + int(numbers[lo] == hour - HISTORY_HOURS + 1)
            full, lag = hi - day == HISTORY_HOURS - 1, day > lo
            yield Row(
                station_id=station,
                timestamp_utc=_time(hour * 3_600_000_000),
                history_rows=int(hi - lo),
                ready=bool(hi - lo == HISTORY_HOURS),
                sum_24h=sum(amounts[day:hi].tolist()) if full else None,
                lag_24h=float(amounts[lo]) if lag else None,
            )

    def close(self) -> None:
        pass


def _time(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def history(hours: DataFrame, value: str, late: int = LATE_HOURS, ttl_ms: int | None = None) -> DataFrame:
    """Trailing values of each hour from state; run it in update mode and take each hour's last row.

    With ``ttl_ms`` Spark keeps a processing-time clock and runs batches without end, so it needs a clock trigger, not availableNow.
    """
    rocksdb(hours.sparkSession)
    feed = hours.filter(F.col(value).isNotNull()).select(
        "station_id", F.floor(F.unix_seconds("timestamp_utc") / 3600).alias("hour_no"), F.col(value).cast("double").alias("amount")
    )
    mode = "ProcessingTime" if ttl_ms else "None"
    return feed.groupBy("station_id").transformWithState(HourHistory(late, ttl_ms), HISTORY_OUTPUT, "update", mode)


def united(first: np.ndarray, last: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of time, made one where no more than ``limit`` lies between them."""
    order = np.argsort(first)
    first, last = first[order], np.maximum.accumulate(last[order])
    starts = np.flatnonzero(np.append(True, first[1:] - last[:-1] > limit)[: len(first)])
    return first[starts], last[np.append(starts[1:], len(first))[: len(starts)] - 1]


class Silence(StatefulProcessor):
    """LIVE when a station speaks for the first time or after a silence, UNAVAILABLE when it has said nothing for ``limit`` microseconds.

    Rows wait until the watermark has passed them and are then taken in order of time, so neither lateness within the
    watermark nor the cut into micro-batches matters. A station has a timer for its next waiting row and one for the end of its patience; it is
    the other stations' rows that move the watermark past the timer of a silent one.

    Rows wait as spans, first and last row of a time without silence, so the state grows with the silences and not with the rows. A span is
    taken whole when the watermark has passed its first row: no silence can end or begin inside, whatever arrives later.
    """

    def __init__(self, limit_us: int):
        self.limit = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, last long")
        self.last = handle.getValueState("last", "at long, live boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [united(at, at, self.limit) for at in (r["at"].to_numpy("int64") for r in rows)]
        first, last = (x.tolist() for x in united(*(np.concatenate(x) for x in zip(*parts, strict=True)), self.limit))
        self.waiting.appendList([*zip(first, last, strict=True)])
        self.handle.registerTimer(first[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        newest, live = self.last.get() if self.last.exists() else (None, False)
        held = np.array([*self.waiting.get()] if self.waiting.exists() else [], "int64").reshape(-1, 2)
        held = [*zip(*(x.tolist() for x in united(held[:, 0], held[:, 1], self.limit)), strict=True)]
        due, rest = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        was, said = (newest, live), []
        for first, last in [*due, (now, None)]:
            if live and first > newest + self.limit:
                live = False
                said.append((newest + self.limit, "UNAVAILABLE"))
            if last is not None and (newest is None or last > newest):
                if not live:
                    said.append((first, "LIVE"))
                newest, live = last, True
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if due and rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if (newest, live) != was:
            self.last.update((newest, live))
            if live:
                self.handle.registerTimer((newest + self.limit) // 1000 + 1)
        if said:
            since, status = zip(*said, strict=True)
            yield pd.DataFrame({"station_id": [key[0]] * len(said), "since": pd.to_datetime(since, unit="us", utc=True), "status": status})

    def close(self) -> None:
        pass


def silences(rows: DataFrame, ts: str, delay: str, limit_minutes: int = 180) -> DataFrame:
    """Changes of status of every station, told by event time; a station that never speaks has none."""
    rocksdb(rows.sparkSession)
    feed = rows.select("station_id", F.col(ts)).withWatermark(ts, delay).withColumn("at", F.unix_micros(ts))
    return feed.groupBy("station_id").transformWithStateInPandas(Silence(limit_minutes * 60_000_000), STATUS_OUTPUT, "append", "EventTime")


def forecast_pairs(hours: DataFrame, model_hours: DataFrame, reach_hours: int, delay: str) -> DataFrame:
    """Each hour T with every forecast hour in (T, T + reach], as two streams joined within their watermarks.

    A forecast that arrives after its hour, or an hour after its forecast, meets the other side in the state; state is dropped when no
    partner can come any more.
    """
    left = hours.select(F.col("station_id"), F.col("timestamp_utc")).withWatermark("timestamp_utc", delay)
    right = model_hours.select(F.col("station_id").alias("model_station"), F.col("timestamp_utc").alias("valid")).withWatermark("valid", delay)
    reach = F.expr(f"valid > timestamp_utc AND valid <= timestamp_utc + INTERVAL {reach_hours} HOURS")
    return left.join(right, (F.col("station_id") == F.col("model_station")) & reach).select("station_id", "timestamp_utc", "valid")
