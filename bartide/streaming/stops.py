"""Trailing stops as keyed state: every close raises or tests the stop of its symbol, across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERTS = "symbol string, session date, close double, stop double, alert string"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """While a query starts here, its state is kept in RocksDB: on the executors' disks, with changes in the checkpoint."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)


class TrailingStop(StatefulProcessor):
    """State of a symbol: its highest close, the last session and whether the stop was hit.

    The stop is `share` of the highest close before the session and so is only raised. A close at or under it is `breached`, once; after that the symbol is
    silent. A close within `near_pct` above it is `near`. After `idle_days` without a close the state is over: a timer deletes it, and a close that comes
    earlier than the timer starts anew all the same."""

    def __init__(self, share: float, near_pct: float, idle_days: int) -> None:
        self.share, self.near_pct, self.idle_days = share, near_pct, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stop", "highest double, last_day int, breached boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("session")  # what one batch brings of one symbol
        highest, last, breached = self.state.get() if self.state.exists() else (None, None, False)
        alerts = []
        for session, close in zip(arrived["session"], arrived["close"]):
            day = pd.Timestamp(session).toordinal()
            if last is not None and day - last > self.idle_days:
                highest, breached = None, False
            if highest is not None and not breached:
                stop = highest * self.share
                kind = "breached" if close <= stop else "near" if close <= stop * (1 + self.near_pct / 100) else None
                if kind:
                    alerts.append((key[0], session, float(close), float(stop), kind))
                breached = kind == "breached"
            highest, last = (float(close) if highest is None else max(highest, float(close))), day
        self.state.update((highest, last, breached))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        until = (pd.Timestamp.fromordinal(last) + pd.Timedelta(days=self.idle_days + 1)).value // 1_000_000
        if until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
        else:
            self.state.clear()
        yield pd.DataFrame(alerts, columns=["symbol", "session", "close", "stop", "alert"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["symbol", "session", "close", "stop", "alert"])

    def close(self) -> None:
        pass


def trailing_alerts(closes: DataFrame, share: float = 0.9, near_pct: float = 3.0, idle_days: int = 56, delay: str = "7 days") -> DataFrame:
    """Alerts of a stream of closes (symbol, session date, close, at timestamp): see TrailingStop. Batches bring sessions in order; rows of a batch may come in any."""
    rows = closes.withWatermark("at", delay)
    return rows.groupBy("symbol").transformWithStateInPandas(TrailingStop(share, near_pct, idle_days), ALERTS, "append", "EventTime")


def run_alerts(spark: SparkSession, alerts: DataFrame, table: str, checkpoint: str) -> None:
    """Take what has arrived, append the alerts and stop; the next run goes on from the state."""
    with rocks_state(spark):
        query = (alerts.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    query.awaitTermination()
