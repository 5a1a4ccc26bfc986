"""Streams over arriving ticks: late and repeated rows, bars from ticks, alerts on closes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bartide.sources import batches
from bartide.sources.market import arrival_key


def first_per_key(ticks: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """Keep the first arrival of every key; repeats inside the watermark are dropped and the state stays bounded."""
    return ticks.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def bars(ticks: DataFrame, time: str, key: str, value: str, order: str, width: str = "4 hours", delay: str = "1 hour") -> DataFrame:
    """Open, high, low, close, mean and count per key and window; each bar is final once the watermark has passed it."""
    at = arrival_key((F.unix_micros(F.col(time).cast("timestamp")), 18), (F.col(order), 19))  # one number: the state keeps fixed slots
    rows = ticks.withWatermark(time, delay) if ticks.isStreaming else ticks
    return (rows.groupBy(F.window(time, width).alias("w"), F.col(key).alias("symbol"))
            .agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
                 F.avg(value).alias("mean"), F.count(F.lit(1)).alias("qty"))
            .select("symbol", F.col("w.start").alias("session"), F.col("w.end").alias("until"), "open", "high", "low", "close", "mean", "qty"))


def with_open_bars(final: DataFrame, ticks: DataFrame, time: str, key: str, value: str, order: str, width: str = "4 hours") -> DataFrame:
    """The final bars and, from a batch read of the same ticks, those of the windows that the watermark had not passed yet."""
    done = final.agg(F.max("until").alias("_done"))
    late = ticks.join(F.broadcast(done), F.col("_done").isNull() | (F.col(time) >= F.col("_done"))).drop("_done")  # one row
    return final.unionByName(bars(late, time, key, value, order, width))


def stop_alerts(closes: DataFrame, stops: DataFrame, near_pct: float = 3.0) -> DataFrame:
    """Arriving closes at or under their stop, or within `near_pct` above it: a stateless join with the stop table."""
    rows = closes.join(stops, "symbol")
    close, stop = F.col("close"), F.col("stop")
    state = F.when(close <= stop, "breached").when(close <= stop * (1 + near_pct / 100), "near")
    return rows.withColumn("alert", state).where(F.col("alert").isNotNull())


def append_latest(ticks: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keep-last without rewriting the table: every micro-batch adds its latest row per key as a batch of its own; a replayed one is not taken
    twice, and `batches.read_latest` resolves the few versions of a key."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batches.upsert(batch.sparkSession, path, batch, str(batch_id), keys, order)

    return ticks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available and stop; exactly-once files in append mode."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
