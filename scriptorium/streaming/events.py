"""Streams of events: greedy de-duplication, counters, windows, and the same over stored events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of events as they arrive, with `ts` as a timestamp for watermarks."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def accepted(times: list, last, gap_s: float) -> tuple[list[bool], object]:
    """Which of the ordered times are accepted: the first, and each that is more than gap_s after the last
    accepted one (a duplicate doesn't extend the pause)."""
    out = []
    for t in times:
        ok = last is None or (t - last).total_seconds() > gap_s
        out.append(ok)
        last = t if ok else last
    return out, last


def dedupe_batch(events: DataFrame, keys: list[str], time: str, tie: str, gap_s: float = 3600) -> DataFrame:
    """Stored events without those within gap_s of the last accepted one of the same keys. Each decision
    needs the last, so each key is read in order; partitions are sorted and scanned as they stream by, with
    one time as the state, so a key of any length needs no memory. Null keys form a key, null times are
    dropped."""
    kind = events.schema[tie].dataType.simpleString()
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    narrow = events.where(F.col(time).isNotNull()).select(F.to_json(key).alias("__key"), F.unix_micros(F.col(time).cast("timestamp")).alias("__t"), F.col(tie).alias("__id"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for batch in batches:
            ids = []
            for k, t, i in zip(batch["__key"], batch["__t"], batch["__id"]):
                if k != key or t - last > gap_s * 1e6:
                    key, last = k, t
                    ids.append(i)
            yield pd.DataFrame({"__id": pd.Series(ids, dtype=batch["__id"].dtype)})

    kept = narrow.repartition("__key").sortWithinPartitions("__key", "__t", "__id").mapInPandas(scan, f"__id {kind}")
    return events.join(kept, F.col(tie) == F.col("__id"), "left_semi")


def dedupe_stream(events: DataFrame, keys: list[str], gap_s: float = 3600) -> DataFrame:
    """The same over a stream (keys, ts, event_id): the time of the last accepted event of each key is its
    state, dropped when event time has passed it by twice the pause. Needs the RocksDB state store and a
    watermark on ts."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    schema = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys) + ", ts timestamp, event_id bigint"

    class KeepFirst(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "ts timestamp")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            batch = pd.concat(rows).sort_values(["ts", "event_id"])
            last = self.last.get()[0] if self.last.exists() else None
            ok, last = accepted([t.to_pydatetime() for t in batch["ts"]], last, gap_s)
            self.last.update((last,))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(last.timestamp() * 1000 + 2000 * gap_s))
            kept = batch[ok]
            yield kept[[*keys, "ts", "event_id"]]

        def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
            self.last.clear()
            yield pd.DataFrame()

        def close(self) -> None:
            pass

    return events.select(*keys, "ts", "event_id").groupBy(*keys).transformWithStateInPandas(KeepFirst(), schema, "Append", "EventTime")


def daily_counts(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events and distinct users (approximate in a stream) per day and type."""
    src = events.withWatermark("ts", watermark) if events.isStreaming else events
    return src.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", watermark: str = "2 hours") -> DataFrame:
    """Counts in overlapping windows."""
    src = events.withWatermark("ts", watermark) if events.isStreaming else events
    return src.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of a user: events with pauses of at most the gap."""
    src = events.withWatermark("ts", watermark) if events.isStreaming else events
    return src.groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def counters(events: DataFrame, key: str) -> DataFrame:
    """Running totals per key, for update or complete output."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))


def matched(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Stream-stream join: right events of the same key at most `within` after a left one."""
    l = left.withWatermark("ts", watermark).select(F.col(key), F.col("ts").alias("left_ts"), F.col("event_id").alias("left_id"))  # noqa: E741
    r = right.withWatermark("ts", watermark).select(F.col(key).alias("__k"), F.col("ts").alias("right_ts"), F.col("event_id").alias("right_id"))
    return l.join(r, (F.col(key) == F.col("__k")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))).drop("__k")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, into a memory table; then stops."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_each(df: DataFrame, checkpoint: str, merge) -> None:
    """Calls merge(batch, number) for each micro-batch; for sinks that update a table."""
    df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
