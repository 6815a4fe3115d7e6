"""Live operators on streams: the size-or-time batcher, metric windows, a sink that scores each trigger's rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Batcher(StatefulProcessor):
    """Keeps, per key, the open batch's number, size, first time and the deadline of its timer.

    A batch closes when it is full, when a row comes after its wait, or when its timer fires. A timer belongs to the batch
    that is open when a trigger ends: it is set when that batch opens, deleted when it closes, and ignored if it comes late.
    A key's rows of one trigger are sorted in memory; the source bounds a trigger's intake.
    """

    def __init__(self, max_batch: int, max_wait_us: int):
        self.max_batch, self.max_wait_us = max(1, max_batch), max_wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "batch long, size int, first_us long, deadline_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, size, first, deadline = self.open.get() if self.open.exists() else (-1, 0, 0, -1)
        waiting = batch if size else None
        every = pd.concat(list(rows)).sort_values(["ts_us", "id"], kind="stable")
        out = []
        for ts, row in zip(every["ts_us"].tolist(), every["id"].tolist(), strict=True):
            if not size or size >= self.max_batch or ts > first + self.max_wait_us:
                batch, size, first = batch + 1, 0, ts
            out.append((key[0], row, batch, size))
            size += 1
        if size >= self.max_batch:
            size = 0
        if waiting != (batch if size else None):  # the batch that was open has closed, or another one is open
            if deadline >= 0:
                self.handle.deleteTimer(deadline)
            now, deadline = timerValues.getCurrentProcessingTimeInMs(), -1
            if size and now >= 0:
                deadline = now + max(1, self.max_wait_us // 1000)
                self.handle.registerTimer(deadline)
        self.open.update((batch, size, first, deadline))
        yield pd.DataFrame(out, columns=["key", "id", "batch_id", "pos"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            batch, size, first, deadline = self.open.get()
            if size and deadline == expiredTimerInfo.getExpiryTimeInMs():
                self.open.update((batch, 0, first, -1))  # closed: the next row opens another
        return iter([])

    def close(self) -> None:
        pass


def live_batches(requests: DataFrame, key: str, ts_us: str, id_col: str, max_batch: int, max_wait_us: int, timers: bool = True) -> DataFrame:
    """(key, id, batch_id, pos) of a stream. Needs RocksDB as the state store (STATE_STORE)."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = requests.select(F.col(key).alias("key"), F.col(ts_us).alias("ts_us"), F.col(id_col).alias("id"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Batcher(max_batch, max_wait_us), outputStructType="key string, id long, batch_id long, pos int", outputMode="append", timeMode="ProcessingTime" if timers else "None"
    )


def windowed_metrics(samples: DataFrame, ts: str, value: str, window: str, late: str) -> DataFrame:
    """(start, n, mean, largest) of each window; rows later than the watermark are dropped. Zone-less times are read as UTC's."""
    timed = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), "n", "mean", "largest")


def score_each_trigger(stream: DataFrame, scorer, path: str, checkpoint: str):
    """Starts a query that writes scorer(rows) of each trigger under path; a trigger that is run again writes its folder anew."""

    def write(rows: DataFrame, number: int) -> None:
        scorer(rows).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
