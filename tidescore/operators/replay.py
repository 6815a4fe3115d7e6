"""Replays of flow control over event tables: what the policy would have decided, row by row.

A fold per key walks the key's rows in (ts, id) order. Rows are shuffled by key once and sorted inside the partition; the
fold sees Arrow batches and carries only its state (a batch's start and size, or the ends of requests in flight), so a key
with most of the rows needs no more memory than a small one. The walk over one key is serial by its nature.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _fold(rows: DataFrame, key: str, order: list[str], fields: list[str], step: Callable, start: Callable, out: dict[str, str]) -> DataFrame:
    """rows plus `out` columns. step(state, columns) -> (state, arrays) takes a stretch of one key, start() its first state."""
    names = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} {t}" for c, t in out.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, None, False
        for batch in batches:
            keys = batch.column(names.index(key)).to_pylist()
            columns = [batch.column(names.index(f)).cast(pa.int64()).to_numpy(zero_copy_only=False) for f in fields]
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            parts = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if not begun or keys[s] != current:
                    current, state, begun = keys[s], start(), True
                state, arrays = step(state, [c[s:e] for c in columns])
                parts.append(arrays)
            made = [pa.array(np.concatenate([p[i] for p in parts])) if parts else pa.array([], pa.int64()) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *out])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(work, schema)


def settled(rows: DataFrame) -> DataFrame:
    """rows, written to the session's checkpoint folder where it names one: a replay that is read more than once runs once."""
    return rows if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty() else rows.checkpoint()


def microbatch_assign(requests: DataFrame, key: str, ts_us: str, order: str, max_batch: int, max_wait_us: int) -> DataFrame:
    """requests plus batch_id and pos. A batch opens with its first row and takes rows up to max_batch that come within max_wait_us of it, the limit included."""
    max_batch = max(1, max_batch)

    def step(state, columns):
        (ts,) = columns
        n, at = len(ts), 0
        ids, places = np.empty(n, np.int64), np.empty(n, np.int32)
        batch, size, opened = state
        while at < n:
            if size and ts[at] <= opened + max_wait_us and size < max_batch:
                end = min(at + max_batch - size, int(np.searchsorted(ts, opened + max_wait_us, "right")))
            else:
                batch, size, opened = batch + 1, 0, int(ts[at])
                end = min(at + max_batch, int(np.searchsorted(ts, opened + max_wait_us, "right")))
            ids[at:end] = batch
            places[at:end] = np.arange(size, size + end - at)
            size, at = size + end - at, end
        return (batch, size, opened), [ids, places]

    return _fold(requests, key, [ts_us, order], [ts_us], step, lambda: (-1, 0, 0), {"batch_id": "bigint", "pos": "int"})


def admission(requests: DataFrame, key: str, ts_us: str, order: str, service_us: str, max_inflight: int) -> DataFrame:
    """requests plus admitted: whether a slot is free at a row's time. An admitted row holds its slot until ts + service, a rejected one holds none; max_inflight below 1 admits all."""

    def step(ends, columns):
        ts, service = columns
        out = np.ones(len(ts), bool)
        if max_inflight > 0:
            for i, (t, s) in enumerate(zip(ts.tolist(), service.tolist(), strict=True)):
                while ends and ends[0] <= t:
                    heapq.heappop(ends)
                if len(ends) < max_inflight:
                    heapq.heappush(ends, t + s)
                else:
                    out[i] = False
        return ends, [out]

    return _fold(requests, key, [ts_us, order], [ts_us, service_us], step, list, {"admitted": "boolean"})


def closed_loop(requests: DataFrame, key: str, order: list[str], latency: str, workers: str) -> DataFrame:
    """requests plus start: when a closed loop of a key's `workers` (its first row's) sends each row, from zero on.

    Each worker sends the next row in order as soon as its last one is answered.
    """

    def step(free, columns):
        latencies, some = columns
        if not free:
            free = [0] * max(1, int(some[0]))
        start = np.empty(len(latencies), np.int64)
        for i, x in enumerate(latencies.tolist()):
            start[i] = free[0]
            heapq.heapreplace(free, free[0] + x)
        return free, [start]

    return _fold(requests, key, order, [latency, workers], step, list, {"start": "bigint"})


def fail_batches(rows: DataFrame, batch: list[str], error: str) -> DataFrame:
    """rows whose error is their batch's first error, in order of text: one failure fails every member. A null is a batch's name like any other."""
    return rows.withColumn(error, F.min(error).over(Window.partitionBy(*batch)))


def drain(rows: DataFrame, ts_us: str, taken_us: str, stop_us, message: str = "engine shutting down") -> DataFrame:
    """rows plus error: the message for rows that at the stop were still queued, not yet taken into a batch, or that came after it.

    Rows of batches that were being gathered or run are answered. stop_us is a number or a column.
    """
    stop = F.lit(stop_us) if isinstance(stop_us, int) else stop_us
    return rows.withColumn("error", F.when((F.col(taken_us) > stop) | (F.col(ts_us) > stop), F.lit(message)))


def round_robin(seq, n: int):
    """The image that the request with this number sends; the first one sends image 1."""
    return F.pmod(seq + 1, F.lit(n))
