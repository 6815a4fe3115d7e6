"""Summaries of latencies, batches, decoders and meters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidescore.functions.scalars import ns_to_ms_by_us
from tidescore.operators.quantiles import quantiles

QUANTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


def _wide_sum(column):
    """The sum of whole numbers as a decimal, from two sums of longs: nanoseconds of a large table overflow one."""
    value, part = F.col(column).cast("bigint") if isinstance(column, str) else column.cast("bigint"), 1 << 20
    high, low = F.sum(F.shiftright(value, 20)).cast("decimal(20,0)"), F.sum(value.bitwiseAND(F.lit(part - 1))).cast("decimal(20,0)")
    return high * F.lit(part).cast("decimal(7,0)") + low


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _truncated_mean_ms(total: str, n: str):
    """The mean in whole nanoseconds, then whole microseconds, as milliseconds."""
    return F.when(F.col(n) > 0, ns_to_ms_by_us(F.expr(f"{total} div {n}"))).otherwise(F.lit(0.0))


def same_key(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """a joined with b by a key that both have; a null equals a null."""
    return a.join(b.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")


def _summary(rows: DataFrame, level: str, latency_ns: Column, **more: Column) -> DataFrame:
    """(level, more, mean_ms, p50_ms, p95_ms, p99_ms, max_ms): one aggregate of all rows, and the quantiles of latencies that aren't null."""
    rows = rows.withColumn("_ns", latency_ns)
    marks = quantiles(rows, level, "_ns", list(QUANTILES.values()))
    wide = marks.groupBy(level).agg(*[F.max(F.when(F.col("q") == q, ns_to_ms_by_us(F.col("_ns")))).alias(name) for name, q in QUANTILES.items()])
    totals = rows.groupBy(level).agg(_wide_sum("_ns").alias("_sum"), F.count("_ns").alias("_n"), F.max("_ns").alias("_max"), *[c.alias(name) for name, c in more.items()])
    return same_key(totals, wide, level, "left").select(level, *more, _truncated_mean_ms("_sum", "_n").alias("mean_ms"), *QUANTILES, ns_to_ms_by_us(F.col("_max")).alias("max_ms"))


def latencies(rows: DataFrame, level: str, latency_ns: str) -> DataFrame:
    """(level, mean_ms, p50_ms, p95_ms, p99_ms, max_ms) over all rows of a level; null is a level."""
    return _summary(rows, level, F.col(latency_ns))


def _elapsed(elapsed_sec: DataFrame | Column) -> dict[str, Column]:
    return {"elapsed_sec": elapsed_sec} if isinstance(elapsed_sec, Column) else {}


def closed_loop(rows: DataFrame, level: str, latency_ns: str, ok: str, elapsed_sec: DataFrame | Column) -> DataFrame:
    """requests, errors, elapsed_sec, throughput_req_s and latencies of each level. Failed requests count in latencies, not in throughput.

    elapsed_sec: an aggregate over a level's rows, or a table (level, elapsed_sec).
    """
    out = _summary(rows, level, F.col(latency_ns), requests=F.count(F.lit(1)), errors=F.count_if(~F.col(ok)), **_elapsed(elapsed_sec))
    if isinstance(elapsed_sec, DataFrame):
        out = same_key(out, elapsed_sec, level)
    return out.withColumn("throughput_req_s", _ratio((F.col("requests") - F.col("errors")).cast("double"), F.col("elapsed_sec")))


def open_loop(rows: DataFrame, rate: str, latency_ns: str, ok: str, overrun: str, elapsed_sec: DataFrame | Column) -> DataFrame:
    """achieved, completed, errors, overruns and latencies of each offered rate. Latencies are those of successes only; overruns were never sent. elapsed_sec: as in closed_loop."""
    sent = ~F.col(overrun)
    counts = {"completed": F.count_if(sent & F.col(ok)), "errors": F.count_if(sent & ~F.col(ok)), "overruns": F.count_if(F.col(overrun))}
    out = _summary(rows, rate, F.when(sent & F.col(ok), F.col(latency_ns)), **counts, **_elapsed(elapsed_sec)).drop("max_ms")
    if isinstance(elapsed_sec, DataFrame):
        out = same_key(out, elapsed_sec, rate)
    return out.withColumn("achieved", _ratio(F.col("completed").cast("double"), F.col("elapsed_sec"))).drop("elapsed_sec").na.fill(0.0, ["mean_ms", *QUANTILES])


def progress(batches: DataFrame, key: str, order: str, n: str, every: int = 200) -> DataFrame:
    """(key, line) at every so many batches of a key: how many were run, their mean size, the last one's. A key's batches are walked in one task."""
    run = Window.partitionBy(key).orderBy(order)
    walked = batches.select(key, F.col(n).alias("n"), F.row_number().over(run).alias("b"), F.sum(n).over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("rows"))
    mean = F.expr("format_number(rows / b, '0.0')")  # rounds the exact binary value, as C does
    line = F.format_string("batching: %d batches run, avg batch size %s (last=%d)", F.col("b"), mean, F.col("n"))
    return walked.where(F.col("b") % every == 0).select(key, line.alias("line"))


def batch_stats(batches: DataFrame, by: list[str]) -> DataFrame:
    """batches, requests and avg_batch_size from rows with n, failed batches included."""
    return batches.groupBy(*by).agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("requests")).withColumn("avg_batch_size", _ratio(F.col("requests").cast("double"), F.col("batches")))


def timing_stats(batches: DataFrame, by: list[str]) -> DataFrame:
    """Mean wait a request, mean run and lane time a batch in ms, and the lane's busy share, from n, wait_ns, run_ns, lane_ns, busy_ns, idle_ns, failed.

    Batches that failed count in the numbers of requests and batches, not in the times of runs. Group by a reset's epoch to start anew.
    """
    total = lambda c: F.coalesce(_wide_sum(c).cast("double"), F.lit(0.0))
    good = F.when(~F.col("failed"), F.col("run_ns"))
    return batches.groupBy(*by).agg(
        _ratio(total("wait_ns"), F.sum("n") * 1e6).alias("avg_queue_wait_ms"), _ratio(total(good), F.count(F.lit(1)) * 1e6).alias("avg_infer_run_ms"),
        _ratio(total("lane_ns"), F.count(F.lit(1)) * 1e6).alias("avg_runbatch_ms"), _ratio(total("busy_ns"), total("busy_ns") + total("idle_ns")).alias("collector_busy_frac"),
    )


def preprocess_stats(rows: DataFrame, by: list[str], decode_ns: str, normalise_ns: str, ok: str) -> DataFrame:
    """Mean decode and normalise ms and the count, of successes only."""
    n = F.count_if(F.col(ok))
    mean = lambda c: _ratio(F.coalesce(_wide_sum(F.when(F.col(ok), F.col(c))).cast("double"), F.lit(0.0)), n * 1e6)
    return rows.groupBy(*by).agg(mean(decode_ns).alias("avg_decode_ms"), mean(normalise_ns).alias("avg_normalize_ms"), n.alias("preproc_count"))


def stats_document(batches: DataFrame, rejects: DataFrame, by: list[str], gpu: DataFrame | None = None, cpu: DataFrame | None = None) -> DataFrame:
    """by and document: the /stats JSON, its keys in order, from batches as timing_stats takes them and by's count of rejects.

    gpu and cpu are preprocess_stats by the same columns; a decoder that isn't given has no keys, and of two the CPU's count stands.
    A group that a part doesn't have counts zero there.
    """
    parts = [batch_stats(batches, by), timing_stats(batches, by), rejects.select(*by, "rejects")]
    if gpu is not None:
        count = [] if cpu is not None else ["preproc_count"]
        parts.append(gpu.select(*by, F.col("avg_decode_ms").alias("avg_gpu_decode_ms"), F.col("avg_normalize_ms").alias("avg_cpu_normalize_ms"), *count))
    if cpu is not None:
        parts.append(cpu.select(*by, F.col("avg_decode_ms").alias("avg_cpu_decode_ms"), F.col("avg_normalize_ms").alias("avg_cpu_resize_normalize_ms"), "preproc_count"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    names = sorted(c for c in rows.columns if c not in by)
    one = rows.groupBy(*by).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])
    return one.select(*by, F.to_json(F.struct(*names)).alias("document"))


def meter_summary(samples: DataFrame, by: list[str], util: str, mem: str) -> DataFrame:
    """util_avg, util_max, mem_max and count of a meter's samples; zeros where there is none."""
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t)
    return samples.groupBy(*by).agg(zero(F.avg(util), "double").alias("util_avg"), zero(F.max(util), "double").alias("util_max"), zero(F.max(mem), "int").alias("mem_max"), F.count(util).alias("count"))


def parity(a_minus_b: DataFrame, by: list[str], delta: str, tolerance: int) -> DataFrame:
    """mean and largest absolute difference, and the percentage within the tolerance, of all rows: a null difference isn't within it."""
    off = F.abs(F.col(delta))
    within = F.coalesce(off <= tolerance, F.lit(False))
    return a_minus_b.groupBy(*by).agg(F.avg(off).alias("mean_abs"), F.max(off).alias("max_abs"), (F.avg(within.cast("double")) * 100).alias("within_pct"))


def speedup(levels: DataFrame, level: str, ms: str) -> DataFrame:
    """levels plus speedup: the first level's ms over each one's. One row per level, so the window is small."""
    first = F.first(ms).over(Window.orderBy(level).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("speedup", first / F.col(ms))
