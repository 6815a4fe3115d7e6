"""Sinks: JSON responses and documents, result files, Markdown tables.

Result tables have one row per load level; formatting them in Python keeps C's rounding of exact ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns and decimals of a result file, and the heads and formats of the tables.
CSV_COLUMNS = {
    "concurrency": "d", "throughput_req_s": ".2f", "p50_ms": ".2f", "p95_ms": ".2f", "p99_ms": ".2f", "mean_ms": ".2f", "max_ms": ".2f",
    "gpu_util_avg_pct": ".1f", "gpu_util_max_pct": ".1f", "gpu_mem_max_mib": "d", "gpu_samples": "d", "errors": "d", "elapsed_sec": ".3f",
}
CLOSED_TABLE = {
    "concurrency": ("Concurrency", "11d"), "throughput_req_s": ("Throughput (req/s)", "18.1f"), "p50_ms": ("p50 (ms)", "8.1f"), "p95_ms": ("p95 (ms)", "8.1f"),
    "p99_ms": ("p99 (ms)", "8.1f"), "mean_ms": ("mean (ms)", "9.1f"), "max_ms": ("max (ms)", "8.1f"), "gpu_util_avg_pct": ("GPU util avg", "11.0f%"),
    "gpu_util_max_pct": ("GPU util max", "11.0f%"), "errors": ("errors", "6d"),
}
OPEN_TABLE = {
    "offered_rate": ("Offered req/s", "13d"), "achieved": ("Achieved req/s", "14.1f"), "p50_ms": ("p50 (ms)", "8.1f"), "p95_ms": ("p95 (ms)", "8.1f"),
    "p99_ms": ("p99 (ms)", "8.1f"), "mean_ms": ("mean (ms)", "9.1f"), "overruns": ("overruns", "8d"), "errors": ("errors", "6d"), "util_avg": ("GPU util avg", "11.0f%"),
}


def prediction_json(class_index: Column, class_name: Column, confidence: Column) -> Column:
    """A response's body; a missing or empty name is left out."""
    return F.to_json(F.struct(class_index.alias("class_index"), F.when(class_name != "", class_name).alias("class_name"), confidence.alias("confidence")))


def error_json(message: Column) -> Column:
    return F.to_json(F.struct(message.alias("error")))


def _format(value, how: str) -> str:
    return format(value, how[:-1]) + "%" if how.endswith("%") else format(int(value) if how.endswith("d") else float(value), how)


def csv_lines(results: DataFrame) -> DataFrame:
    """(concurrency, line): the lines of a result file, without its head."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"concurrency": f["concurrency"].astype(int), "line": [",".join(_format(r[c], how) for c, how in CSV_COLUMNS.items()) for r in f.to_dict("records")]})

    return results.select(*CSV_COLUMNS).mapInPandas(work, "concurrency int, line string")


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines under path/json, the CSV file under path/csv, the JSON array under path/array."""
    results_json(results).coalesce(1).write.mode("overwrite").text(f"{path}/array")
    results.write.mode("overwrite").json(f"{path}/json")
    names = list(CSV_COLUMNS)
    cells = csv_lines(results).orderBy("concurrency").select(*[F.split("line", ",")[i].alias(c) for i, c in enumerate(names)])
    cells.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def results_json(results: DataFrame) -> DataFrame:
    """(json): one row, a JSON array of the result rows by concurrency. Result tables have a row per load level."""
    rows = F.array_sort(F.collect_list(F.struct(*CSV_COLUMNS)))
    return results.agg(F.to_json(rows, {"pretty": "true"}).alias("json"))


def table_lines(results: DataFrame, table: dict[str, tuple[str, str]]) -> DataFrame:
    """(the first column, line): the lines of a Markdown table, without its head."""
    first = next(iter(table))
    kind = results.schema[first].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lines = ["| " + " | ".join(_format(r[c], how) for c, (_, how) in table.items()) + " |" for r in f.to_dict("records")]
            yield pd.DataFrame({first: f[first], "line": lines})

    return results.select(*table).mapInPandas(work, f"`{first}` {kind}, line string")


def markdown(results: DataFrame, table: dict[str, tuple[str, str]]) -> str:
    """A Markdown table of a result frame, by its first column."""
    widths = [max(len(head), len(_format(0, how))) for head, how in table.values()]
    lines = ["| " + " | ".join(head for head, _ in table.values()) + " |", "|" + "|".join("-" * (w + 1) + ":" for w in widths) + "|"]
    return "\n".join(lines + [r.line for r in table_lines(results, table).orderBy(next(iter(table))).collect()]) + "\n"
