"""What becomes of a request: status and message, the first rule that holds; and limits on settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages of error responses.
USE_POST, BUSY, FAILED = "use POST with an image body", "server busy, retry later", "inference failed"
DECODE = {
    "default": "could not decode image (expected JPEG or PNG): ",
    "cpu": "could not decode image on CPU (expected JPEG): ",
    "gpu": "could not decode/resize image on GPU (expected JPEG): ",
}


def status(method: Column, admitted: Column, body_error: Column, decode_error: Column, run_error: Column) -> Column:
    return F.when(method != "POST", 405).when(~admitted, 503).when(body_error.isNotNull() | decode_error.isNotNull(), 400).when(run_error.isNotNull(), 500).otherwise(200).cast("int")


def message(method: Column, admitted: Column, body_error: Column, decode_error: Column, run_error: Column, backend: str = "default") -> Column:
    """An error response's text, null where the status is 200."""
    return (
        F.when(method != "POST", F.lit(USE_POST)).when(~admitted, F.lit(BUSY)).when(body_error.isNotNull(), body_error)
        .when(decode_error.isNotNull(), F.concat(F.lit(DECODE[backend]), decode_error)).when(run_error.isNotNull(), F.lit(FAILED))
    )


def at_least_one(n: Column) -> Column:
    return F.greatest(F.lit(1), n)


def settings_error(gpu_preprocess: Column, cpu_preprocess: Column) -> Column:
    return F.when(gpu_preprocess & cpu_preprocess, F.lit("choose one preprocess backend"))


def served(status_: Column) -> Column:
    return status_ == 200
