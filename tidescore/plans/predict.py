"""The request path as one plan: validate, admit, score, take the top class, name it, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.functions.scalars import argmax_first, softmax_of_max
from tidescore.operators import scoring, validation
from tidescore.sources import sinks


def top1(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """rows plus class_index and confidence."""
    return rows.withColumn("class_index", argmax_first(F.col(logits))).withColumn("confidence", softmax_of_max(F.col(logits)))


def predict(requests: DataFrame, labels: DataFrame, model, length: int, classes: int) -> DataFrame:
    """(request_id, status, body) of requests (request_id, method, admitted, body_error, input).

    Requests that are refused are set aside by native filters before any tensor crosses to Python.
    """
    none = F.lit(None).cast("string")
    sound = (F.col("method") == "POST") & F.col("admitted") & F.col("body_error").isNull()
    refused = requests.where(~sound).select("request_id", "method", "admitted", "body_error", none.alias("error"), F.lit(None).cast("int").alias("class_index"), none.alias("class_name"), F.lit(None).cast("double").alias("confidence"))
    scored = scoring.route(top1(scoring.score(requests.where(sound), "input", model, length, classes)), labels)
    rows = scored.select(*refused.columns).unionByName(refused)
    args = (F.col("method"), F.col("admitted"), F.col("body_error"), none, F.col("error"))
    body = F.when(validation.message(*args).isNotNull(), sinks.error_json(validation.message(*args))).otherwise(sinks.prediction_json(F.col("class_index"), F.col("class_name"), F.col("confidence")))
    return rows.select("request_id", validation.status(*args).alias("status"), body.alias("body"))
